"""URL filters as a sort-merge range join on reversed-host keys.

A host is written with its labels reversed, each followed by a slash (``www.example.com`` becomes
``com/example/www/``); a host holds no slash, so no two hosts share a key. A rule's host and all
its subdomains are then one interval of keys, from the rule's own key up to, not including, that
key with its last slash raised by one code. Intervals nest or are disjoint. Urls and rule
intervals are sorted together and swept once: a stack keeps the rules whose interval is open,
innermost last, and a url looks only at that stack.

The sorted order is cut into ranges by (host key, path, page id), at quantiles of a bounded
sample that only places the cuts. A host with a third of all urls therefore spreads over many
ranges. A rule goes to each range its interval meets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import Workspace, ascii_lower, partitions, table

#: The rules of the contract, longest match wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Verdict of a url that no rule fits.
DEFAULT_VERDICT = "allow"
#: Most sampled keys for each cut between ranges.
SAMPLE_PER_RANGE = 60


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


def _cuts(urls: DataFrame, n: int) -> list[tuple]:
    """n - 1 sort keys that cut the urls into ranges of about equal size, from a sample of at most SAMPLE_PER_RANGE * n rows."""
    want = SAMPLE_PER_RANGE * n
    total = urls.count()
    share = min(1.0, want / max(1, total))
    got = urls.select("key", "path", "tie").sample(withReplacement=False, fraction=share, seed=11).limit(want).collect() if n > 1 else []
    keys = sorted((r.key.encode(), r.path.encode(), r.tie) for r in got)
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Verdict for each row of pages: page_id, host, path, rule, verdict, rule_host, rule_path.

    rules has host, path and verdict. A rule fits a url if the url's host is the rule's or one of
    its subdomains and the url's path starts with the rule's path. Of the rules that fit, the one
    with the most characters in host and path together wins, on a tie the one with the longer host,
    then the one whose verdict comes first by code point. A null url, or one without ``://``, has an
    empty host and path and meets no rule with a non-empty host. Repeated rows are judged
    each on their own, null page ids too; further columns are ignored; empty pages give an empty
    result, empty rules the default verdict everywhere.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "url-filter")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = ws.table(urls.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id")), "urls")
    n = partitions(spark)
    cuts = _cuts(urls, n)

    def part_of(batches):
        for b in batches:
            found = [bisect_right(cuts, (k.encode(), p.encode(), t)) for k, p, t in zip(b["key"].to_pylist(), b["path"].to_pylist(), b["tie"].to_pylist())]
            yield b.append_column("part", pa.array(found, pa.int32()))

    schema = "page_id {}, host string, path string, key string, tie bigint, part int".format(urls.schema["page_id"].dataType.simpleString())
    lanes = urls.mapInArrow(part_of, schema)

    lows = [c[0] for c in cuts]

    def parts_met(batches):
        """Each rule once for each range that the interval of its key meets: from the one of its first key to that of its last."""
        for b in batches:
            keys = [k.encode() for k in b["key"].to_pylist()]
            met = [range(bisect_left(lows, k), bisect_left(lows, k[:-1] + b"0") + 1) for k in keys]
            again = b.take(pa.array([i for i, m in enumerate(met) for _ in m], pa.int64()))
            yield again.append_column("part", pa.array([p for m in met for p in m], pa.int32()))

    ruled = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host is not null and rule_path is not null and verdict is not null")
    ruled = ruled.withColumn("rule_host", ascii_lower(F.col("rule_host"))).distinct().withColumn("key", host_key(F.col("rule_host")))
    ruled = ruled.mapInArrow(parts_met, "rule_host string, rule_path string, verdict string, key string, part int")

    both = lanes.select("part", "key", F.lit(1).alias("kind"), "path", "tie", "page_id", "host", F.lit(None).cast("string").alias("verdict")).unionByName(
        ruled.select("part", "key", F.lit(0).alias("kind"), F.col("rule_path").alias("path"), F.lit(0).cast("bigint").alias("tie"), F.lit(None).cast(schema.split(",")[0].split(" ", 1)[1]).alias("page_id"), F.col("rule_host").alias("host"), "verdict")
    )
    both = both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind", "path", "tie")
    out_schema = pa.schema([("page_id", urls.select("page_id").limit(0).toArrow().schema.field(0).type), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("rule_host", pa.string()), ("rule_path", pa.string())])

    def sweep(batches):
        stack: list[tuple[str, str, dict]] = []  # open intervals: key, host, and by length the paths of its rules with their verdicts
        part = None
        for b in batches:
            col = {c: b[c].to_pylist() for c in b.schema.names}
            keep, rule_host, rule_path, verdicts = [], [], [], []
            for i, (p, key, kind) in enumerate(zip(col["part"], col["key"], col["kind"])):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, col["host"][i], {}))
                    same = stack[-1][2].setdefault(len(col["path"][i]), {})
                    same[col["path"][i]] = min(col["verdict"][i], same.get(col["path"][i], col["verdict"][i]))
                    continue
                best = None
                for _, host, own in stack:
                    for length, paths in own.items():
                        start = col["path"][i][:length]
                        if start in paths:
                            rank = (-length - len(host), -len(host))
                            if best is None or rank < best[0]:
                                best = (rank, host, start, paths[start])
                keep.append(i)
                rule_host.append(best[1] if best else None)
                rule_path.append(best[2] if best else None)
                verdicts.append(best[3] if best else default)
            kept = b.take(pa.array(keep, pa.int64()))
            rule = [None if h is None else h + p for h, p in zip(rule_host, rule_path)]
            yield pa.RecordBatch.from_arrays([kept["page_id"].cast(out_schema.field(0).type), kept["host"], kept["path"], pa.array(rule, pa.string()), pa.array(verdicts, pa.string()), pa.array(rule_host, pa.string()), pa.array(rule_path, pa.string())], schema=out_schema)

    return both.mapInArrow(sweep, "page_id {}, host string, path string, rule string, verdict string, rule_host string, rule_path string".format(urls.schema["page_id"].dataType.simpleString()))


def op2_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), n AS (SELECT *, row_number() OVER () AS rid FROM u
), m AS (
  SELECT rid, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, rule_verdict) AS place
  FROM n JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM n LEFT JOIN (SELECT * FROM m WHERE place = 1) m USING (rid)
"""
