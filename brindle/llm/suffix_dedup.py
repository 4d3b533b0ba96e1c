"""Suffix-array dedup of exact substrings, by column-wise construction for many documents at once.

A suffix array of all text would tell which strings of 100 bytes occur twice: neighbours in its
order with a common prefix of 100 or more. Here it is built for many short documents at a time, one
column per round: each round inserts the next symbol, from right to left, of every document into
the collection's Burrows-Wheeler transform by one stable sort on that symbol, and carries the common
prefixes of neighbours along. After a column is in, neighbours that share 100 symbols or more
form a class, and in each class all strings but the earliest are repeats.

So that the rounds are few and the collections small, the corpus is first cut into collections
that cannot share a string with each other. Each 100-byte window has an anchor, the least hash of
its 50-byte grams (leftmost on a tie), and equal windows have equal anchors at equal places. A run
of windows with one anchor is one document of the collection of that gram: some 125 bytes, aligned on the
anchor, so at most 150 rounds whatever the texts' lengths. Documents of a collection that are the
same (gram and 64 bits of XXH3 over the run's bytes) are one document of it, held by its earliest occurrence; its
other occurrences are repeats throughout. A collection with a single document has none.

Exact copies of earlier documents are recognised by their SHA-256 first and take no further part:
all of a copy is repeats if it has 100 bytes. Files between the stages are Parquet in the shared
folder, sorted by collection, and are read through in order. A collection that is too large for one
construction (a gram that a third of all documents hold, each in other surroundings) is split the way
the corpus was: windows that start up to so many bytes apart before the anchor go together, and
have to agree in all the bytes that they share around it. A window that starts l bytes before the anchor meets every window
equal to it in one such part. Parts are constructed like any collection; where one is still too
large, its windows are dealt singly, and a part is then one string of 100 bytes and its occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import Workspace, partitions, table

LENGTH = 100
#: Bytes hashed at a time; 2 ** POS_BITS at most.
STEP_BYTES = 1_000_000
POS_BITS = 20
#: Documents of one construction.
MOST_ROWS = 8_192
#: Different documents beyond this make a collection a large one, which is split, so that no task gets more of one collection.
LARGE = 2_048
#: Window starts that go together when a large collection is split.
SPLIT = 7
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
OUTSIDE = 256

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, STEP_BYTES + LENGTH), b, np.uint64)]))
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any stretches of a byte array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power(len(data))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start] + np.uint64(salt)
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(32))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    m, have = x, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end: gram hash, anchor, first and last window start."""
    k = length // 2
    empty = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < length:
        return empty
    h = Hashes(data)
    at = np.arange(len(data) - k + 1)
    gram = h.of(at, at + k)
    low = np.uint64((1 << POS_BITS) - 1)
    least = _window_min((gram & ~low) | at.astype(np.uint64), length - k + 1)
    ok = np.ones(len(least), bool)
    for e in ends.tolist():
        ok[max(0, e - length + 1) : e] = False
    start = np.flatnonzero(ok)
    if not len(start):
        return empty
    anchor = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(first[1:], len(start)) - 1
    return gram[anchor[first]], anchor[first], start[first], start[last]


def _pieces(batches, length: int):
    """Texts of a partition in steps: bytes laid end to end, and for each text (or stretch of a long one) rid, place in its text and length."""
    held, size = [], 0
    for b in batches:
        for rid, raw in zip(b["rid"].to_pylist(), b["raw"]):
            raw = raw.as_py()
            for at in range(0, max(1, len(raw) - length + 1), STEP_BYTES // 2):
                part = raw[at : at + STEP_BYTES // 2 + length - 1]
                if size + len(part) > STEP_BYTES and held:
                    yield held
                    held, size = [], 0
                held.append((rid, at, part))
                size += len(part)
    if held:
        yield held


def _laid(held):
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held], np.int64)
    ends = np.cumsum(sizes)
    return data, ends, ends - sizes, np.array([r for r, _, _ in held], np.int64), np.array([a for _, a, _ in held], np.int64)


#: A run: its collection, a hash of its bytes, and where it is. place holds the first window, and in its low bits the number of
#: windows, the bytes before the anchor, and the kind, so that the many rows are short.
_RUNS = pa.schema([("gram", pa.int64()), ("same", pa.int64()), ("rid", pa.int64()), ("place", pa.int64())])
_RUNS_SQL = "gram bigint, same bigint, rid bigint, place bigint"
FIELD_BITS, KIND_BITS = 12, 2


def packed(first, windows, lead, kind):
    """place of a run; works on numbers, arrays and Columns alike."""
    return ((first * (1 << FIELD_BITS) + windows) * (1 << FIELD_BITS) + lead) * (1 << KIND_BITS) + kind


def _unpacked(rows: DataFrame) -> DataFrame:
    """Runs with first, windows, lead and kind."""
    field = (1 << FIELD_BITS) - 1
    return rows.select("gram", "rid", F.expr(f"shiftright(place, {2 * FIELD_BITS + KIND_BITS})").alias("first"), F.expr(f"shiftright(place, {FIELD_BITS + KIND_BITS}) & {field}").cast("int").alias("windows"), F.expr(f"shiftright(place, {KIND_BITS}) & {field}").cast("int").alias("lead"), F.expr(f"place & {(1 << KIND_BITS) - 1}").cast("int").alias("kind"))


#: kind of a run: still open; a repeat throughout; a document of a collection of several; one of a large collection.
OPEN, REPEAT, COMPARE, LARGER = 0, 1, 2, 3


def _find_runs(texts: DataFrame, length: int) -> DataFrame:
    """All runs of all texts. Of equal runs within one step only the earliest is open, the rest are repeats (under a key of their own, to lie anywhere)."""

    def run(batches):
        for held in _pieces(batches, length):
            data, ends, starts, rids, offsets = _laid(sorted(held, key=lambda x: x[:2]))
            gram, anchor, first, last = runs_of(data, ends, length)
            if not len(gram):
                continue
            which = np.searchsorted(ends, first, "right")
            raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            same = np.array([digest(raw[a:z], seed=k) for a, z, k in zip(first.tolist(), (last + length).tolist(), (anchor - first).tolist())], np.uint64)
            order = np.lexsort((same, gram))  # stable: places stay in order
            again = np.concatenate([[False], (gram[order][1:] == gram[order][:-1]) & (same[order][1:] == same[order][:-1])])
            kind = np.zeros(len(gram), np.int32)
            kind[order[again]] = REPEAT
            key = np.where(kind == REPEAT, same + np.arange(len(gram), dtype=np.uint64) * np.uint64(MIX), gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(same.view(np.int64)), pa.array(rids[which]), pa.array(packed(first - starts[which] + offsets[which], last - first + 1, anchor - first, kind))], schema=_RUNS)

    return texts.select("rid", "raw").mapInArrow(run, _RUNS_SQL)


def _classify(runs: DataFrame) -> DataFrame:
    """Runs that are not alone in their collection, with their kind; read in order of collection, document, place."""
    n = partitions(runs.sparkSession)
    in_order = runs.repartition(n, "gram").sortWithinPartitions("gram", "same", "rid", "place")
    kinds = (1 << KIND_BITS) - 1

    def run(batches):
        gram = same = None
        waiting = None  # the first document of the collection, while it is the only one
        documents = 0
        for b in batches:
            col = {c: b[c].to_numpy() for c in _RUNS.names}
            n = b.num_rows
            if not n:
                continue
            g, s = col["gram"], col["same"]
            new_g = np.concatenate([[g[0] != gram], g[1:] != g[:-1]])
            new_s = new_g | np.concatenate([[s[0] != same], s[1:] != s[:-1]])
            kind = col["place"] & kinds
            opens = kind == OPEN
            out_kind = np.where(opens, REPEAT, kind)
            # documents before each row in its collection, counting on from the last batch
            firsts = np.flatnonzero(new_s & opens)
            starts = np.flatnonzero(new_g)
            upto = np.cumsum(new_s & opens)
            base = np.zeros(n, np.int64)
            base[starts] = upto[starts] - 1 * (new_s & opens)[starts]
            base = np.maximum.accumulate(base)
            place = upto - base
            if not new_g[0]:
                until = starts[0] if len(starts) else n
                place[:until] += documents
            # one that is not the first of its collection, or that a second one follows
            several = place[firsts] > 1
            several[:-1] |= place[firsts[1:]] == 2
            keep = ~opens | ~(new_s & opens)
            out_kind[firsts] = np.where(place[firsts] > LARGE, LARGER, COMPARE)
            keep[firsts[several]] = True
            emit_waiting = waiting is not None and len(firsts) and not new_g[firsts[0]] and place[firsts[0]] == 2
            if emit_waiting:
                yield waiting
                waiting = None
            if len(firsts) and place[firsts[-1]] == 1:
                i = int(firsts[-1])
                waiting = pa.RecordBatch.from_arrays([pa.array(col[c][i : i + 1] - (c == "place") * (kind[i] - COMPARE)) for c in _RUNS.names], schema=_RUNS)
            gram, same, documents = g[-1], s[-1], int(place[-1])
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(col[c][at] - (kind[at] - out_kind[at] if c == "place" else 0)) for c in _RUNS.names], schema=_RUNS)

    return in_order.mapInArrow(run, _RUNS_SQL)


def column_classes(symbols: np.ndarray, group: np.ndarray, length: int):
    """Column-wise construction over equally long aligned documents, the rows of symbols, in collections given by group (ascending).

    Yields, for each column from which length symbols are left, the order of the rows by the suffixes from that
    column and where in it the classes that share that many symbols begin.
    """
    rows, width = symbols.shape
    _, small = np.unique(group, return_inverse=True)
    order = np.arange(rows)
    border = np.concatenate([[True], small[1:] != small[:-1]])
    # common prefix of each suffix with the one before it; -1 across collections
    common = np.where(border, -1, 0).astype(np.int32)
    bwt = symbols[order, width - 1]
    for column in range(width - 1, -1, -1):
        by_symbol = np.argsort(bwt, kind="stable")
        move = by_symbol[np.argsort(small[order][by_symbol], kind="stable")]
        g, s = small[order][move], bwt[move]
        joined = np.concatenate([[False], (g[1:] == g[:-1]) & (s[1:] == s[:-1])])
        fresh = np.where(np.concatenate([[True], g[1:] != g[:-1]]), -1, 0).astype(np.int32)
        at = np.flatnonzero(joined)
        if len(at):
            spans = np.empty(2 * len(at), np.int64)
            spans[0::2], spans[1::2] = move[at - 1] + 1, move[at] + 1
            fresh[at] = np.minimum.reduceat(np.append(common, np.int32(0)), spans)[0::2] + 1
        order, common = order[move], fresh
        if column:
            bwt = symbols[order, column - 1]
        if width - column >= length:
            yield column, order, np.flatnonzero(common < length)


def repeated_windows(symbols: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For each row and column whether the window there (between lo and hi) also occurs in an earlier row of its group; rows of a group are in order."""
    out = np.zeros((len(symbols), symbols.shape[1] - length + 1), bool)
    rows = np.arange(len(symbols))
    for column, order, starts in column_classes(symbols, group, length):
        earliest = np.minimum.reduceat(order, starts)
        sizes = np.diff(np.append(starts, len(order)))
        later = order != np.repeat(earliest, sizes)
        out[order[later], column] = True
    columns = np.arange(out.shape[1])
    return out & (columns[None, :] >= lo[rows, None]) & (columns[None, :] <= hi[rows, None])


_SPANS = pa.schema([("rid", pa.int64()), ("first", pa.int64()), ("windows", pa.int64())])


def _spans(rid, place, hits):
    """Unbroken runs of hits in each row: rid, first window, number of windows."""
    padded = np.zeros((len(hits), hits.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hits
    step = np.diff(padded, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(place[row] + a), pa.array((b - a).astype(np.int64))], schema=_SPANS)


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats among the documents of collections, by column-wise construction."""
    n = partitions(contexts.sparkSession)
    in_order = contexts.repartition(n, "gram").sortWithinPartitions("gram", "rid", "first")
    reach = length - length // 2  # most windows before the anchor
    width = reach + length

    def solve(rows):
        gram = np.concatenate([r[0] for r in rows])
        rid, first, windows, lead = (np.concatenate([r[i] for r in rows]) for i in range(1, 5))
        raws = [x for r in rows for x in r[5]]
        symbols = np.full((len(gram), width), OUTSIDE, np.uint16)
        for i, (raw, skip) in enumerate(zip(raws, (reach - lead).tolist())):
            symbols[i, skip : skip + len(raw)] = np.frombuffer(raw, np.uint8)
        lo = reach - lead
        return _spans(rid, first - lo, repeated_windows(symbols, gram, lo, lo + windows - 1, length))

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            gram = b["gram"].to_numpy()
            cuts = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
            cols = [b[c].to_numpy() for c in ("rid", "first", "windows", "lead")]
            raws = b["raw"].to_pylist()
            for a, z in zip(cuts, cuts[1:]):
                if size >= MOST_ROWS - LARGE and held and held[-1][0][-1] != gram[a]:
                    yield solve(held)
                    held, size = [], 0
                held.append((gram[a:z], *(c[a:z] for c in cols), raws[a:z]))
                size += z - a
        if held:
            yield solve(held)

    return in_order.mapInArrow(run, "rid bigint, first bigint, windows bigint")


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of large collections as runs of smaller ones: windows that start at similar places before the anchor, under a hash of the bytes that they must share."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for b in batches:
            out = [[] for _ in range(4)]
            for rid, first, windows, lead, raw in zip(*(b[c].to_pylist() for c in ("rid", "first", "windows", "lead", "raw"))):
                for k in range((lead - windows + 1) // SPLIT, lead // SPLIT + 1):
                    low, high = max(k * SPLIT, lead - windows + 1), min(k * SPLIT + SPLIT - 1, lead)
                    mine = raw[lead - high : lead - low + length]
                    shared = raw[lead - k * SPLIT : lead - min(k * SPLIT + SPLIT - 1, length - length // 2) + length]
                    for column, v in zip(out, (digest(shared, seed=k), digest(mine, seed=high), rid, packed(first + lead - high, high - low + 1, high, OPEN))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]), *(pa.array(c, pa.int64()) for c in out[2:])], schema=_RUNS)

    return contexts.mapInArrow(run, _RUNS_SQL)


def _strings(contexts: DataFrame, length: int) -> DataFrame:
    """Repeats among parts that are still too large: each window by itself, under 128 bits, its earliest place combined before the shuffle."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(3)]
            for r, f, w, raw in zip(*(b[c].to_pylist() for c in ("rid", "first", "windows", "raw"))):
                for i in range(w):
                    for column, v in zip(out, (r, f + i, hashlib.blake2b(raw[i : i + length], digest_size=16).digest())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["rid", "first", "h"])

    windows = contexts.mapInArrow(run, "rid bigint, first bigint, h binary")
    earliest = windows.groupBy("h").agg(F.min(F.struct("rid", "first")).alias("low"), F.count("*").alias("n")).where("n > 1").select("h", "low")
    return windows.join(earliest, "h").where("rid <> low.rid or first <> low.first").select("rid", "first", F.lit(1).cast("bigint").alias("windows"))


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of runs, taken from their texts: gram, rid, first, windows, lead, kind, raw."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("gram", "first", "windows", "lead", "kind")).alias("runs"))
    each = texts.select("rid", "raw").join(lists, "rid").select("rid", "raw", F.explode("runs").alias("r"))
    return each.select("r.gram", "rid", "r.first", "r.windows", "r.lead", "r.kind", F.substring("raw", (F.col("r.first") + 1).cast("int"), (F.col("r.windows") + (length - 1)).cast("int")).alias("raw"))


_RESULT = "doc_id {}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"


def _remove(texts: DataFrame, repeats: DataFrame, length: int, of: str) -> DataFrame:
    lists = repeats.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("first", "windows"))).alias("runs"))
    joined = texts.join(lists, "rid", "left").select("doc_id", "raw", "runs")

    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for raw, runs in zip(b["raw"], b["runs"]):
                raw, spans = raw.as_py(), []
                for r in runs.as_py() or ():
                    a, z = r["first"], r["first"] + r["windows"] + length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                kept, at = hashlib.sha256(), 0
                for a, z in spans:
                    kept.update(raw[at:a])
                    at = z
                kept.update(raw[at:])
                for column, v in zip(out, (len(raw), sum(z - a for a, z in spans), len(spans), kept.hexdigest(), [{"start": a, "stop": z} for a, z in spans])):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(run, _RESULT.format(of))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop; bytes).

    length is at most 4,096. Removed is each byte that a string of ``length`` bytes covers which also starts earlier: in a
    smaller document, or earlier in the same one. Documents are ordered by id, null ids last, then by a hash
    of the text; of rows with one id and one text the first is the original and the others are copies. A null text
    is empty. Strings are judged on the input and never cross documents. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    of = docs.schema[id_col].dataType.simpleString()
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw")).withColumn("sha", F.sha2("raw", 256))
    marks = ws.table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha", F.octet_length("raw").cast("bigint").alias("n_bytes")), "marks")
    firsts = ws.table(marks.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))).alias("low")).select(F.col("sha").alias("s"), F.col("low.b").alias("d"), F.col("low.c").alias("first_row")), "firsts")
    copies = ws.table(marks.join(firsts, F.col("sha") == F.col("s")).where("row <> first_row").select("doc_id", "sha", "n_bytes", F.col("d").alias("original")), "copies")
    # originals are numbered in order; their texts get the numbers, and copies fall away, in one join
    order = [F.col("d").asc_nulls_last(), F.col("s").asc()]
    numbered = ws.table(firsts.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("d", "s", F.monotonically_increasing_id().alias("rid")), "numbers")
    texts = rows.join(numbered, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s"))).select("rid", "doc_id", "raw")
    twice = copies.where("doc_id <=> original").limit(1).count()
    texts = ws.table(texts.dropDuplicates(["rid"]) if twice else texts, "texts")

    found, again = _unpacked(ws.table(_classify(_find_runs(texts, length)), "runs")), None
    for last in (False, True):
        some = found.where(f"kind = {REPEAT}").select("rid", "first", F.col("windows").cast("bigint").alias("windows"))
        again = some if again is None else again.unionByName(some)
        wanted = found.where(f"kind >= {COMPARE}")
        large = found.where(f"kind = {LARGER}").select(F.col("gram").alias("g")).distinct()
        several = large.limit(1).count() > 0
        if several:
            large = ws.table(large, "large")
            hot = wanted.join(large, F.col("gram") == F.col("g"), "left_semi")
            wanted = wanted.join(large, F.col("gram") == F.col("g"), "left_anti")
        again = again.unionByName(ws.table(_compare(_contexts(texts, wanted, length), length), "compared"))
        if not several:
            break
        if last:
            again = again.unionByName(ws.table(_strings(_contexts(texts, hot, length), length), "strings"))
        else:
            found = _unpacked(ws.table(_classify(_split(_contexts(texts, hot, length), length)), "parts"))
    repeats = again
    kept = _remove(texts, repeats, length, of)
    gone = F.col("n_bytes") >= length
    whole = copies.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).cast("bigint").alias("n_removed"), gone.cast("bigint").alias("n_spans"), F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
    )
    return kept.unionByName(whole)


def op6_suffix_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


#: Every window of 100 bytes, as hexadecimal digits; the texts are first cut into overlapping pieces, which only makes it faster.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT r, c, substring(h, CAST(2 * c + 1 AS BIGINT), 998) AS p FROM d, unnest(range(0, greatest(0, length(h) // 2 - 99), 400)) t(c)
), w AS (
  SELECT r, c + o AS s, md5_number(substring(p, CAST(2 * o + 1 AS BIGINT), 200)) AS w FROM pieces, unnest(range(0, least(400, length(p) // 2 - 99))) t(o)
), again AS (
  SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY w ORDER BY r, s) AS k FROM w) WHERE k > 1
), runs AS (
  SELECT r, min(s) AS a, max(s) + 100 AS z
  FROM (SELECT r, s, sum(CASE WHEN s > before + 100 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS island FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM again))
  GROUP BY r, island
), ends AS (
  SELECT r, a, z FROM runs UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d
), parts AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z), 0) AS start, a AS stop, z - a AS gone FROM ends
), kept AS (
  SELECT r, string_agg(substring(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start) AS BIGINT)), '' ORDER BY start, stop) AS h, sum(gone) AS gone, count(*) - 1 AS n
  FROM parts JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (r)
"""
