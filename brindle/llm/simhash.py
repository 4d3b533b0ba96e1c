"""SimHash near-dedup through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes by position. Two fingerprints that differ in at most d bits
share at least 8 - d positional bytes: the guaranteed minimum. Listing fingerprints under single
bytes and tallying would look at all pairs of a list, which grow with the square of the data, so
the tally is taken over whole sets of positions: the index has one list for each choice of 8 - d
positions and the bytes there. A pair reaches the minimum if and only if it meets in one of those
lists; it then meets in C(t, 8 - d) of them where t is its tally. Only such pairs are looked at.

All of a list agrees in 8 - d bytes, so a list never has more than 256**d different fingerprints
(65,536 for two bits), whatever the data. Its members are verified under masks with d bits cleared, whose
groups hold nothing but true links. A list gives a spanning forest of its links, not all of them.
Documents with one fingerprint are a single entry of the index.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.graph import components
from brindle.llm.work import Workspace, named_as, numbered, partitions, table

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
#: Near copies by similarity: shared shingles of five words, of all that either text has.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Buckets that the shingles of all texts are counted in, and slices in which a task hands them on. The counts only say which shingles count as rare.
BUCKET_BITS, COUNT_SLICES = 18, 64
#: Bits of the parity bitmap of a set of shingles.
PARITY_BITS = 1024
#: Partners of a row, by their distance in a list, that each round of comparisons reaches; the last takes the rest.
REACH = (6, None)
#: Rows of a block of a list. A list of more rows is dealt to blocks by a hash of the row, and each pair of blocks is a group that any task can compare.
BLOCK = 512
#: Rows of the index, and pairs, that are in memory at a time.
SLICE, PAIRS = 256, 1 << 16
#: Shingles whose bits are counted at a time.
STEP = 1 << 16


def _hashed(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of a whole text, in order and with repeats: A-Z lower-cased, words between ASCII white space, one space between them. A text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), stops[k - 1 :].tolist())], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[i : i + STEP].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.uint32)
    set_bits = np.flatnonzero(2 * ones > len(hashes)).tolist()
    return sum(1 << b for b in set_bits)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a whole text: A-Z lower-cased, shingles of ASCII-white-space words with repeats; 0 without words."""
    return _majority(_hashed(text, words, seed))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint) and digest (a hash of the text) for each row."""
    of = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), words, seed)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], names=["doc_id", "fp", "digest"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("d")).mapInArrow(run, f"doc_id {of}, fp bigint, digest bigint")


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x


def shingle_set(threes: np.ndarray) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles of SIMILAR_WORDS words, from the hashes of its shingles of SHINGLE_WORDS in order.

    Five words are the three that start at the first and the three that end at the last: two such
    shingles are equal if and only if both threes are. A text of four words is one shingle of
    two threes, a shorter one is its only shingle.
    """
    apart = SIMILAR_WORDS - SHINGLE_WORDS
    if len(threes) <= apart:  # fewer than five words
        return _mixed(np.array([len(threes)], np.uint64) + threes[:1] + _mixed(threes[-1:])) if len(threes) else threes
    return np.unique(_mixed(threes[:-apart] + _mixed(threes[apart:] + np.uint64(SIMILAR_WORDS))))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """In how many texts, of all, the shingles of each bucket occur: an array of 2 ** BUCKET_BITS numbers, whatever the data."""
    wide = (1 << BUCKET_BITS) // COUNT_SLICES

    def count(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, _buckets(shingle_set(_hashed(t.as_py(), SHINGLE_WORDS, SEED))), 1)
        some = counts.reshape(COUNT_SLICES, wide).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNT_SLICES)), pa.array([x.tobytes() for x in some], pa.binary())], names=["slice", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b["slice"].to_pylist(), b["n"]):
                own = total.setdefault(i, np.zeros(wide, np.int64))
                own += np.frombuffer(n.as_buffer(), np.uint32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "n"])

    kind = "slice bigint, n binary"
    parts = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(count, kind)
    counts = np.zeros((COUNT_SLICES, wide), np.int64)
    for r in parts.repartition(COUNT_SLICES, "slice").mapInArrow(add, kind).collect():  # one row for each slice
        counts[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return np.minimum(counts.reshape(-1), 2**32 - 1).astype(np.uint32)


def rarest(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set of shingles in one order for all sets, rare ones first: as many that two sets which overlap by similarity or more have one in common."""
    k = len(hashes) - math.ceil(similarity * len(hashes) * (1 - 1e-9)) + 1 if len(hashes) else 0
    return hashes[np.argsort(counts[_buckets(hashes)], kind="stable")[:k]]


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of a set: for each bit whether an odd number of the set's members fall on it. Two sets differ in at least as many members as their bitmaps in bits."""
    return np.packbits(np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1)


def sketches(docs: DataFrame, id_col: str, text_col: str, counts: np.ndarray, similarity: float) -> DataFrame:
    """doc_id, fp, digest as in fingerprints, and size, prefix and parity of each row's set of shingles."""
    of = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                fps, sizes, prefixes, bitmaps = [], [], [], []
                for t in b.column(1):
                    threes = _hashed(t.as_py(), SHINGLE_WORDS, SEED)
                    mine = shingle_set(threes)
                    fps.append(signed(_majority(threes)))
                    sizes.append(len(mine))
                    prefixes.append(rarest(mine, counts, similarity).tobytes())
                    bitmaps.append(parity(mine).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(bitmaps, pa.binary())], names=["doc_id", "fp", "digest", "size", "prefix", "parity"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("d"))
    return rows.mapInArrow(run, f"doc_id {of}, fp bigint, digest bigint, size bigint, prefix binary, parity binary")


def position_masks(bits: int) -> list[int]:
    """For each choice of 8 - bits byte positions, the mask of those bytes."""
    return [sum(0xFF << (8 * p) for p in keep) for keep in combinations(range(8), 8 - bits)]


def list_links(choice: np.ndarray, place: np.ndarray, fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within lists: choice says which bytes the fingerprints of a list agree in, place numbers the lists in order.

    Two fingerprints of a list differ in its free bytes alone. They are at most ``bits`` bits apart
    if and only if they are equal with some ``bits`` of the free bits cleared, so each choice of
    bits is one sort, of all lists at once; neighbours in it that are equal are linked.
    """
    free = np.array([[b for b in range(64) if not mask >> b & 1] for mask in position_masks(bits)])[choice].astype(np.uint64)
    unsigned, one = fps.view(np.uint64), np.uint64(1)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for clear in combinations(range(8 * bits), bits):
        cleared = unsigned.copy()
        for c in clear:
            cleared &= ~(one << free[:, c])
        order = np.lexsort((cleared, place))
        same = np.flatnonzero((cleared[order][1:] == cleared[order][:-1]) & (place[order][1:] == place[order][:-1]))
        for i, j in zip(order[same].tolist(), order[same + 1].tolist()):
            a, b = find(i), find(j)
            if a != b:
                parent[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def near_links(fps: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct) that differ in at most bits bits, enough of them to connect all."""
    masks = position_masks(bits)
    entries = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("choice", "bytes"))
    lists = entries.repartition(partitions(fps.sparkSession), "choice", "bytes").sortWithinPartitions("choice", "bytes", "fp")

    def links(choice, key, fp):
        first = np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        place = np.cumsum(first)
        several = np.bincount(place)[place] > 1
        found = list_links(choice[several], place[several], fp[several], bits) if several.any() else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    def run(batches):
        held = None  # a list that may go on in the next batch: (choice, bytes, fps)
        for b in batches:
            now = [b[c].to_numpy() for c in ("choice", "bytes", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            choice, key, fp = now
            if not len(fp):
                continue
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
            last = int(cut[-1]) + 1 if len(cut) else 0
            if last:
                yield links(choice[:last], key[:last], fp[:last])
            held = [x[last:] for x in now]
        if held is not None:
            yield links(*held)

    return lists.mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, bits: int = MOST_BITS, words: int = SHINGLE_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, and root (a fingerprint of the component) and digest (a hash of the text).

    component_id is the smallest id reachable over links between fingerprints that differ in at most
    ``bits`` bits, the row's own included; equal fingerprints are linked. A null or blank
    text has fingerprint zero and is linked like any other. A null id is never the smallest
    unless its component has no other. Repeated rows are kept. Other columns are ignored; an
    empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.table(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    smallest = ws.table(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    links = ws.table(near_links(smallest.select("fp"), bits).distinct(), "near")
    roots = components(links, ws)
    rooted = ws.table(smallest.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = ws.table(rooted.join(lows, "root").select("fp", "component_id", "root"), "classes")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "digest")


def _lists(batches, names: list[str], by: int):
    """The columns of batches sorted by the first ``by`` of them, cut where those change: rows of one list are never apart."""
    held = None
    for b in batches:
        now = [b[c].to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        others = np.flatnonzero(np.any([x != x[-1] for x in now[:by]], axis=0))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None:
        yield held


def prefix_lists(rows: DataFrame) -> DataFrame:
    """key (a shingle), rid, size and at (its place in the prefix) of each row that shares a shingle of its prefix with another row, and of two further rows a partition at most.

    Entries are in ranges of (key, rid), so a shingle that a third of all rows share is in many; no task holds a list.
    """
    low = (1 << 32) - 1

    def entries(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                each = [np.frombuffer(x.as_buffer(), np.int64) for x in b["prefix"]]
                n = np.fromiter(map(len, each), np.int64, len(each))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(each), np.repeat(b["rid"].to_numpy(), n), np.repeat(b["size"].to_numpy() << 32, n) | at)], names=["key", "rid", "place"])

    def shared(batches):
        def out(columns, keep):
            key, rid, place = (x[keep] for x in columns)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, rid, place >> 32, place & low)], names=["key", "rid", "size", "at"])

        held, stays = None, True  # the last row, and whether the one before has its key; the ends of a range stay, as lists may go on beyond them
        for b in batches:
            now = [b[c].to_numpy() for c in ("key", "rid", "place")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            again = now[0][1:] == now[0][:-1]
            keep = np.append(stays, again)
            keep[:-1] |= again
            yield out([x[:-1] for x in now], keep[:-1])
            held, stays = [x[-1:] for x in now], keep[-1]
        if held is not None:
            yield out(held, [True])

    each = rows.where("size > 0").select("rid", "size", "prefix").mapInArrow(entries, "key bigint, rid bigint, place bigint")
    return each.repartitionByRange(partitions(rows.sparkSession), "key", "rid").sortWithinPartitions("key", "rid").mapInArrow(shared, "key bigint, rid bigint, size bigint, at bigint")


def long_lists(lists: DataFrame) -> DataFrame:
    """long (a key) and blocks of each list of more than BLOCK rows."""
    return lists.groupBy("key").count().where(f"count > {BLOCK}").select(F.col("key").alias("long"), F.expr(f"(count + {BLOCK - 1}) div {BLOCK}").alias("blocks"))


def _may_overlap(size, at, i, j, similarity: float) -> np.ndarray:
    """Whether rows i and j of a list can overlap by similarity, were the list's shingle the first that they share. Of similar sets, that one's list says yes."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    most = np.minimum(size[i] - at[i], size[j] - at[j])
    return (small >= similarity * large - 1e-6) & (most >= similarity / (1 + similarity) * (small + large) - 1e-6)


def _may_agree(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these parity bitmaps, and these sizes in sum, can overlap by similarity."""
    differ = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
    return differ <= sizes * (1 - similarity) / (1 + similarity) + 1e-6


def _bitmaps(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, PARITY_BITS // 64)


def plausible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of rids whose sizes and parity (of rows) allow an overlap by similarity."""

    def run(batches):
        for b in batches:
            keep = pa.array(_may_agree(_bitmaps(b["pa"].to_pylist()), _bitmaps(b["pb"].to_pylist()), b["na"].to_numpy() + b["nb"].to_numpy(), similarity))
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    own = rows.select("rid", "size", "parity")
    both = pairs.join(own.toDF("a", "na", "pa"), "a").join(own.toDF("b", "nb", "pb"), "b")
    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def unsettled(lists: DataFrame, from_: int) -> DataFrame:
    """open: the keys of those lists whose rows have several roots and that reach beyond the partners already compared."""
    ends = lists.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return ends.where(f"low <> high and n > {from_ + 1}").select(F.col("key").alias("open"))


def candidates(lists: DataFrame, similarity: float, from_: int, to: int | None) -> DataFrame:
    """Pairs (a, b) of rids of different roots, that can overlap by similarity: by size, place and, where lists have it, parity.

    lists has key, rid, size, at, root, blocks. With ``to``, of each block of a list the rows up to ``to`` places apart; without, all pairs of
    a list but those up to from_ places apart in one block. In the group of blocks (i, j) rows of i meet rows of j, in (i, i) all meet.
    """
    bitmaps = "parity" in lists.columns
    names = ["key", "pair", "rid", "size", "at", "root", "side", *["parity"] * bitmaps]
    own = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    groups = lists.withColumn("own", own).withColumn("other", F.col("own") if to is not None else F.explode(F.expr("sequence(0L, blocks - 1)")))
    groups = groups.withColumn("pair", F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).withColumn("side", F.signum(F.col("other") - F.col("own")).cast("bigint"))
    groups = groups.select(*names).repartition(partitions(lists.sparkSession), "key", "pair").sortWithinPartitions("key", "pair", "rid")

    def meet(batches):
        for key, pair, rid, size, at, root, side, *more in _lists(batches, names, 2):
            words = _bitmaps(more[0]) if bitmaps else None
            left, apart, found, n = np.arange(len(key)), 0 if side.any() else from_, [], 0
            while len(left):
                apart += 1
                left = left[: np.searchsorted(left, len(key) - apart)]
                left = left[(key[left] == key[left + apart]) & (pair[left] == pair[left + apart])] if to is None or apart <= to else left[:0]
                for i in range(0, len(left), PAIRS):
                    one = left[i : i + PAIRS]
                    two = one + apart
                    wanted = side[one] != side[two] if apart <= from_ else (side[one] == 0) | (side[one] != side[two])
                    one, two = one[wanted], two[wanted]
                    near = (root[one] != root[two]) & _may_overlap(size, at, one, two, similarity)
                    one, two = one[near], two[near]
                    if bitmaps and len(one):
                        near = _may_agree(words[one], words[two], size[one] + size[two], similarity)
                        one, two = one[near], two[near]
                    found.append((np.minimum(rid[one], rid[two]), np.maximum(rid[one], rid[two])))
                    n += len(one)
                if found and (n >= PAIRS or not len(left)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
                    found, n = [], 0

    return groups.mapInArrow(meet, "a bigint, b bigint").distinct()


def shingle_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid and s, the set of shingles, of those rows (rid, doc_id, digest) of docs whose rid is in a pair (a, b)."""
    wanted = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct()
    named = rows.join(wanted, F.col("rid") == F.col("w"), "left_semi").select("rid", F.col("doc_id").alias("own"), F.col("digest").alias("own_digest"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("d"))
    texts = named.join(texts, F.col("i").eqNullSafe(F.col("own")) & (F.col("d") == F.col("own_digest"))).select("rid", "t")

    def hashed(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([b["rid"], pa.array([shingle_set(_hashed(t.as_py(), SHINGLE_WORDS, SEED)).tobytes() for t in b["t"]], pa.binary())], names=["rid", "s"])

    return texts.mapInArrow(hashed, "rid bigint, s binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of rids whose sets (rid, s) overlap by similarity or more."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])

    return both.mapInArrow(verify, "a bigint, b bigint")


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, root for each row of docs: rows with one root are linked, by fingerprints as in simhash_components or by similarity.

    Candidates are all pairs that share one of the rarest shingles of both (see rarest), which every similar pair does; each is
    verified on whole sets of shingles. Rows of a list are compared in rounds, with the next few, then with all the rest (REACH; long
    lists by pairs of blocks, see candidates), and after each round the pairs that verified links have joined meanwhile are left out, nothing else: the components are those of all similar pairs. Rows of
    one text are one row of the lists. Texts without words are linked to each other by their zero fingerprint.
    """
    ws = Workspace(docs.sparkSession, "similar")
    rows = ws.table(sketches(docs, id_col, text_col, shingle_counts(docs, text_col), similarity).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    firsts = ws.table(rows.groupBy("fp").agg(F.min("rid").alias("first")), "distinct")
    same = rows.join(firsts, "fp").select(F.col("rid").alias("a"), F.col("first").alias("b"))
    near = near_links(firsts.select("fp")).distinct()
    near = near.join(firsts.toDF("a", "ra"), "a").join(firsts.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    links = ws.table(same.unionByName(near).where("a <> b"), "fingerprint-links")
    one = rows.groupBy("fp", "digest").agg(F.min("rid").alias("w")).select("w")
    several = rows.groupBy("fp", "digest").count().where("count > 1").limit(1).count()
    listed = rows.join(one, F.col("rid") == F.col("w"), "left_semi") if several else rows
    lists = ws.table(prefix_lists(listed), "lists")
    long = ws.table(long_lists(lists), "long")
    lists = lists.join(long, F.col("key") == F.col("long"), "left").select("key", "rid", "size", "at", F.coalesce("blocks", F.lit(1).cast("bigint")).alias("blocks"))
    bitmaps = rows.select(F.col("rid").alias("w"), "parity")
    roots, from_ = ws.table(components(links, ws), "roots"), 0
    for to in REACH:
        open_ = lists.join(roots, F.col("rid") == F.col("node"), "left").select(*lists.columns, F.coalesce("root", "rid").alias("root"))
        if from_:
            keys = ws.table(unsettled(open_, from_), "unsettled")
            if not keys.limit(1).count():
                break
            open_ = open_.join(keys, F.col("key") == F.col("open"), "left_semi").join(bitmaps, F.col("rid") == F.col("w")).drop("w")
        pairs = ws.table(candidates(open_, similarity, from_, to), "candidates")
        if not from_:
            pairs = ws.table(plausible(pairs, rows, similarity), "plausible")
        if pairs.limit(1).count():
            sets = ws.table(shingle_sets(docs, rows, pairs, id_col, text_col).dropDuplicates(["rid"]), "sets")
            found = ws.table(verified(pairs, sets, similarity).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")
            ws.drop(sets)
            roots = ws.table(components(found, ws), "roots")
        from_ = to
    return rows.join(roots, F.col("rid") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("root", "rid").alias("root"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component (see similar_components) the row with the smallest id stays (a null id last; of rows with one id, by a hash of the text). Columns and values stay as they are, whatever their names."""
    ws = Workspace(docs.sparkSession, "near-copies")
    own, doc_id, text = numbered(docs, id_col, text_col)
    rows = ws.table(similar_components(own, similarity, doc_id, text), "components")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("digest").alias("c"))).alias("best"))
    best = best.select(F.col("best.b").alias("best_id"), F.col("best.c").alias("best_digest"))
    gone = ws.table(rows.select("doc_id", "digest").join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("digest") == F.col("best_digest")), "left_anti"), "gone")
    again = rows.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    own = own.withColumn("own_digest", F.xxhash64(F.col(text)))
    out = own.join(gone, F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("own_digest") == F.col("digest")), "left_anti")
    return named_as(out.dropDuplicates([doc_id, "own_digest"]) if again else out, docs)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
