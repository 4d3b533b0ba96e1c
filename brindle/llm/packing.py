"""Best-fit packing of documents into sequences, after dominance reduction.

Only the lengths of pieces matter for packing, and a piece has 1 to `capacity` tokens: an instance
of any size is a table of `capacity` counts. That table alone goes to the driver. There the
Martello-Toth reduction fixes small sets for good, whole classes of equal pieces at a time: a set F
with an item j dominates if whatever feasible set holds j, its other items can be assigned to items
of F at least as long. What is left is packed by best fit, longest first, in the same bulk way.

The outcome is a list of patterns with multiplicities. The r-th piece of a length takes the r-th
place that the patterns have for that length; ranks come from counters of the tokenizing tasks
plus the counts of the tasks before, so all pieces of one length, be they a third of all, are
numbered where they were made.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.tokens import coder
from brindle.llm.work import Workspace, table

CAPACITY = 1024
END_ID = 2
#: Characters that a worker codes at a time (one text may be longer).
STEP_CHARS = 500_000


def _fits(counts: list[int], least: int, most: int) -> int:
    """The longest length with a piece in [least, most], or 0."""
    for s in range(most, least - 1, -1):
        if counts[s]:
            return s
    return 0


def _smallest(counts: list[int], want: int) -> list[int]:
    out: list[int] = []
    for s in range(1, len(counts)):
        out += [s] * min(counts[s], want - len(out))
        if len(out) == want:
            break
    return out


def _dominating(counts: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other feasible set with j, by the cases that can be proved at once; None if none does.

    Alone: nothing else fits. Exact pair: the other item leaves no room, so it is at least as long
    as whatever else would fill it. Pair: no two others fit, so the longest that fits is best.
    Triple: no three others fit, the longest that fits takes the place of the longer of any two, and
    the longest that fits beside it that of the shorter.
    """
    room = capacity - j
    counts[j] -= 1
    try:
        low = _smallest(counts, 3)
        if not low or low[0] > room:
            return (j,)
        if counts[room]:
            return (j, room)
        one = _fits(counts, 1, room)
        if len(low) < 2 or low[0] + low[1] > room:
            return (j, one)
        if len(low) < 3 or sum(low) > room:
            counts[one] -= 1
            two = _fits(counts, 1, room - one)
            counts[one] += 1
            if two:
                shorter = 0
                for q in range(room // 2, 0, -1):
                    if counts[q]:
                        counts[q] -= 1
                        longer = _fits(counts, q, room - q)
                        counts[q] += 1
                        if longer:
                            shorter = q
                            break
                if shorter <= two:
                    return (j, one, two)
        return None
    finally:
        counts[j] += 1


def reduce_instance(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take dominating sets out of counts (changed in place) until no length has one; the sets and how many of each."""
    fixed = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                found = _dominating(counts, j, capacity)
                if not found:
                    break
                need: dict[int, int] = defaultdict(int)
                for s in found:
                    need[s] += 1
                times = min(counts[s] // k for s, k in need.items())
                for s, k in need.items():
                    counts[s] -= k * times
                fixed.append((found, times))
                again = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the pieces in counts, longest first: patterns and how many bins of each."""
    open_bins: list[list] = [[] for _ in range(capacity + 1)]  # by room left: [pattern, bins]
    for s in range(capacity, 0, -1):
        n = counts[s]
        while n:
            room = next((r for r in range(s, capacity + 1) if open_bins[r]), 0)
            if room:
                pattern, bins = open_bins[room].pop()
            else:
                pattern, bins, room = (), n, capacity
            each = room // s  # best fit keeps to a bin until it is full
            many = min(bins, n // each)
            if many:
                open_bins[room - each * s].append([pattern + (s,) * each, many])
                n -= many * each
                bins -= many
            if bins and 0 < n < each:
                open_bins[room - n * s].append([pattern + (s,) * n, 1])
                n = 0
                bins -= 1
            if bins and pattern:
                open_bins[room].append([pattern, bins])
    return [(p, k) for group in open_bins for p, k in group]


def patterns(counts: list[int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences have each, for counts[s] pieces of length s."""
    counts = list(counts)
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """part, doc_id, piece, start, length, ids_crc32, nth (place among the task's pieces of that length)."""
    kind = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("part", pa.int32()), ("doc_id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])

    def run(batches):
        code, part, seen = coder(tokenizer, end_id), TaskContext.get().partitionId(), [0] * (capacity + 1)

        def pieces(texts, ids):
            flat, counts = code.encode(texts)
            raw, at = memoryview(flat).cast("B"), 0
            out = [[] for _ in range(6)]
            for i, n in zip(ids, counts.tolist()):
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)])
                    for column, v in zip(out, (i, piece, start, length, crc, seen[length])):
                        column.append(v)
                    seen[length] += 1
                    start += length
                    piece += 1
                at += n
            return pa.RecordBatch.from_arrays([pa.array([part] * len(out[0]), pa.int32()), *(pa.array(c, t.type) for c, t in zip(out, list(schema)[1:]))], schema=schema)

        for b in batches:
            texts, ids, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                texts.append(t)
                ids.append(i)
                size += len(t)
                if size >= STEP_CHARS:
                    yield pieces(texts, ids)
                    texts, ids, size = [], [], 0
            if texts:
                yield pieces(texts, ids)

    of = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"part int, doc_id {of}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids (a null text counts as empty) and the end id. Only documents longer than the
    capacity are cut: all their pieces are full but the first, which holds what is left over.
    Repeated rows and null ids are documents like any other; other columns are ignored; an empty
    table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.table(token_pieces(docs, str(tokenizer), capacity, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    bases = ws.table(by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "bases")
    counts = [0] * (capacity + 1)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length, capacity at most
        counts[r["length"]] = r["n"]
    places: dict[int, list] = defaultdict(list)
    used, sequence = [0] * (capacity + 1), 0
    for pattern, many in patterns(counts, capacity):
        offset = 0
        for s in pattern:
            places[s].append((used[s], sequence, offset))
            used[s] += many
            offset += s
        sequence += many
    tables = {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in places.items()}
    of = docs.schema[id_col].dataType.simpleString()

    def place(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                mine = length == s
                first, base, off = tables[s]
                slot = np.searchsorted(first, rank[mine], "right") - 1
                where[mine], offset[mine] = base[slot] + rank[mine] - first[slot], off[slot]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases.select("part", "length", "base"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {of}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
