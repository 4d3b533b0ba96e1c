"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy graph search answers queries.

The graph has each distinct vector as a node; rows with equal vectors are members of one node, so a
group of copies neither crowds neighbour lists nor loses anybody: a node's smallest ids are put
back into answers, as many as an answer can hold. Vectors of each length have a graph of their own.

Start: nodes fall into cells by the signs of random projections, several times over; crowded cells
are split at random, and within a cell all are compared. Rounds: every node introduces its
neighbours and the nodes it is a neighbour of to each other, if one of the two is new; each
node keeps the best. A list of nodes that have a hub for neighbour is sampled to its bound, first
within parts of the list, so that no task gets a hub's whole list. The rounds stop when few lists
change. Graph vectors are in half precision; answers are ranked on the original vectors in double.

Search: a query starts at its own node and opens the best unopened nodes of its beam, round by
round, until the whole beam is open.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.work import Workspace, partitions, table

K = 5
QUERY_EVERY = 50
#: Neighbours of a node in the graph, and most reverse neighbours it is introduced with.
DEGREE = 24
#: Random partitions to start from, and nodes a cell is meant to hold.
PARTITIONS = 6
CELL = 128
#: Candidates that a meeting proposes to each node.
PROPOSE = 8
MOST_ROUNDS = 8
#: The rounds stop when fewer than this share of all neighbours are new.
STILL = 0.02
BEAM = 160
SEED = 31
#: Parts into which a hub's list is split before it is cut to its bound.
SALTS = 64


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest s for each a, each b once."""
    order = np.lexsort((b, a))
    a1, b1 = a[order], b[order]
    order = order[np.concatenate([[True], (a1[1:] != a1[:-1]) | (b1[1:] != b1[:-1])])] if len(order) else order
    order = order[np.lexsort((b[order], -s[order], a[order]))]
    a1 = a[order]
    first = np.flatnonzero(np.concatenate([[True], a1[1:] != a1[:-1]])) if len(a1) else np.zeros(0, int)
    rank = np.arange(len(a1)) - np.repeat(first, np.diff(np.append(first, len(a1))))
    return order[rank < k]


def _top(rows: DataFrame, key: str, order, k: int) -> DataFrame:
    """The first k rows of each key in an order, cut within parts of a key first."""
    part = Window.partitionBy(key, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).orderBy(*order)
    some = rows.withColumn("__r", F.row_number().over(part)).where(f"__r <= {k}")
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(f"__r <= {k}").drop("__r")


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).astype(np.float32)


def _by_key(batches, key: str):
    """Whole groups of a sorted input: batches in which no key goes on in the next."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b[key].to_numpy()
        held.append(b)
        if k[-1] == held[0][key][0].as_py():
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))
        whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)]).combine_chunks().to_batches()
        held = [b.slice(cut)]
        yield from whole[:1]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()[:1]


def _spans(k: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(k[1:] != k[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(k)]))


def _compare(batches, key: str, fresh: bool, propose: int, degree: int):
    """Within each group, all nodes against all (only pairs with a new one, if fresh is looked at): node, nbr, sim."""
    for b in _by_key(batches, key):
        node = b["node"].to_numpy()
        vec = _vectors(b["vec"]).reshape(len(node), -1)
        new = b["fresh"].to_numpy(zero_copy_only=False) if fresh else None
        out = []
        for lo, hi in _spans(b[key].to_numpy()):
            m = hi - lo
            if m < 2:
                continue
            sims = vec[lo:hi] @ vec[lo:hi].T
            np.fill_diagonal(sims, -np.inf)
            sims[node[lo:hi, None] == node[None, lo:hi]] = -np.inf
            if fresh:
                sims[~(new[lo:hi, None] | new[None, lo:hi])] = -np.inf
            k = min(propose, m - 1)
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(sims, near, 1)
            ok = np.isfinite(s)
            out.append((np.repeat(node[lo:hi], k).reshape(m, k)[ok], node[lo:hi][near][ok], s[ok]))
        if out:
            a, c, s = (np.concatenate(x) for x in zip(*out))
            keep = _best(a, c, s, degree)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep]), pa.array(s[keep].astype(np.float32))], names=["node", "nbr", "sim"])


_PAIRS = "node bigint, nbr bigint, sim float"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """rid (one for each row), vec_id, vector: the rows with an id and a usable vector: not null or zero, without null or non-finite components. Rows that repeat an id are rows of their own."""
    v = F.col(vector_col).cast("array<double>")
    good = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    return good.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))


class Graph:
    """Of vectors of one length. nodes: node, low (its smallest id), vector, vec (half-precision unit vector). ids: rid, vec_id, node. members: the rows of ids with the smallest ids of each node. links: node, nbr, sim."""

    def __init__(self, ws: Workspace, nodes: DataFrame, members: DataFrame, ids: DataFrame, links: DataFrame):
        self.ws, self.nodes, self.members, self.ids, self.links = ws, nodes, members, ids, links


def _halves(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            v = np.array(b["vector"].to_pylist(), np.float64).reshape(b.num_rows, -1)
            v = v / np.abs(v).max(1, keepdims=True) if b.num_rows else v
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float16) if b.num_rows else v
            yield pa.RecordBatch.from_arrays([b["node"], b["low"], b["vector"], pa.array([x.tobytes() for x in v], pa.binary())], names=["node", "low", "vector", "vec"])

    return rows.select("node", "low", "vector").mapInArrow(run, f"node bigint, low bigint, vector {rows.schema['vector'].dataType.simpleString()}, vec binary")


def _start(nodes: DataFrame, n_nodes: int, degree: int, seed: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1, n_nodes / CELL)))))
    planes = np.random.default_rng(seed)
    seeds = [int(x) for x in planes.integers(0, 1 << 31, PARTITIONS)]

    def codes(batches):
        for b in batches:
            vec = _vectors(b["vec"]).reshape(b.num_rows, -1)
            for t, s in enumerate(seeds):
                h = np.random.default_rng(s).standard_normal((vec.shape[1], bits)).astype(np.float32)
                code = ((vec @ h > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b["node"], b["vec"], pa.array(code * PARTITIONS + t)], names=["node", "vec", "cell"])

    cells = nodes.select("node", "vec").mapInArrow(codes, "node bigint, vec binary, cell bigint")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).withColumnRenamed("cell", "c")
    split = cells.join(sizes, F.col("cell") == F.col("c")).withColumn("key", F.xxhash64("cell", F.pmod(F.xxhash64("node", "cell"), F.expr(f"(size + {2 * CELL - 1}) div {2 * CELL}"))))
    groups = split.select("key", "node", "vec").repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return groups.mapInArrow(lambda it: _compare(it, "key", False, degree, degree), _PAIRS)


def _merged(links: DataFrame | None, proposed: DataFrame, degree: int) -> DataFrame:
    """node, nbr, sim, fresh: the best of old and proposed neighbours."""
    both = proposed.select("node", "nbr", "sim", F.lit(True).alias("fresh"))
    if links is not None:
        both = both.unionByName(links.select("node", "nbr", "sim", F.lit(False).alias("fresh")))
    each = both.repartition(partitions(proposed.sparkSession), "node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return each.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))).where(f"r <= {degree}").drop("r")


def _lists(links: DataFrame, degree: int, salt: int) -> DataFrame:
    """center, node, fresh: each node's neighbours, and some of the nodes that have it for neighbour."""
    back = _top(links.select(F.col("nbr").alias("center"), "node", "fresh"), "center", [F.xxhash64(F.lit(salt), "node"), "node"], degree)
    return links.select(F.col("node").alias("center"), F.col("nbr").alias("node"), "fresh").unionByName(back).groupBy("center", "node").agg(F.max("fresh").alias("fresh"))


def build_graphs(rows: DataFrame, degree: int = DEGREE, k: int = K, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> list[Graph]:
    """A neighbour graph of the usable rows (see usable) of each length that vectors have, short ones first; at least one, which may be empty. Vectors of two lengths have no cosine."""
    ws = Workspace(rows.sparkSession, "nn-descent")
    ids = ws.table(usable(rows, id_col, vector_col), "usable")
    lengths = sorted(r[0] for r in ids.select(F.size("vector")).distinct().collect())  # a number for each kind of vector
    return [_graph(ws, ids.where(F.size("vector") == n), degree, k, seed) for n in lengths or [0]]


def _graph(ws: Workspace, ids: DataFrame, degree: int, k: int, seed: int) -> Graph:
    spark = ws.spark
    firsts = ids.groupBy("vector").agg(F.min("rid").alias("node"), F.min("vec_id").alias("low"))
    nodes = ws.table(_halves(firsts), "nodes")
    ids = ws.table(ids.join(nodes.select("vector", "node"), "vector").select("rid", "vec_id", "node"), "ids")
    members = ws.table(_top(ids, "node", ["vec_id", "rid"], k + 1), "members")
    n_nodes = nodes.count()
    links = ws.table(_merged(None, ws.table(_start(nodes, n_nodes, degree, seed), "start"), degree), "links")
    vecs = nodes.select(F.col("node").alias("v"), "vec")
    for step in range(MOST_ROUNDS):
        lists = ws.table(_lists(links, degree, seed + step), "lists")
        met = lists.join(vecs, F.col("node") == F.col("v")).select("center", "node", "fresh", "vec")
        met = met.repartition(partitions(spark), "center").sortWithinPartitions("center")
        proposed = ws.table(met.mapInArrow(lambda it: _compare(it, "center", True, PROPOSE, degree), _PAIRS), "proposed")
        new = ws.table(_merged(links, proposed, degree), "links")
        for old in (lists, proposed, links):
            ws.drop(old)
        links = new
        if links.where("fresh").count() <= STILL * n_nodes * degree:
            break
    return Graph(ws, nodes, members, ids, links)


def search(graph: Graph, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for each query_id in queries that the graph has.

    A query starts from the node of its row; its own row is no answer, others with its id may be. An id that several rows have is a query for each of them, with ranks from 1 for each.
    The search ends when no beam has an unopened node: a beam only gets nearer, so no node comes twice.
    """
    ws, spark = graph.ws, graph.ws.spark
    n = partitions(spark)
    vecs = graph.nodes.select(F.col("node").alias("v"), "vec")
    lists = ws.table(_lists(graph.links.withColumn("fresh", F.lit(True)), 2 * DEGREE, SEED).select("center", "node"), "adjacency")
    starts = ws.table(queries.select("query_id").distinct().join(graph.ids, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("rid").alias("query_rid"), F.col("node").alias("own")), "starts")
    # one search for each node that has queries
    state = ws.table(starts.select("own").distinct().select("own", F.col("own").alias("node"), F.lit(1.0).cast("float").alias("sim"), F.lit(False).alias("opened")), "beam")

    def hop(batches):
        for b in _by_key(batches, "own"):
            node, kind = b["node"].to_numpy(), b["kind"].to_numpy()
            sim, opened = b["sim"].to_numpy(zero_copy_only=False).copy(), b["opened"].to_numpy(zero_copy_only=False)
            own = b["own"].to_numpy()
            out = []
            vec = b["vec"]
            for lo, hi in _spans(own):
                kinds = kind[lo:hi]
                q = np.flatnonzero(kinds == 0)
                c = np.flatnonzero(kinds == 2)
                if len(c) and len(q):
                    query = _vectors(vec.slice(lo + int(q[0]), 1))
                    sim[lo + c] = (_vectors(vec.take(pa.array(lo + c))).reshape(len(c), -1) * query).sum(1)  # the same sum whatever stands beside it
                held = np.flatnonzero(kinds > 0) + lo
                order = held[np.lexsort((node[held], ~opened[held].astype(bool)))]  # what was opened stays so
                order = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
                order = order[np.lexsort((node[order], -sim[order]))][:beam]
                out.append(order)
            keep = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(node[keep]), pa.array(sim[keep].astype(np.float32)), pa.array(opened[keep].astype(bool))], names=["own", "node", "sim", "opened"])

    none = F.lit(None)
    own_vec = ws.table(state.join(vecs, F.col("own") == F.col("v")).select("own", F.lit(0).alias("kind"), F.col("own").alias("node"), none.cast("float").alias("sim"), F.lit(False).alias("opened"), "vec"), "query-vectors")
    while True:
        frontier = state.where("not opened").select("own", F.col("node").alias("center"))
        found = frontier.join(lists, "center").select("own", "node").distinct().join(state.select("own", "node"), ["own", "node"], "left_anti")
        found = found.join(vecs, F.col("node") == F.col("v")).select("own", F.lit(2).alias("kind"), "node", none.cast("float").alias("sim"), F.lit(False).alias("opened"), "vec")
        held = state.select("own", F.lit(1).alias("kind"), "node", "sim", F.lit(True).alias("opened"), none.cast("binary").alias("vec"))
        all_rows = own_vec.unionByName(held).unionByName(found).repartition(n, "own").sortWithinPartitions("own")
        new = ws.table(all_rows.mapInArrow(hop, "own bigint, node bigint, sim float, opened boolean"), "beam")
        ws.drop(state)
        state = new
        if not state.where("not opened").limit(1).count():
            break

    exact = state.join(graph.nodes.select("node", "low", F.col("vector").alias("cv")), "node").join(graph.nodes.select(F.col("node").alias("own"), F.col("vector").alias("qv")), "own")

    def score(batches):
        for b in batches:
            q, c = (np.array(b[x].to_pylist(), np.float64).reshape(b.num_rows, -1) for x in ("qv", "cv"))
            s = np.einsum("ij,ij->i", q, c) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", c, c)))
            yield pa.RecordBatch.from_arrays([b["own"], b["node"], b["low"], pa.array(s)], names=["own", "node", "low", "score"])

    exact = exact.select("own", "node", "low", "qv", "cv").mapInArrow(score, "own bigint, node bigint, low bigint, score double")
    best = exact.withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "low", "node"))).where(f"r <= {k + 1}").drop("r")
    best = ws.table(best.join(graph.members, "node").select("own", "rid", "vec_id", "score").withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "rid"))).where(f"r <= {k + 1}").drop("r"), "best")
    answers = starts.join(best, "own").where("rid <> query_rid")
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(f"rank <= {k}")


def nearest(rows: DataFrame, every: int = QUERY_EVERY, k: int = K, beam: int = BEAM, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable row whose id is divisible by ``every``, among all rows of its length. Further columns are ignored; an empty table gives an empty result."""
    found = [search(g, g.ids.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")), k, beam) for g in build_graphs(rows, k=k, **options)]
    return reduce(DataFrame.unionByName, found)


def op7_nn_descent(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
