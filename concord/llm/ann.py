"""Approximate nearest neighbours (operator 1): hierarchical k-means tree, best-bin-first search, calibrated recall.

Nearness is the inner product. Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the
largest inner product is the smallest distance, and the tree's k-means works on those. The tree is fitted on a bounded
sample (SAMPLE distinct vectors, by hash order of their ids); every row is indexed.

A query pops tree nodes from a priority queue; a node's priority is the inner product with its centre plus SPREAD of its
radius, times the query's norm. Search has two rounds:

1. Every query visits its FIRST best leaves. Its (k + 1)-th best score there is a lower bound of what it looks for.
2. It goes on popping nodes until the priority falls to its bound less a slack, and only scores at or above the bound
   leave a task, so that widening loses nothing and a query gives some dozens of rows, however many leaves it visits.

So a query in a dense part visits few leaves and one in an empty part many. The slack is calibrated: CALIBRATION queries
are answered exactly against all rows, in blocks, and the slack is widened until their mean recall is TARGET.

Equal vectors are one point that carries its k + 1 smallest ids, which is all that an answer can need. Neighbouring
leaves are gathered into blocks of about BLOCK points, larger leaves are dealt into several, and the queries of a block
are dealt into groups of about GROUP, so no task holds an unbounded leaf or an unbounded set of queries.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id; repeated rows count once; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import table, written

SAMPLE, CALIBRATION, TARGET = 20_000, 100, 0.95
FANOUT, LEAF, MAX_LEAVES, FIRST, SPREAD = 16, 64, 4096, 16, 0.2
BLOCK, GROUP = 4000, 20_000
ANSWER = "query_id long, rank int, vec_id long, score double"


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v: the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def points(rows: DataFrame, k: int) -> DataFrame:
    """key, v, ids: distinct vectors with their k + 1 smallest ids; key is the smallest."""
    few = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("key"), "v", "ids")


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def _node(center: np.ndarray, x: np.ndarray) -> dict:
    radius = float(np.sqrt(((x - center) ** 2).sum(1).mean())) if len(x) else 0.0
    return {"center": center, "radius": radius, "children": [], "leaf": -1}


def fit(x: np.ndarray, leaves: int) -> list[dict]:
    """Tree as a list of nodes: center, radius, children (node numbers), leaf (number, or -1), numbered so that
    neighbouring leaves have neighbouring numbers. Each split takes the largest part."""
    rng, nodes = np.random.default_rng(7), [_node(x.mean(0), x)]
    parts = [(-len(x), 0, np.arange(len(x)))]
    done = 1
    while parts and done < leaves:
        size, at, rows = heapq.heappop(parts)
        k = min(FANOUT, -size // 2, leaves - done + 1)
        if k < 2:
            continue
        c = _kmeans(x[rows], k, rng)
        near = _nearest(x[rows], c)
        if len(np.unique(near)) < 2:
            continue
        done += k - 1
        for j in range(k):
            own = rows[near == j]
            nodes[at]["children"].append(len(nodes))
            if len(own):
                heapq.heappush(parts, (-len(own), len(nodes), own))
            nodes.append(_node(c[j], x[own]))
    number, todo = 0, [0]
    while todo:
        node = nodes[todo.pop()]
        if node["children"]:
            kids = [nodes[j] for j in node["children"]]
            node["centers"], node["radii"] = np.stack([n["center"] for n in kids]), np.array([n["radius"] for n in kids])
            todo += reversed(node["children"])
        else:
            node["leaf"], number = number, number + 1
    return nodes


def leaf_of(x: np.ndarray, nodes: list[dict]) -> np.ndarray:
    """The leaf that each (lengthened) row of x goes down to."""
    out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        kids = nodes[at]["children"]
        if not kids:
            out[rows] = nodes[at]["leaf"]
            continue
        near = _nearest(x[rows], nodes[at]["centers"])
        todo += [(j, rows[near == i]) for i, j in enumerate(kids) if (near == i).any()]
    return out


def visits(q: np.ndarray, nodes: list[dict], most: int | None = None, least: float = -np.inf) -> list[tuple[int, float]]:
    """The best-bin-first walk of one query: leaves in the order in which they are popped, with the lowest priority on
    the way; at most ``most`` of them, and none below ``least``."""
    q, norm = np.r_[q, 0.0], float(np.sqrt(q @ q))
    queue, out, lowest = [(-np.inf, 0)], [], np.inf
    while queue and (most is None or len(out) < most):
        minus, at = heapq.heappop(queue)
        lowest = min(lowest, -minus)
        if lowest < least:
            break
        node = nodes[at]
        if node["children"]:
            for j, p in zip(node["children"], node["centers"] @ q + SPREAD * norm * node["radii"], strict=True):
                heapq.heappush(queue, (-p, j))
        else:
            out.append((node["leaf"], lowest))
    return out


def _longer(x: np.ndarray, norm: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(1)))]


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _top(q: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each q: largest scores, ties to smaller keys."""
    order = np.lexsort((key, -score, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k]


@dataclass
class Index:
    """A fitted tree over all points. ``blocks``: of each leaf its first block and the number of its blocks."""

    points: DataFrame  # leaf, key, v, ids
    nodes: list[dict]
    norm: float
    blocks: list[tuple[int, int]]
    sizes: list[int]


def build(pts: DataFrame) -> Index | None:
    """The tree over ``pts`` (key, v, ids; written), or None without a point."""
    stats = pts.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not stats["n"]:
        return None
    norm = float(np.sqrt(stats["m"]))
    sample = pts.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows at most
    nodes = fit(_longer(_matrix(sample["v"]), norm), int(min(MAX_LEAVES, max(1, stats["n"] // LEAF))))
    shared = pts.sparkSession.sparkContext.broadcast((nodes, norm))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, m = shared.value
        for batch in batches:
            leaf = leaf_of(_longer(_matrix(batch.column("v")), m), tree) if len(batch) else []
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns], ["leaf", *batch.schema.names])

    leaves = written(pts.select("key", "v", "ids").mapInArrow(placed, "leaf long, key long, v array<double>, ids array<long>"), "ann")
    sizes = [0] * sum(n["leaf"] >= 0 for n in nodes)
    for r in leaves.groupBy("leaf").count().collect():  # a row for each leaf: MAX_LEAVES at most
        sizes[r["leaf"]] = r["count"]
    blocks, at, filled = [], 0, 0
    for size in sizes:
        if filled and filled + size > BLOCK:
            at, filled = at + 1, 0
        blocks.append((at, max(1, -(-size // BLOCK))))
        at, filled = at + blocks[-1][1] - 1, filled + size if size <= BLOCK else BLOCK
    return Index(leaves, nodes, norm, blocks, sizes)


def _search(index: Index, asked: DataFrame, k: int, n_queries: int, slack: float | None) -> DataFrame:
    """q, score, ids of candidate points of ``asked`` (q, v, bound): in the first round (slack None) of the FIRST best
    leaves, in the second of the others down to bound - slack; at most k + 1 a query and block, none below the bound."""
    spark = index.points.sparkSession
    shared = spark.sparkContext.broadcast((index.nodes, index.blocks))
    groups = max(1, -(-n_queries // GROUP))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, blocks = shared.value
        for batch in batches:
            by_block = []
            for x, bound in zip(_matrix(batch.column("v")), batch.column("bound").to_pylist(), strict=True):
                found = visits(x, tree, FIRST) if slack is None else visits(x, tree, least=bound - slack)[FIRST:]
                mine: dict[int, list[int]] = {}
                for leaf, _ in found:
                    for b in range(blocks[leaf][0], blocks[leaf][0] + blocks[leaf][1]):
                        mine.setdefault(b, []).append(leaf)
                by_block.append([{"block": b, "leaves": leaves} for b, leaves in mine.items()])
            kind = pa.list_(pa.struct([("block", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
            columns = [batch.column("q"), batch.column("v"), batch.column("bound"), pa.array(by_block, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["q", "v", "bound", "at"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blocks = shared.value
        first, number = np.array([b for b, _ in blocks]), np.array([n for _, n in blocks])
        for batch in batches:
            leaf, key = np.asarray(batch.column("leaf")), np.asarray(batch.column("key"))
            block = first[leaf] + ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % number[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if len(left) and len(right):
            x, leaf, key = _matrix(left["v"]), left["leaf"].to_numpy(), left["key"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            names, begin = np.unique(leaf[order], return_index=True)
            rows_of = dict(zip(names.tolist(), np.split(order, begin[1:]), strict=True))
            queries, q, bound = _matrix(right["v"]), right["q"].to_numpy(), right["bound"].to_numpy()
            lists = right["leaves"].combine_chunks()
            asks = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            wanted = lists.flatten().to_numpy()
            order = np.argsort(wanted, kind="stable")
            names, begin = np.unique(wanted[order], return_index=True)
            for name, some in zip(names.tolist(), np.split(asks[order], begin[1:]), strict=True):
                rows = rows_of.get(name)
                if rows is not None:
                    s = queries[some] @ x[rows].T
                    i, j = np.nonzero(s >= bound[some][:, None])
                    got.append((some[i], rows[j], s[i, j]))
        if not got:
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        i, j, s = (np.concatenate(c) for c in zip(*got, strict=True))
        best = _top(i, s, key[j], k + 1)
        ids = left["ids"].combine_chunks().take(pa.array(j[best]))
        return pa.table({"q": q[i[best]], "score": s[best], "ids": ids})

    split = F.array(*(F.lit(g) for g in range(groups))) if groups < 100 else F.sequence(F.lit(0), F.lit(groups - 1))
    left = index.points.mapInArrow(dealt, "block long, leaf long, key long, v array<double>, ids array<long>").withColumn("part", F.explode(split))
    right = asked.select("q", "v", "bound").mapInArrow(walked, "q long, v array<double>, bound double, at array<struct<block:bigint,leaves:array<bigint>>>")
    right = right.select("q", "v", "bound", F.explode("at").alias("at"), F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("part"))
    right = right.select("q", "v", "bound", "at.block", "at.leaves", "part")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(scored, "q long, score double, ids array<long>")


def _exact(index: Index, trial: pa.Table, k: int) -> pa.Table:
    """q, score, key, leaf: the k nearest other points of a bounded set of queries (q, v), by blocks of all points."""
    shared = index.points.sparkSession.sparkContext.broadcast((_matrix(trial["v"]), trial["q"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = shared.value
        for batch in batches:
            key, leaf = np.asarray(batch.column("key")), np.asarray(batch.column("leaf"))
            if not len(key):
                continue
            s = queries @ _matrix(batch.column("v")).T
            s[q[:, None] == key[None]] = -np.inf
            most = min(k, len(key))
            cut = np.partition(s, len(key) - most, axis=1)[:, len(key) - most]
            i, j = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
            best = _top(i, s[i, j], key[j], k)
            i, j = i[best], j[best]
            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(s[i, j]), pa.array(key[j]), pa.array(leaf[j])], ["q", "score", "key", "leaf"])

    found = index.points.select("key", "v", "leaf").mapInArrow(run, "q long, score double, key long, leaf long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").toArrow()  # CALIBRATION x k rows


def calibrate(index: Index, trial: pa.Table, k: int, target: float) -> dict:
    """The slack at which the queries of ``trial`` (q, v, bound) find ``target`` of their k nearest points; with the recall
    and the shares of leaves and points that it takes."""
    exact = _exact(index, trial, k)
    need, walks = [], {}
    q, leaf = exact["q"].to_numpy(), exact["leaf"].to_numpy()
    for key, v, bound in zip(trial["q"].to_pylist(), _matrix(trial["v"]), trial["bound"].to_pylist(), strict=True):
        walk = visits(v, index.nodes)
        walks[key] = [(at, bound - p) for at, p in walk]
        cost = {at: -np.inf if i < FIRST else bound - p for i, (at, p) in enumerate(walk)}
        need += [cost[at] for at in leaf[q == key]]
    if not need:
        return {"slack": 0.0, "recall": 1.0, "leaves": 1.0, "points": 1.0}
    slack = max(0.0, float(np.sort(need)[max(0, int(np.ceil(target * len(need))) - 1)])) + 1e-9
    seen = [[at for i, (at, cost) in enumerate(walk) if i < FIRST or cost <= slack] for walk in walks.values()]
    total, n = len(index.sizes), sum(index.sizes)
    return {
        "slack": slack,
        "recall": float(np.mean(np.array(need) <= slack)),
        "leaves": float(np.mean([len(s) / total for s in seen])),
        "points": float(np.mean([sum(index.sizes[at] for at in s) / n for s in seen])),
    }


def neighbours(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (a condition on vec_id), its k nearest other rows.

    ``report`` gets what calibration measured."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    pts = written(points(rows, k), "ann")
    asked = written(rows.where(is_query).distinct().join(pts.select("key", "v"), "v").select("vec_id", "key"), "ann")
    index = build(pts)
    wanted = asked.select(F.col("key").alias("q")).distinct()
    n_queries = wanted.count() if index else 0
    if not n_queries:
        return spark.createDataFrame([], ANSWER)
    wanted = written(wanted.join(pts.select(F.col("key").alias("q"), "v"), "q").withColumn("bound", F.lit(float("-inf"))), "ann")

    first = written(_search(index, wanted, k, n_queries, None), "ann")
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
    bounds = ranked.where(F.col("_r") == k + 1).select("q", F.col("score").alias("b"))
    bounded = written(wanted.join(bounds, "q", "left").select("q", "v", F.coalesce("b", "bound").alias("bound")), "ann")
    trial = bounded.orderBy(F.xxhash64(F.col("q") + 1), "q").limit(CALIBRATION).toArrow()
    measured = calibrate(index, trial, k, target)
    if report is not None:
        report |= measured | {"points_indexed": sum(index.sizes), "queries": n_queries, "tree_leaves": len(index.sizes)}

    found = first.unionByName(_search(index, bounded, k, n_queries, measured["slack"]))
    flat = found.select("q", "score", F.explode("ids").alias("id"))
    best = flat.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= k + 1)
    lists = written(best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("near")), "ann")
    near = F.slice(F.filter("near", lambda p: p["id"] != F.col("vec_id")), 1, k)
    own = asked.join(lists, F.col("key") == F.col("q")).select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("at", "p"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.minus")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op1_ann": query}
ORACLES: dict[str, str] = {}
