"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node's direction joins two of its vectors, its threshold is the median projection. Every
vector then falls into one leaf of each tree. A query goes through all trees with one priority queue: the branch whose
worst margin is best is next, whichever tree it is in, until the leaves it has come to hold a budget of vectors. Leaf
candidates are ranked by exact cosine. The budget comes from an audit: the true neighbours of some queries, found by
brute force over all vectors, say how far the queue must go to meet the target recall.

Vectors and queries meet by cell, a branch of a tree that holds about ``block_rows`` vectors: a vector goes there once for each tree, a query once
with the list of the cell's leaves that it has come to, and only vectors of those leaves are its candidates. A cell that holds many vectors
or queries is cut into blocks, each pair of blocks a piece of work. Vectors of different lengths have trees of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logweir.llm.common import Batches, batch, runs, stored
from logweir.llm.vectors import cosine, matrix, unit, usable


@dataclass(frozen=True)
class Plan:
    neighbours: int = 5
    trees: int = 8
    leaf_rows: int = 100
    sample_rows: int = 20_000
    audit_queries: int = 64
    recall: float = 0.95
    block_rows: int = 8_192
    block_queries: int = 2_048
    few_rows: int = 2_048  # vectors of a length that so few have are compared with all of them
    seed: int = 3


@dataclass
class Trees:
    """Complete binary trees in heap order: directions (tree, node, dimension) and thresholds (tree, node)."""

    depth: int
    directions: np.ndarray
    thresholds: np.ndarray

    def leaves(self, m: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each row in each tree."""
        trees = len(self.directions)
        node = np.zeros((len(m), trees), np.int64)
        for _ in range(self.depth):
            for t in range(trees):
                side = np.einsum("ij,ij->i", m, self.directions[t, node[:, t]]) > self.thresholds[t, node[:, t]]
                node[:, t] = 2 * node[:, t] + 1 + side
        return node - ((1 << self.depth) - 1)

    def visit(self, q: np.ndarray, rows: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of the shared queue, until they hold ``budget`` of the ``rows`` by tree and leaf."""
        margins = self.directions @ q - self.thresholds if self.depth else None
        first = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(len(rows))]
        out, held = [], 0
        while queue and held < budget:
            worst, t, node = heapq.heappop(queue)
            while node < first:
                m = margins[t, node]
                other = 2 * node + 1 + int(m <= 0)
                heapq.heappush(queue, (max(worst, abs(float(m))), t, other))
                node = 2 * node + 1 + int(m > 0)
            if rows[t, node - first]:
                out.append((t, node - first))
                held += int(rows[t, node - first])
        return out


def fit(sample: np.ndarray, rows: int, plan: Plan) -> Trees:
    """Trees of a depth for ``rows`` vectors, as deep as the sample can tell."""
    most = max(0, int(np.log2(max(1, len(sample) / 8))))
    depth = min(most, max(0, int(np.ceil(np.log2(max(1, rows / plan.leaf_rows))))))
    rng, inner = np.random.default_rng(plan.seed), (1 << depth) - 1
    dim = sample.shape[1] if len(sample) else 0
    directions, thresholds = np.zeros((plan.trees, inner, dim)), np.zeros((plan.trees, inner))
    for t in range(plan.trees):
        own = {0: np.arange(len(sample))}
        for node in range(inner):
            mine = own.pop(node)
            if len(mine) >= 2:
                a, b = rng.choice(mine, 2, replace=False)
                direction = sample[a] - sample[b]
            else:
                direction = np.zeros(dim)
            length = np.sqrt(direction @ direction)
            directions[t, node] = direction / length if length > 0 else rng.standard_normal(dim) / np.sqrt(dim)
            projected = sample[mine] @ directions[t, node]
            thresholds[t, node] = np.median(projected) if len(mine) else 0.0
            side = projected > thresholds[t, node]
            own[2 * node + 1], own[2 * node + 2] = mine[~side], mine[side]
    return Trees(depth, directions, thresholds)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _audit(vectors: DataFrame, queries: list[tuple[int, list[float]]], plan: Plan) -> DataFrame:
    """The true neighbours of a few queries: each task's best, then the best of those."""
    ids, q = np.array([i for i, _ in queries]), unit(matrix([v for _, v in queries]))

    def scan(batches: Batches) -> Batches:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            keys, m = b["vec_id"].to_numpy(), unit(matrix(b["vec"].to_pylist()))
            for own, row in zip(ids.tolist(), q, strict=True):
                old = best.get(own)
                k, x = (keys, m) if old is None else (np.concatenate((old[0], keys)), np.concatenate((old[1], m)))
                take = np.argsort(-(x @ row), kind="stable")[: plan.neighbours + 1]
                best[own] = (k[take], x[take], x[take] @ row)
        for own, (k, x, s) in best.items():
            yield pa.record_batch({"query_id": pa.array(np.full(len(k), own)), "vec_id": pa.array(k), "vec": pa.array(x.tolist(), pa.list_(pa.float64())), "score": pa.array(s)})

    found = vectors.mapInArrow(scan, "query_id long, vec_id long, vec array<double>, score double").filter("query_id <> vec_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= plan.neighbours)


def _budget(trees: Trees, rows: np.ndarray, queries: list[tuple[int, list[float]]], truth, plan: Plan) -> float:
    """How many vectors the leaves of a query must hold so that the target share of true neighbours is in them."""
    need = []
    for own, vector in queries:
        mine = truth[truth["query_id"] == own]
        if not len(mine):
            continue
        where = trees.leaves(matrix(list(mine["vec"])))
        order = trees.visit(unit(matrix([vector]))[0], rows, np.inf)
        held, reach = 0, {}
        for t, leaf in order:
            held += int(rows[t, leaf])
            reach[t, leaf] = held
        need += [min(reach.get((t, int(w[t])), held) for t in range(plan.trees)) for w in where]
    if not need:
        return np.inf
    # with room for what a sample of queries does not show
    return 1.1 * float(np.quantile(need, plan.recall))


@dataclass
class Forest:
    """The trees of one length of vectors, how many vectors each leaf has, how many a query asks for, and at which depth cells begin."""

    trees: Trees
    counts: np.ndarray  # by tree and leaf
    budget: float
    level: int

    def cell(self, leaf: np.ndarray) -> np.ndarray:
        return leaf >> (self.trees.depth - self.level)

    def blocks(self, rows: int) -> np.ndarray:
        """Into how many blocks of ``rows`` vectors each cell goes, by tree and cell."""
        held = self.counts.reshape(len(self.counts), 1 << self.level, -1).sum(axis=2)
        return np.maximum(1, -(-held // rows))


def _forest(rows: DataFrame, total: int, every: int, plan: Plan) -> Forest | None:
    """Trees for the vectors of one length, and the budget that meets the target recall; None if nothing is asked."""
    spark = rows.sparkSession
    asked = rows.filter(F.col("vec_id") % every == 0)
    audited = [(r["vec_id"], r["vec"]) for r in asked.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(plan.audit_queries).collect()]
    if not audited:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(plan.seed)), "vec_id", "vec").limit(plan.sample_rows).toArrow().to_pandas()
    order = sorted(range(len(sample)), key=lambda i: (sample["vec_id"][i], tuple(sample["vec"][i])))
    trees = fit(unit(matrix([sample["vec"][i] for i in order])), total, plan)
    sent = spark.sparkContext.broadcast(trees)
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32())])

    def place(batches: Batches) -> Batches:
        for b in batches:
            leaf = sent.value.leaves(unit(matrix(b["vec"].to_pylist())))
            for t in range(leaf.shape[1]):
                yield batch(schema, np.full(len(leaf), t), leaf[:, t])

    counts = np.zeros((plan.trees, 1 << trees.depth), np.int64)
    for r in rows.mapInArrow(place, "tree int, leaf int").groupBy("tree", "leaf").count().collect():  # as many rows as there are leaves
        counts[r["tree"], r["leaf"]] = r["count"]
    truth = _audit(rows, audited, plan).toArrow().to_pandas()
    # every vector is in one leaf of each tree: so many rows hold enough different ones
    budget = max(_budget(trees, counts, audited, truth, plan), plan.trees * (plan.neighbours + 1))
    level = min(trees.depth, max(0, int(np.ceil(np.log2(max(1, total / plan.block_rows))))))
    return Forest(trees, counts, budget, level)


def search(df: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding", plan: Plan | None = None) -> DataFrame:
    """The nearest neighbours of each row whose key is divisible by ``every``, among all other rows.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine in double precision), nearest first, ties to the smaller key.
    Rows with null keys or vectors that are null, zero or hold null or non-finite components take no part. Vectors are
    compared with those of their own length, whatever lengths there are. Rows with one key are one item with several vectors: its
    score is the best of them, and it is no candidate of itself. Fewer candidates than neighbours: all of them. Other columns
    are not read; an empty table gives no rows.
    """
    plan = plan or Plan()
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    rows = stored(rows.dropDuplicates(["vec_id", "vec"]), "vectors")
    # one row for each length that has enough vectors for trees
    many = rows.groupBy(F.size("vec").alias("n")).count().filter(F.col("count") > plan.few_rows).orderBy("n").collect()
    grown = {r["n"]: _forest(rows.filter(F.size("vec") == r["n"]), r["count"], every, plan) for r in many}
    tables = spark.sparkContext.broadcast(grown)
    schema = pa.schema([("length", pa.int32()), ("tree", pa.int32()), ("cell", pa.int64()), ("blocks", pa.int64()), ("id", pa.int64()), ("leaves", pa.binary()), ("data", pa.binary())])
    kinds = "length int, tree int, cell long, blocks long, id long, leaves binary, data binary"
    few, block_rows = np.zeros(1, np.int32).tobytes(), plan.block_rows

    def by_length(batches: Batches) -> Iterator[tuple[int, Forest | None, bool, np.ndarray, np.ndarray]]:
        for b in batches:
            vectors, ids = b["vec"].to_pylist(), b["vec_id"].to_numpy()
            sizes = np.array([len(v) for v in vectors], np.int64)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                yield int(n), tables.value.get(int(n)), int(n) in tables.value, ids[own], matrix([vectors[i] for i in own])

    def place(batches: Batches) -> Batches:
        for n, forest, large, ids, m in by_length(batches):
            data = [v.tobytes() for v in m]
            if not large:  # one leaf for all vectors of the length, in blocks by their number
                yield batch(schema, *([x] * len(m) for x in (n, 0, 0, 1)), ids, [few] * len(m), data)
            elif forest:
                leaf, blocks = forest.trees.leaves(unit(m)), forest.blocks(block_rows)
                for t in range(leaf.shape[1]):
                    cell = forest.cell(leaf[:, t])
                    yield batch(schema, np.full(len(m), n), np.full(len(m), t), cell, blocks[t, cell], ids, [x.tobytes() for x in leaf[:, t].astype(np.int32)], data)

    def ask(batches: Batches) -> Batches:
        for n, forest, large, ids, m in by_length(batches):
            for i, v, u in zip(ids.tolist(), m, unit(m), strict=True):
                if not large:
                    yield batch(schema, [n], [0], [0], [1], [i], [few], [v.tobytes()])
                    continue
                blocks, found = forest.blocks(block_rows), np.array(forest.trees.visit(u, forest.counts, forest.budget), np.int64).reshape(-1, 2)
                place = found[:, 0] << 40 | forest.cell(found[:, 1])
                out = []
                for where in np.unique(place):
                    t, cell = int(where >> 40), int(where & ((1 << 40) - 1))
                    out.append((n, t, cell, int(blocks[t, cell]), i, found[place == where, 1].astype(np.int32).tobytes(), v.tobytes()))
                yield batch(schema, *zip(*out, strict=True))

    placed = rows.mapInArrow(place, kinds)
    asking = stored(rows.filter(F.col("vec_id") % every == 0).mapInArrow(ask, kinds), "asking")
    return _meet(placed, asking, plan)


def _nearest(row_ids: np.ndarray, m: np.ndarray, places: np.ndarray, leaves: list[np.ndarray], asked: np.ndarray, q: np.ndarray, number: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best candidates among the rows whose leaf it has come to: key, keys, scores."""
    known, place = np.unique(places, return_inverse=True)
    u, several = unit(m), len(np.unique(row_ids)) < len(row_ids)
    for at in range(0, len(asked), 256):
        part = slice(at, at + 256)
        open_leaf = np.stack([np.isin(known, x) for x in leaves[part]])
        quick = np.where(open_leaf[:, place], unit(q[part]) @ u.T, -np.inf)
        for own, v, near in zip(asked[part].tolist(), q[part], quick, strict=True):
            near[row_ids == own] = -np.inf
            able = np.flatnonzero(near > -np.inf)
            if len(able) > number and not several:
                able = able[near[able] >= np.partition(near[able], -number)[-number] - 1e-9]
            score = cosine(np.broadcast_to(v, (len(able), len(v))), m[able])
            order = np.lexsort((row_ids[able], -score))
            keys, score = row_ids[able][order], score[order]
            if several:  # the best vector of each key
                first = np.sort(np.unique(keys, return_index=True)[1])
                keys, score = keys[first], score[first]
            yield own, keys[:number], score[:number]


def _meet(placed: DataFrame, asking: DataFrame, plan: Plan) -> DataFrame:
    """Vectors and queries of the same cell, ranked within the cell, then over all cells."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = ["length", "tree", "cell"]
    # cells that nobody asks for go; the others have as many blocks of queries as they need
    queries = asking.groupBy(*where).agg(F.ceil(F.count("*") / plan.block_queries).alias("q"))

    def dealt(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        df = df.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(5)), F.col(own))).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        pair = ("theirs", "mine") if query else ("mine", "theirs")
        return df.select(F.xxhash64(*where, *pair).alias("cell"), F.lit(query).alias("query"), "id", "leaves", "data")

    both = dealt(placed.join(queries, where), "blocks", "q", False).unionByName(dealt(asking.join(queries, where), "q", "blocks", True))
    number = plan.neighbours

    def rank(batches: Batches) -> Batches:
        for held in runs(batches):
            t = pa.Table.from_batches(held)
            cell, query, ids = t["cell"].to_numpy(), t["query"].to_numpy(), t["id"].to_numpy()
            leaves, data = t["leaves"].to_pylist(), t["data"].to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            out = []
            for s, e in zip(starts, np.concatenate((starts[1:], [len(cell)])), strict=True):
                at, asks = np.arange(s, e)[~query[s:e]], np.arange(s, e)[query[s:e]]
                if not len(at) or not len(asks):
                    continue
                m, q = (np.frombuffer(b"".join([data[i] for i in x]), np.float64).reshape(len(x), -1) for x in (at, asks))
                places = np.frombuffer(b"".join([leaves[i] for i in at]), np.int32)
                found = _nearest(ids[at], m, places, [np.frombuffer(leaves[i], np.int32) for i in asks], ids[asks], q, number)
                out += [(np.full(len(k), own), k, x) for own, k, x in found]
            if out:
                yield batch(_FOUND, *(np.concatenate(c) for c in zip(*out, strict=True)))

    found = both.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= number).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
