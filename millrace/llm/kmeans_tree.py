"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import Scratch

#: Vectors (about) that the tree is fitted on, all of a smaller table; every vector is indexed.
SAMPLE_ROWS = 100_000
#: Children of an inner node, vectors of a leaf (as sampled), rows of a block of a leaf, and queries that meet it at once.
BRANCH, LEAF, BLOCK, QUERIES = 8, 64, 20_000, 4096
#: Recall at which the visits of leaves are calibrated, and the queries that serve for it.
RECALL, TRIALS = 0.95, 300
#: Distances that are computed at once.
CHUNK = 1 << 20


class Tree:
    """Centres of a hierarchy of k-means clusterings; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centres: list[np.ndarray] = []  # of each inner node's children
        self.children: list[list[int]] = []  # inner nodes >= 0, leaves -1 - number
        self.leaves, self.rng, self.branch, self.leaf = 0, np.random.default_rng(seed), branch, leaf
        self.root = self._grow(sample)
        del self.rng

    def _grow(self, points: np.ndarray) -> int:
        if len(points) <= self.leaf:
            return self._leaf()
        centres = points[self.rng.choice(len(points), min(self.branch, len(points)), replace=False)]
        for _ in range(8):
            near = _square(points, centres).argmin(1)
            own = [points[near == j] for j in range(len(centres))]
            centres = np.stack([p.mean(0) if len(p) else c for p, c in zip(own, centres)])
        near = _square(points, centres).argmin(1)
        own = [points[near == j] for j in range(len(centres))]
        if max(map(len, own)) == len(points):
            return self._leaf()
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        self.children[node] = [self._grow(p) for p in own]
        return node

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, down the nearest centres."""
        at = np.full(len(points), self.root)
        while len(open_ := np.flatnonzero(at >= 0)):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                at[rows] = np.array(self.children[node])[_square(points[rows], self.centres[node]).argmin(1)]
        return -1 - at

    def visit(self, point: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first: a priority queue holds the bins not gone into, by distance."""
        if self.root < 0:
            return [0]
        queue, found = [(0.0, 0, self.root)], []
        while queue and len(found) < leaves:
            _, _, node = heapq.heappop(queue)
            while node >= 0:  # down to a leaf; its siblings wait
                far = ((self.centres[node] - point) ** 2).sum(1)
                order = np.argsort(far, kind="stable")
                for j in order[1:].tolist():
                    heapq.heappush(queue, (float(far[j]), len(queue), self.children[node][j]))
                node = self.children[node][order[0]]
            found.append(-1 - node)
        return found


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :]


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Leaves to visit: widened until the mean recall of trial points of the sample, against the rest of it, is reached."""
    leaf = tree.assign(sample)
    own = np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
    needed = []
    for i in own:
        far = ((sample - sample[i]) ** 2).sum(1)
        far[i] = np.inf
        place = np.empty(tree.leaves, np.int64)
        place[tree.visit(sample[i], tree.leaves)] = np.arange(tree.leaves)
        needed.append(place[leaf[np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]]])
    visits = np.bincount(np.concatenate(needed), minlength=tree.leaves).cumsum() if len(sample) > 1 else np.ones(1)
    return int(np.searchsorted(visits, recall * visits[-1])) + 1


def exact(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - query[None, :]) ** 2).sum(1))


def closest(queries: np.ndarray, points: np.ndarray, k: int, member) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, distances) of at least the ``k`` nearest points of each query that ``member`` (first, last query)
    allows, with all that tie for the last.

    Products of matrices choose them, with a margin above their rounding; distances are then computed directly."""
    out, k = [], min(k, len(points))
    norms = (points**2).sum(1)
    for first in range(0, len(queries), max(1, CHUNK // len(points))):
        some = queries[first : first + max(1, CHUNK // len(points))]
        own = (some**2).sum(1)
        allowed = member(first, first + len(some))
        far = np.where(allowed, own[:, None] - 2 * some @ points.T + norms[None, :], np.inf)
        bound = np.partition(far, k - 1, axis=1)[:, k - 1] + 1e-12 * points.shape[1] * (own + norms.max())
        for query, row, most, ok in zip(some, far, bound, allowed):
            at = np.flatnonzero((row <= most) & ok)
            out.append((at, exact(query, points[at])))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, ids: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, queries_at_once: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found vectors of each query, its own id excepted.

    The tree is fitted on about ``sample_rows`` vectors, chosen by a hash of ids and vectors; all vectors are put in its
    leaves. Equal vectors are searched once, with their k + 1 smallest ids: no other copy can be among the k nearest.
    Every query goes through the leaves best bin first, as many as the calibration found. Neighbouring leaves are stored
    together in shards of about ``block`` rows, larger leaves are cut into blocks of them; a query goes once to each
    shard that it visits, with the leaves that it may look at there, in groups of about ``queries_at_once``, and each
    block gives on k rows of it. A query whose leaves hold fewer than k others visits all leaves.

    Null, zero and non-finite vectors take no part. Vectors are compared with those of the same length, each length in a
    tree of its own. Ties go to the smaller id; null ids take no part; repeated rows are candidates each; an empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = lambda c: c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(c, lambda x: x != 0)
    as_rows = lambda df: df.select(F.col(ids).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("id").isNotNull()).filter(F.coalesce(whole(F.col("v")), F.lit(False)))
    rows, asked = as_rows(vectors), as_rows(queries).dropDuplicates(["id"])
    lengths = asked.select(F.size("v").alias("d")).distinct()
    counts = {r["d"]: r["count"] for r in rows.select(F.size("v").alias("d")).groupBy("d").count().join(lengths, "d").collect()}  # one row a length
    out = None
    with Scratch(spark) as scratch:
        for d, total in sorted(counts.items()):
            share = int(min(1.0, sample_rows / total) * (1 << 30))
            own = rows.filter(F.size("v") == d)
            fit = own.filter(F.pmod(F.xxhash64("id", "v", F.lit("fit")), F.lit(1 << 30)) < share) if share < 1 << 30 else own
            fitted = fit.select("v").limit(2 * sample_rows).toArrow()["v"].combine_chunks()  # copies of one row are all in or out
            sample = np.unique(fitted.flatten().to_numpy().reshape(-1, d), axis=0) if len(fitted) else np.zeros((0, d))
            tree = Tree(sample)
            leaves = calibrate(tree, sample, k, recall) if len(sample) else 1
            found = _search(own, asked.filter(F.size("v") == d), total, tree, leaves, k, block, queries_at_once, scratch)
            out = found if out is None else out.unionByName(found)
        if out is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return scratch.result(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")


def shards_of(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, blocks) of each leaf: neighbouring leaves make shards of about ``block`` rows; a larger leaf is a shard
    that is cut into blocks."""
    shard, blocks, last, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > block:
            last, held = last + 1, 0
        shard[leaf], held = last, held + n
        blocks[leaf] = max(1, -(-n // block))
    return shard, blocks


def _search(rows: DataFrame, asked: DataFrame, total: int, tree: Tree, leaves: int, k: int, block: int, at_once: int, scratch: Scratch) -> DataFrame:
    spark, pairs = rows.sparkSession, k + 1
    shared = spark.sparkContext.broadcast(tree)  # a centre for each leaf and node of the sample

    def put(batches):
        for frame in batches:
            points = np.stack(frame["v"].to_list()) if len(frame) else np.zeros((0, 1))
            yield frame.assign(leaf=shared.value.assign(points).astype(np.int64))

    ranked = rows.withColumn("copy", F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("id"))).filter(F.col("copy") <= pairs)
    placed = scratch.keep(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).mapInPandas(put, "v array<double>, ids array<long>, leaf long"), "leaves")
    counts = np.zeros(max(1, tree.leaves), np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row a leaf
        counts[r["leaf"]] = r["count"]
    shard, blocks = shards_of(counts, block)
    cut = spark.createDataFrame([(i, int(s), int(b)) for i, (s, b) in enumerate(zip(shard, blocks))], "leaf long, shard long, blocks long")
    per_shard = {int(s): int(blocks[shard == s].max()) for s in np.unique(shard)}
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own_shard = spark.sparkContext.broadcast(shard)

    def route(everywhere: bool):
        def run(batches):
            for frame in batches:
                for first in range(0, len(frame), 256):
                    out = []
                    for id_, v in zip(frame["id"][first : first + 256], frame["v"][first : first + 256]):
                        found = np.arange(len(own_shard.value)) if everywhere else np.sort(shared.value.visit(np.asarray(v), leaves))
                        out += [(id_, v, int(s), found[own_shard.value[found] == s]) for s in np.unique(own_shard.value[found])]
                    yield pd.DataFrame(out, columns=["id", "v", "shard", "visits"])

        return run

    def search(key, points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(wanted):
            own, leaf = points["ids"].to_list(), points["leaf"].to_numpy()
            names, at_leaf = np.unique(leaf, return_inverse=True)
            visits = wanted["visits"].to_list()
            member = lambda first, last: np.stack([np.isin(names, x) for x in visits[first:last]])[:, at_leaf]
            for id_, (at, far) in zip(wanted["id"], closest(np.stack(wanted["v"].to_list()), np.stack(points["v"].to_list()), pairs, member)):
                out += [(id_, i, s) for s, i in sorted((float(s), int(i)) for j, s in zip(at, far) for i in own[j] if i != id_)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def run(some: DataFrame, everywhere: bool = False) -> DataFrame:
        routed = scratch.keep(some.mapInPandas(route(everywhere), "id long, v array<double>, shard long, visits array<long>"), "routed")
        groups = {r["shard"]: -(-r["count"] // at_once) for r in routed.groupBy("shard").count().collect()}  # one row a shard
        sizes = F.broadcast(spark.createDataFrame([(s, n, groups[s]) for s, n in per_shard.items() if s in groups], "shard long, most long, groups long"))
        meet = routed.join(sizes, "shard").select("id", "v", "visits", "shard", F.pmod(F.xxhash64("id"), F.col("groups")).alias("group"), upto("most").alias("block"))
        stored = placed.join(F.broadcast(cut), "leaf").join(sizes, "shard").select("v", "ids", "leaf", "shard", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"), upto("groups").alias("group"))
        return stored.groupBy("shard", "block", "group").cogroup(meet.groupBy("shard", "block", "group")).applyInPandas(search, "query_id long, vec_id long, score double")

    found = scratch.keep(best(run(asked)), "found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1))
    short = scratch.keep(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short")
    if short.take(1):
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(best(run(short, True)))
    return found
