"""Approximate nearest neighbours: a forest of random-projection trees, one queue over all trees, exact reranking.

The trees are fitted on a bounded sample; every vector is then dealt to one leaf of each tree. A query walks the forest
through a single priority queue of nodes, ordered by how far beyond the planes on their way it would have to go, and
takes leaves until it has a given share of all rows. Leaves are reranked where they lie: the queries that chose a leaf
meet its members there, and only the nearest of each leaf go on. The share is measured on the sample: the smallest that
reaches ``RECALL`` there, so structured data need few leaves and data without structure need many.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import spool
from folio.llm.vectors import classes, hashed, stacked, takes_part

#: Rows of the sample at most (the smallest hashes), trees, sample rows of a leaf, recall wanted on the sample.
SAMPLE_ROWS, TREES, LEAF_ROWS, RECALL = 20_000, 8, 128, 0.97
#: Members and queries that one task compares at most; leaves with more are split.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 16_384


@dataclass
class Forest:
    """All trees in one set of arrays; leaf number of each node, -1 for inner ones. The right child is next to the left."""

    roots: np.ndarray
    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    share: float = 1.0

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        found = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(self.leaf[at] < 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.offset[node]
                at[inner] = self.left[node] + side
            found[:, t] = self.leaf[at]
        return found

    def in_order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves of all trees, by one queue: nearest first."""
        margin = self.normal @ query - self.offset
        heap = [(-np.inf, int(root)) for root in self.roots]
        heapq.heapify(heap)
        while heap:
            beyond, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            below = int(self.left[node])
            heapq.heappush(heap, (max(beyond, margin[node]), below))
            heapq.heappush(heap, (max(beyond, -margin[node]), below + 1))

    def chosen(self, query: np.ndarray, sizes: np.ndarray, rows: float) -> list[int]:
        """Leaves until they hold so many rows."""
        taken, have = [], 0
        for leaf in self.in_order(query):
            taken.append(leaf)
            have += sizes[leaf]
            if have >= rows:
                break
        return taken


def grow(sample: np.ndarray, trees: int = TREES, leaf_rows: int | None = None, k: int = 10, recall: float = RECALL, seed: int = 7) -> Forest:
    """Trees over a sample: each node's plane is at right angles to the line between two of its rows, at the median."""
    rng, leaf_rows = np.random.default_rng(seed), leaf_rows or LEAF_ROWS
    normal, offset, left, leaf, roots, leaves = [], [], [], [], [], 0
    unit = sample / np.maximum(1e-300, np.abs(sample).max(initial=0))

    def add() -> int:
        for a, empty in ((normal, np.zeros(sample.shape[1])), (offset, 0.0), (left, -1), (leaf, -1)):
            a.append(empty)
        return len(left) - 1

    for _ in range(trees):
        roots.append(add())
        todo = [(roots[-1], np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            split = None
            if len(rows) > leaf_rows:
                for _ in range(4):
                    a, b = rng.choice(rows, 2, replace=False)
                    way = unit[a] - unit[b]
                    along = sample[rows] @ way
                    middle = np.median(along)
                    right = along > middle
                    if 0.1 * len(rows) <= right.sum() <= 0.9 * len(rows):
                        split = way, middle, right
                        break
            if split is None:
                leaf[node] = leaves
                leaves += 1
                continue
            length = max(1e-300, np.sqrt((split[0] ** 2).sum()))
            normal[node], offset[node] = split[0] / length, split[1] / length
            left[node] = add()
            add()
            todo += [(left[node], rows[~split[2]]), (left[node] + 1, rows[split[2]])]
    forest = Forest(np.array(roots), np.array(normal).reshape(len(left), -1), np.array(offset), np.array(left), np.array(leaf))
    forest.share = measured_share(forest, sample, k, recall, rng)
    return forest


def measured_share(forest: Forest, sample: np.ndarray, k: int, recall: float, rng: np.random.Generator, queries: int = 200) -> float:
    """Rows to take for ``recall``, as a share of all rows, on queries from the sample itself."""
    if len(sample) <= k + 1:
        return float(len(forest.roots))
    leaves, needed = forest.leaves_of(sample), []
    sizes = np.bincount(leaves.ravel(), minlength=int(forest.leaf.max()) + 1)
    square = (sample**2).sum(axis=1)
    for q in rng.choice(len(sample), min(queries, len(sample)), replace=False):
        d = square - 2 * sample @ sample[q]
        d[q] = np.inf
        near = np.argpartition(d, k)[:k]
        rank, have = np.full(len(sizes), np.inf), 0
        for leaf in forest.in_order(sample[q]):
            have += sizes[leaf]
            rank[leaf] = have
        needed += rank[leaves[near]].min(axis=1).tolist()
    return float(np.quantile(needed, recall)) / len(sample)


def nearest(queries: np.ndarray, members: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, exact distance) of the k nearest members of each query, more where distances may tie."""
    scale = max(1e-300, np.abs(queries).max(), np.abs(members).max())
    square = ((members / scale) ** 2).sum(axis=1)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256] / scale
        own = (part * part).sum(axis=1)
        d = own[:, None] + square - 2 * (part @ (members / scale).T)
        slack = 1e-12 * (own[:, None] + square)
        bound = np.partition(d + slack, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        i, j = np.nonzero(d - slack <= bound[:, None])
        yield i + at, j, np.sqrt(((queries[i + at] - members[j]) ** 2).sum(axis=1))


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (of its id) holds.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; a query's own vec_id is no
    candidate; fewer candidates than k are all returned. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows with a null vec_id; vectors of another length are no candidates. Equal vectors
    are searched once, and only the k + 1 smallest ids of each can be answers. A repeated query id is searched once,
    with its smallest vector.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.lit(0).alias("label"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & takes_part(F.col("vector"))).select("*", *hashed(F.col("vector")))
    met = classes(rows, "ann-classes")
    sample: dict[int, list] = {}
    for r in met.orderBy(F.xxhash64("vector"), "node").limit(sample_rows).select("vector").collect():
        sample.setdefault(len(r.vector), []).append(r.vector)
    forests = {size: grow(stacked(own), trees, k=k) for size, own in sample.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(forests)
    kind = met.schema["vector"].dataType.simpleString()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree: size, leaf, node, vector. Lengths that the sample lacks have a single leaf."""
        for batch in batches:
            given = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in given])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                forest = shared.value.get(int(size))
                leaves = forest.leaves_of(stacked([given[i] for i in own])) if forest else np.zeros((len(own), 1), np.int32)
                taken = batch.take(pa.array(np.repeat(own, leaves.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(leaves.size, size, np.int32)), pa.array(leaves.ravel()), *taken.columns], ["size", "leaf", "node", "vector"])

    index = met.select("node", "vector").mapInArrow(indexed, f"size int, leaf int, node long, vector {kind}")
    index = spool(index, "ann-index")
    held = {(r["size"], r.leaf): r["n"] for r in index.groupBy("size", "leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf: bounded by the sample
    leaf_rows = {size: np.array([held.get((size, leaf), 0) for leaf in range(int(f.leaf.max()) + 1)]) for size, f in forests.items()}
    counted = vectors.sparkSession.sparkContext.broadcast((leaf_rows, {key: n for key, n in held.items() if key[0] not in forests}))

    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = spool(asked, "ann-queries")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size_of, leaf_of, block_of = [], [], [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                forest, query = shared.value.get(len(v)), np.asarray(v, np.float64)
                sizes = counted.value[0].get(len(v))
                leaves = forest.chosen(query, sizes, forest.share * sizes.sum() / len(forest.roots)) if forest else [0]
                for leaf in leaves:
                    n = int(sizes[leaf]) if forest else counted.value[1].get((len(v), 0), 0)
                    for block in range(-(-n // BLOCK_ROWS)):
                        at.append(i), size_of.append(len(v)), leaf_of.append(leaf), block_of.append(block)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (size_of, leaf_of, block_of)] + taken.columns, ["size", "leaf", "block", "query_id", "vector"])

    # A leaf is read once for each BLOCK_QUERIES of the queries that chose it, and not at all if none did.
    probing = asked.select("vec_id", "vector").mapInArrow(probes, f"size int, leaf int, block int, query_id long, vector {kind}")
    probing = spool(probing, "ann-probes")
    parts = probing.where("block = 0").groupBy("size", "leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    probing = probing.join(parts, ["size", "leaf"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")
    leaf_counts = index.groupBy("size", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).join(parts, ["size", "leaf"])
    members = index.join(leaf_counts, ["size", "leaf"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")

    def rerank(some: pd.DataFrame, all_of_leaf: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(all_of_leaf):
            return pd.DataFrame({"query_id": [], "node": [], "score": []})
        ids, nodes = some.query_id.to_numpy(), all_of_leaf.node.to_numpy()
        found = list(nearest(stacked(some.vector), stacked(all_of_leaf.vector), k + 1))
        return pd.DataFrame({"query_id": np.concatenate([ids[i] for i, _, _ in found]), "node": np.concatenate([nodes[j] for _, j, _ in found]), "score": np.concatenate([d for _, _, d in found])})

    key = ["size", "leaf", "block", "part"]
    local = probing.groupBy(key).cogroup(members.groupBy(key)).applyInPandas(rerank, "query_id long, node long, score double")
    by_query = Window.partitionBy("query_id")
    distinct = local.groupBy("query_id", "node").agg(F.min("score").alias("score")).join(met.select("node", "h1", "h2", "first"), "node")
    ahead = distinct.withColumn("place", F.row_number().over(by_query.orderBy("score", "first", "node"))).where(F.col("place") <= k + 1)
    by_class = Window.partitionBy("h1", "h2").orderBy("vec_id")
    copies = rows.select("h1", "h2", "vec_id").withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1).drop("place")
    answers = ahead.select("query_id", "score", "h1", "h2").join(copies, ["h1", "h2"]).where("query_id <> vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(by_query.orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
