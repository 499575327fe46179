"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Within a label, vectors are dealt to cells around pivots. Two vectors of at least the threshold's cosine are at most
sqrt(2 - 2 threshold) apart, so a vector visits every lower cell whose bisecting plane it is that near to, and each
pair meets in exactly one cell. Cells are compared tile by tile: every unit vector is quantised to int8 with its own
scale, and its quantisation error is measured. The product of two quantised vectors is off by at most
e_x + |x~| e_y; only pairs that may reach the threshold within that bound are recomputed in double precision. A task
returns link counts and a spanning forest, never its pairs. Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, local_forest, spool, tile_pairs
from folio.llm.vectors import classes, hashed, stacked, takes_part, units

#: Classes for which one more pivot is taken, most pivots (they are broadcast), and rows of a tile.
CELL_ROWS, MOST_PIVOTS, TILE_ROWS = 16_384, 1024, 4096


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, errors, lengths of the quantised rows): |row - scale * int8 row| = error."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((unit - back) ** 2).sum(axis=1)) + 1e-12, np.sqrt((back * back).sum(axis=1))


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of x, j of y) of unit vectors whose cosine reaches the threshold."""
    (qx, sx, ex, nx), (qy, sy, ey, _) = quantise(x), quantise(y)
    exact = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64  # sums of int8 products are exact in either
    qy, left, right = qy.astype(exact).T.copy(), [], []
    for at in range(0, len(x), 512):
        part = slice(at, at + 512)
        about = (qx[part].astype(exact) @ qy) * (sx[part, None] * sy)
        i, j = np.nonzero(about + ex[part, None] + nx[part, None] * ey + 1e-9 >= threshold)
        sure = (x[i + at] * y[j]).sum(axis=1) >= threshold
        left.append(i[sure] + at)
        right.append(j[sure])
    return np.concatenate(left), np.concatenate(right)


def _deal(rows: DataFrame, pivots: list, threshold: float) -> DataFrame:
    """Each class in its home cell and in the lower cells that it visits: key, home, node, n, vector."""
    by_size: dict[int, np.ndarray] = {}
    for size in {len(p) for p in pivots}:
        by_size[size] = units(stacked([p for p in pivots if len(p) == size]))
    gaps = {size: np.sqrt(np.maximum(0, 2 - 2 * near @ near.T)) for size, near in by_size.items()}  # between pivots
    reach = np.sqrt(2 - 2 * threshold)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells, homes = [], [], []
            vectors = batch.column(3).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                near = by_size.get(int(size))
                if near is None:
                    at.append(own), cells.append(np.zeros(len(own), int)), homes.append(np.ones(len(own), bool))
                    continue
                dots = units(stacked([vectors[i] for i in own])) @ near.T
                home = dots.argmax(axis=1)
                visits = dots[np.arange(len(own)), home][:, None] - dots <= reach * (gaps[int(size)][home] + 1e-7) + 1e-9
                visits &= np.arange(len(near)) <= home[:, None]
                i, cell = np.nonzero(visits)
                at.append(own[i]), cells.append(cell), homes.append(cell == home[i])
            at, cells, homes = (np.concatenate(x) if x else np.empty(0, int) for x in (at, cells, homes))
            taken = batch.take(pa.array(at))
            key = [f"{label}:{len(vectors[i])}:{cell}" for label, i, cell in zip(taken.column(2).to_pylist(), at, cells)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(homes.astype(bool)), taken.column(0), taken.column(1), taken.column(3)], ["key", "home", "node", "n", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("node", "n", F.col("label").cast("string"), "vector").mapInArrow(each, f"key string, home boolean, node long, n long, vector {kind}")


def links(met: DataFrame, threshold: float) -> DataFrame:
    """From classes (node, label, vector, n): rows (a, n, null) that add n links to a, and forest edges (a, null, b)."""
    wanted = min(MOST_PIVOTS, -(-met.count() // CELL_ROWS))
    pivots = [r.vector for r in met.orderBy(F.xxhash64("vector"), "node").limit(max(1, wanted)).select("vector").collect()]
    dealt = spool(_deal(met, pivots, threshold), "embedding-cells")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiled = tile_pairs(dealt.withColumnRenamed("n", "copies"), sizes, "key", F.col("node"), TILE_ROWS)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows.tile_a.iat[0], rows.tile_b.iat[0]
        one, two = rows[rows.tile == a], rows[rows.tile == b]
        if len(one) and len(two):
            i, j = near_pairs(units(stacked(one.vector)), units(stacked(two.vector)), threshold)
        else:
            i = j = np.empty(0, int)
        if a == b:
            i, j = i[i < j], j[i < j]
        ok = one.home.to_numpy()[i] | two.home.to_numpy()[j]
        i, j = i[ok], j[ok]
        base = 0 if a == b else len(one)
        node = one.node.to_numpy() if a == b else np.concatenate([one.node.to_numpy(), two.node.to_numpy()])
        many = one.copies.to_numpy() if a == b else np.concatenate([one.copies.to_numpy(), two.copies.to_numpy()])
        left, right = i, j + base
        counts = np.bincount(left, many[right], len(node)) + np.bincount(right, many[left], len(node))
        moved, root = local_forest(len(node), left, right)
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.concatenate([node[some], node[moved]]),
            "n": pd.array([*counts[some].astype(int), *[None] * len(moved)], dtype="Int64"),
            "b": pd.array([*[None] * len(some), *node[root]], dtype="Int64"),
        })

    return tiled.groupBy("key", "tile_a", "tile_b").applyInPandas(compare, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links join vectors of one label with a cosine of ``threshold`` or more.

    Vectors that are null, zero or hold null or non-finite components, vectors without a label, and vectors of different
    lengths have no links. Equal vectors of a label, repeated rows among them, link with each other. component_id is the
    smallest vec_id reachable (null ids don't count); kept says whether that is the row's own. An empty table gives none.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("fine", takes_part(F.col("vector")) & F.col("label").isNotNull()).select("*", *hashed(F.col("vector"), F.col("label")))
    met = classes(rows.where("fine"), "embedding-classes")
    found = spool(links(met, threshold), "embedding-links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"), "embedding-components")
    smallest = linked.join(met.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    named = linked.join(smallest, "root").select("node", "smallest")
    placed = met.join(counts, "node", "left").join(named, "node", "left").select("h1", "h2", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"))
    fine = rows.where("fine").select("vec_id", "h1", "h2").join(placed, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
