"""Exact range self-join of unit vectors, for near duplicates of embeddings.

Vectors of one label are dealt to the nearest of some pivots. A vector that lies
so close to the border of another cell that, by the triangle inequality, it may
have a neighbour there also visits that cell, if the cell's number is higher;
so every near pair meets in one cell. Cells are joined independently, large ones
in pairs of blocks, and a block pair reports counts and local components, not
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded_rows, stored

#: Vectors of a cell that the number of pivots aims at, vectors of a block, and pivots at most.
CELL, BLOCK, MOST_PIVOTS = 4096, 2048, 512


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _units(column: pa.Array | pd.Series) -> np.ndarray:
    """Rows of equal length as unit vectors, in double precision (scaled first, so that no square overflows)."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dealing(pivots: np.ndarray, radius: float):
    """Adds ``cells``: the home cell first, then those that a vector visits."""
    gaps = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(-1), 0)) if len(pivots) else None

    def cells_of(x: np.ndarray) -> list[list[int]]:
        if x.shape[1] != (pivots.shape[1] if len(pivots) else -1):
            return [[0]] * len(x)
        d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
        home = d2.argmin(1)
        own = d2[np.arange(len(x)), home]
        # the border of two cells is half way: at least this far off, by pivots a known gap apart
        with np.errstate(divide="ignore", invalid="ignore"):
            off = (d2 - own[:, None]) / (2 * gaps[home])
        near = (off <= radius + 1e-9) & (np.arange(len(pivots)) > home[:, None])
        return [[int(h), *np.flatnonzero(n).tolist()] for h, n in zip(home, near, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(3).to_pylist()
            cells: list = [None] * b.num_rows
            vectors = b.column(2).to_pylist()
            for size in set(sizes):
                rows = [i for i, s in enumerate(sizes) if s == size]
                for i, c in zip(rows, cells_of(_units([vectors[i] for i in rows])), strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    return run


def _least_of(groups: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of ``groups`` along links a-b: the least member's number for each."""
    while True:
        low = np.minimum(groups[a], groups[b])
        new = groups.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == groups).all():
            return groups
        groups = new


def _joining(cosine: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        x = _units(pdf["vector"])
        block, resident, rows = pdf["block"].to_numpy(), pdf["resident"].to_numpy(), pdf["row"].to_numpy()
        i, j = key[-2], key[-1]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, ends = np.zeros(len(x), np.int64), []
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            cos = x[part] @ x[right].T
            a, b = np.nonzero(cos >= cosine - 1e-9)
            close = cos[a, b]
            a, b = part[a], right[b]
            edge = np.abs(close - cosine) < 1e-9
            if edge.any():
                close[edge] = [_cosine(pdf["vector"][p], pdf["vector"][q]) for p, q in zip(a[edge], b[edge], strict=True)]
            good = (close >= cosine) & (resident[a] | resident[b]) & ((a < b) | (i != j))
            a, b = a[good], b[good]
            np.add.at(links, a, 1)
            np.add.at(links, b, 1)
            # whole components of the pairs so far replace the pairs
            ends.append((a, b))
            if sum(len(p) for p, _ in ends) > 1 << 20:
                a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
                least = _least_of(np.arange(len(x)), a, b)
                ends = [(np.arange(len(x)), least)]
        a, b = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, int),) * 2
        least = _least_of(np.arange(len(x)), a, b)
        some = links > 0
        return pd.DataFrame({"row": rows[some], "n_links": links[some], "least": rows[least[some]]})

    return run


def _cosine(p, q) -> float:
    p, q = np.asarray(p, np.float64), np.asarray(q, np.float64)
    return float(p @ q / (np.linalg.norm(p) * np.linalg.norm(q)))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine is ``cosine`` or more (above 0), and groups them.

    Returns ``id_col, n_links long`` (other rows linked directly),
    ``component_id`` (the least id reachable, itself included) and ``kept``
    (whether that is its own id), one row per input row. Rows whose label is
    null, or whose vector is null, empty, zero or has a null or non-finite
    component, link with nothing; nor do vectors of different length. Equal
    vectors, and rows with equal or null ids, are vectors of their own; a null
    id is least only where all are. Other columns are not read. Exact.

    Rows reach a task in blocks of about ``BLOCK``, however many lie in a cell.
    """
    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    base = stored(source, "vectors")
    good = base.filter(F.col("label").isNotNull() & usable(F.col("vector"))).select("row", "label", "vector", F.size("vector").alias("size"))

    most = good.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    n_pivots = min(-(-most // CELL), MOST_PIVOTS)
    pivots = np.zeros((0, 0))
    if n_pivots > 1:
        got = bounded_rows(good.select("row", "vector", "size"), n_pivots, "row").select("vector").collect()
        size = max({len(v[0]) for v in got}, key=[len(v[0]) for v in got].count, default=0)
        found = [v[0] for v in got if len(v[0]) == size]
        pivots = np.unique(_units(found), axis=0) if found else pivots
    radius = float(np.sqrt(2 - 2 * cosine))
    kinds = dict(good.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in good.columns)
    dealt = good.mapInArrow(_dealing(pivots, radius), schema + ", cells array<int>")
    dealt = dealt.select("row", "label", "size", "vector", F.posexplode("cells").alias("place", "cell"))

    cell = ["label", "size", "cell"]
    blocks = dealt.select(*cell).groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    blocks = stored(blocks, "blocks")
    placed = dealt.join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("row", "vector", "block", (F.col("place") == 0).alias("resident"), *cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = stored(placed.groupBy(*cell, "i", "j").applyInPandas(_joining(cosine), "row long, n_links long, least long"), "parts")

    counts = parts.groupBy("row").agg(F.sum("n_links").alias("n_links"))
    roots = connected_components(parts.select(F.col("row").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "row")
    named = base.select("row", "id").join(roots, "row")
    least = named.groupBy("root").agg(F.min("id").alias("least_id"))
    least = named.join(least, "root").select("row", "least_id")
    out = base.select("row", "id").join(counts, "row", "left").join(least, "row", "left")
    component = F.coalesce("least_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
