"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Equal vectors of a label are one vector with a weight, so a group of copies is one row of
the comparisons. A label of n different vectors has about sqrt(n) / SPLIT cells, from some
seventeen vectors on, and no more than make cells of a quarter block, as each cell more
means more visits. Centroids are fitted on a sample by hash, in two levels where they are many.

Exact: a vector is compared in its own cell and visits each cell of lower number that can
hold a partner. If y has home h and x home c, then (y - x) . (C_h - C_c) is at least
y . (C_h - C_c), so y need not visit c where that exceeds |C_h - C_c| times the largest
distance of two linked vectors. The vectors at home in a cell and its visitors are dealt out
to blocks, each pair of blocks of the former, or of one and the other, is multiplied in one
task, by tiles, and only counts and a forest of links leave it. Visitors are not compared
with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import BROADCAST_ROWS, components, if_small, join_split, stored

BLOCK, SIDE = 1 << 14, 8 << 20  # vectors of one block at most, and their bytes
TILE = 512, 2048  # rows and columns of one product
SPLIT = 4  # a label of n vectors has a SPLIT-th of sqrt(n) cells at most
SAMPLE_PER_CELL = 32  # vectors (expected) that centroids are fitted on
FLAT = 64  # cells that are fitted at once; more are fitted in two levels
HELD = 1 << 15  # centroids that each task may hold; with more, labels meet theirs in a join
SLICE = 1 << 15  # vectors of a label that a task places in that join


def unit_vectors(rows: DataFrame, label: str) -> DataFrame:
    """_rid, vec_id, _label, _dim, unit for the vectors that can link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = []
            for v in batch["embedding"]:
                x = np.array([np.nan if e is None else e for e in v], np.float64)
                size = np.linalg.norm(x / (top := np.abs(x).max(initial=0) or 1)) * top if np.isfinite(x).all() else 0.0
                units.append(x / size if size > 0 and np.isfinite(size) else None)
            batch = batch.assign(unit=units, _dim=[0 if u is None else len(u) for u in units])
            yield batch[batch["_dim"] > 0][["_rid", "vec_id", "_label", "_dim", "unit"]]

    some = rows.select("_rid", "vec_id", F.col(label).cast("string").alias("_label"), "embedding").dropna()
    return some.mapInPandas(run, "_rid bigint, vec_id bigint, _label string, _dim int, unit array<double>")


def fit_cells(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def fit_many(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids; more than FLAT of them as a part for each of sqrt(k) coarse cells."""
    if k <= FLAT:
        return fit_cells(x, min(k, len(x)))
    coarse = (x @ fit_cells(x, math.isqrt(k)).T).argmax(axis=1)
    parts = [x[coarse == c] for c in np.unique(coarse)]
    return np.concatenate([fit_cells(p, max(1, round(k * len(p) / len(x)))) for p in parts])


def centroids(units: DataFrame) -> DataFrame:
    """(_label, _dim, _n, c) of the groups that have more than one cell, fitted on about
    SAMPLE_PER_CELL vectors a cell."""
    sizes = units.groupBy("_label", "_dim").agg(F.count(F.lit(1)).alias("_n"))
    many = stored(sizes.withColumn("_k", F.ceil(F.least(F.sqrt("_n") / SPLIT, F.col("_n") * 4 / BLOCK + 2)).cast("int")).where("_k > 1"), "cell_numbers")
    picked = units.select("_rid", "_label", "_dim", "unit").join(if_small(many), ["_label", "_dim"])
    picked = picked.where(F.pmod(F.xxhash64("_rid"), F.lit(1 << 20)) * F.col("_n") < F.col("_k") * (SAMPLE_PER_CELL << 20))

    def fit(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_rid")
        c = fit_many(np.stack(p["unit"].to_list()), int(p["_k"].iloc[0]))
        return pd.DataFrame({"_label": key[0], "_dim": key[1], "_n": p["_n"].iloc[0], "c": list(c)})

    return stored(picked.groupBy("_label", "_dim").applyInPandas(fit, "_label string, _dim int, _n bigint, c array<double>"), "centroids")


def place(p: pd.DataFrame, c: np.ndarray | None, reach: float) -> Iterator[pd.DataFrame]:
    """The vectors of one label with _cell and _home; visits are rows of their own."""
    if c is None or not len(c):
        yield p.assign(_cell=0, _home=True)
        return
    size = (c * c).sum(axis=1)
    step = max(1, (1 << 21) // len(c))
    for at in range(0, len(p), step):
        some = p.iloc[at : at + step]
        near = np.stack(some["unit"].to_list()) @ c.T
        home = near.argmax(axis=1)
        between = np.sqrt(np.maximum(0, size[home][:, None] + size - 2 * c[home] @ c.T))
        gap = near[np.arange(len(some)), home][:, None] - near
        row, cell = np.nonzero((gap <= reach * between + 1e-12) & (np.arange(len(c)) < home[:, None]))
        row, cell = np.concatenate([np.arange(len(some)), row]), np.concatenate([home, cell])
        yield some.iloc[row].assign(_cell=cell, _home=np.arange(len(row)) < len(some))


def cells(units: DataFrame, cosine: float) -> DataFrame:
    """units with _cell and _home (false for visits)."""
    found = centroids(units)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema) + ", _cell int, _home boolean"
    if found.count() <= HELD:
        held: dict[tuple[str, int], list] = {}
        for r in found.collect():
            held.setdefault((r["_label"], r["_dim"]), []).append(r["c"])
        sent = units.sparkSession.sparkContext.broadcast({k: np.array(c) for k, c in held.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, p in batch.groupby(["_label", "_dim"]):
                    yield from place(p, sent.value.get(key), reach)

        return units.mapInPandas(run, schema)
    slices = found.groupBy("_label", "_dim").agg(F.ceil(F.max("_n") / SLICE).cast("int").alias("_slices"))
    slices = stored(slices, "slices")
    dealt = units.join(if_small(slices), ["_label", "_dim"], "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("_rid"), F.col("_slices")), F.pmod(F.xxhash64("_rid"), F.lit(1))).cast("int")).drop("_slices")
    copies = found.join(if_small(slices), ["_label", "_dim"]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    by = ["_label", "_dim", "_slice"]

    def meet(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        given = np.stack(c["c"].to_list()) if len(c) else None
        return pd.concat(list(place(p.drop(columns="_slice"), given, reach))) if len(p) else p.drop(columns="_slice").assign(_cell=0, _home=True)

    return dealt.groupBy(*by).cogroup(copies.select(*by, "c").groupBy(*by)).applyInPandas(meet, schema)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the lowest place that links reach, for each place) with links (a, b) more."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    return root


_KEY = ["_label", "_dim", "_h0", "_h1", "_twice", "_own"]


def collapsed(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (_rid, vec_id, key) and one row for equal vectors of a label: key, _rep (the
    lowest _rid), _weight (rows) and _low (lowest vec_id). A vec_id of several rows keeps
    rows of its own, as they are no links of each other. Equal is the same 128-bit hash."""
    twice = stored(units.groupBy("vec_id").count().where("count > 1").select("vec_id", F.lit(True).alias("_twice")), "twice")
    keyed = units.select("_rid", "vec_id", "_label", "_dim", F.xxhash64("unit").alias("_h0"), F.xxhash64(F.lit(1), "unit").alias("_h1"))
    keyed = keyed.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, "vec_id", "left")
    keyed = keyed.withColumn("_twice", F.coalesce("_twice", F.lit(False))).withColumn("_own", F.when(F.col("_twice"), F.col("vec_id")).otherwise(0))
    keyed = stored(keyed, "keyed")
    single = keyed.groupBy(*_KEY).agg(F.min("_rid").alias("_rep"), F.count(F.lit(1)).alias("_weight"), F.min("vec_id").alias("_low"))
    return keyed, stored(single, "single")


def dealt_blocks(placed: DataFrame) -> DataFrame:
    """``placed`` with _block, and a row for each product (_i, _j) it takes part in. Blocks of
    vectors at home are numbered from 0 up, those of visitors from -1 down."""
    by = ["_label", "_dim", "_cell"]
    side = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(SIDE) / (F.col("_dim") * 8)))
    n = placed.groupBy(*by).agg(F.count_if(F.col("_home")).alias("_n"), F.count_if(~F.col("_home")).alias("_v"))
    n = n.select(*by, (F.col("_n") / side).cast("int").alias("_last"), F.ceil(F.col("_v") / side).cast("int").alias("_visits"))
    hashed = lambda m: F.pmod(F.xxhash64("_rid"), F.greatest(F.lit(1), m)).cast("int")
    rows = placed.join(n, by).withColumn("_block", F.when(F.col("_home"), hashed(F.col("_last") + 1)).otherwise(-1 - hashed(F.col("_visits"))))
    home = F.sequence(F.lit(0), F.col("_last"))
    visits = F.when(F.col("_home") & (F.col("_visits") > 0), F.sequence(F.lit(-1), -F.col("_visits"), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_other", F.explode(F.concat(home, visits))).drop("_last", "_visits")
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return rows.withColumns({"_i": F.when(low < 0, high).otherwise(low), "_j": F.when(low < 0, low).otherwise(high)}).drop("_other")


def block_links(placed: DataFrame, cosine: float) -> DataFrame:
    """_rid, _low, n, root: links of each vector in each pair of blocks, by weight."""

    def product(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_low", kind="stable")
        low, rid, twice, weight = p["_low"].to_numpy(), p["_rid"].to_numpy(), p["_twice"].to_numpy(bool), p["_weight"].to_numpy()
        x, block, (i, j) = np.stack(p["unit"].to_list()), p["_block"].to_numpy(), key[-2:]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n, root = np.zeros(len(p), np.int64), np.arange(len(p))
        for s in range(0, len(left), TILE[0]):
            rows = left[s : s + TILE[0]]
            for t in range(s if i == j else 0, len(right), TILE[1]):
                columns = right[t : t + TILE[1]]
                near = x[rows] @ x[columns].T >= cosine
                if not near.any():
                    continue
                a, b = np.nonzero(near)
                a, b = rows[a], columns[b]
                ok = ~((low[a] == low[b]) & twice[a] & twice[b]) & (a < b if i == j else rid[a] != rid[b])
                a, b = a[ok], b[ok]
                np.add.at(n, a, weight[b])
                np.add.at(n, b, weight[a])
                root = _joined(root, a, b)
        return pd.DataFrame({"_rid": rid, "_low": low, "n": n, "root": low[root]})[n > 0]

    dealt = dealt_blocks(placed).select("_label", "_dim", "_cell", "_i", "_j", "_block", "_rid", "_low", "_twice", "_weight", "unit")
    return dealt.groupBy("_label", "_dim", "_cell", "_i", "_j").applyInPandas(product, "_rid bigint, _low bigint, n bigint, root bigint")


def near_duplicates(rows: DataFrame, cosine: float = 0.98, label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding and ``label``.

    Vectors of one label and length link at that cosine or more, in double precision. Null,
    empty and zero vectors, those with null or non-finite components, and rows without label
    or vec_id link with nothing; a row without vec_id has no component and is kept. Rows
    that share a vec_id are one vertex, and each counts the other ids' rows as its links.
    Further columns are not read.
    """
    all_ = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label, "embedding").withColumn("_rid", F.monotonically_increasing_id()), "vectors")
    units = stored(unit_vectors(all_, label), "units")
    keyed, single = collapsed(units)
    reps = units.select("_rid", "unit").join(single.withColumnRenamed("_rep", "_rid"), "_rid").drop("_h0", "_h1", "_own")
    links = stored(block_links(stored(cells(stored(reps, "different"), cosine), "cells"), cosine), "links")
    counts = links.groupBy("_rid").agg(F.sum("n").alias("n"))
    near = components(links.select(F.col("root").alias("a"), F.col("_low").alias("b")))
    vertex = single.join(counts, F.col("_rep") == F.col("_rid"), "left").drop("_rid").join(near, F.col("_low") == F.col("id"), "left")
    others = F.coalesce("n", F.lit(0)) + F.when(F.col("_twice"), 0).otherwise(F.col("_weight") - 1)
    vertex = stored(vertex.select(*_KEY, "_weight", others.alias("n_links"), F.coalesce("component", "_low").alias("component_id")), "vertices")
    of_rows = join_split(keyed.select("_rid", *_KEY), vertex, _KEY, "_weight").select("_rid", "n_links", "component_id")
    out = all_.select("_rid", "vec_id").join(of_rows, "_rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
