"""K-d tree sharding: split at weighted medians along the widest dimension.

Dimensions are functions of the text (bytes, bytes per 1000 characters, checksum), so rows
with equal texts have one place in the tree and stay together. Ties of a dimension are
ordered by the checksum. Only histograms of fixed size come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import stored, with_rank

BINS = 4096
#: A split is fine enough once the bin that holds it weighs at most this part of its node.
TOLERANCE = 1e-4
DIMS = ("_k_size", "_k_density", "_k_crc")


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1`` and the conditions that lead here."""

    first: int
    shards: int
    where: Column = field(default_factory=lambda: F.lit(True))
    dim: str = ""
    weight: int = 0
    lo: int = 0
    hi: int = 0
    below: int = 0  # bytes at keys under lo
    cut: int | None = None  # keys up to this one go left


def _which(nodes: list[Node]) -> Column:
    pick = F.lit(None).cast("int")
    for i, n in enumerate(nodes):
        pick = F.when(n.where, F.lit(i)).otherwise(pick)
    return pick


def _case(nodes: list[Node], value) -> Column:
    pick = F.lit(None).cast("long")
    for i, n in enumerate(nodes):
        pick = F.when(F.col("_node") == i, value(n)).otherwise(pick)
    return pick


def _widest(keys: DataFrame, nodes: list[Node]) -> None:
    """Give each node its weight and the dimension that is widest against the whole."""
    spans = [x for d in DIMS for x in (F.min(d).alias(f"lo{d}"), F.max(d).alias(f"hi{d}"))]
    found = keys.groupBy(_which(nodes).alias("_node")).agg(F.sum("size").alias("w"), *spans).where("_node is not null").collect()
    whole = {d: max(1, max(r[f"hi{d}"] for r in found) - min(r[f"lo{d}"] for r in found)) for d in DIMS} if found else {}
    for r in found:
        n = nodes[r["_node"]]
        n.dim = max(DIMS, key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / whole[d])
        n.weight, n.lo, n.hi = r["w"], r[f"lo{n.dim}"], r[f"hi{n.dim}"]


def _medians(keys: DataFrame, nodes: list[Node]) -> None:
    """Weighted quantiles of all nodes at once: histograms, each over the bin found before."""
    while open_ := [n for n in nodes if n.weight and n.cut is None]:
        width = lambda n: (n.hi - n.lo) // BINS + 1
        at = keys.withColumn("_node", _which(open_)).where("_node is not null")
        at = at.withColumn("_key", _case(open_, lambda n: F.col(n.dim))).withColumn("_lo", _case(open_, lambda n: F.lit(n.lo))).withColumn("_hi", _case(open_, lambda n: F.lit(n.hi)))
        at = at.where("_key between _lo and _hi").withColumn("_width", _case(open_, lambda n: F.lit(width(n))))
        bins = at.groupBy("_node", F.expr("(_key - _lo) div _width").alias("bin")).agg(F.sum("size").alias("w"))
        rows = sorted(tuple(r) for r in bins.collect())
        for i, n in enumerate(open_):
            goal, sum_ = n.weight * (n.shards // 2) / n.shards, n.below
            for _, b, w in (r for r in rows if r[0] == i):
                if sum_ + w >= goal:
                    lo, hi = n.lo + b * width(n), min(n.hi, n.lo + (b + 1) * width(n) - 1)
                    if lo == hi or w <= TOLERANCE * n.weight:
                        n.cut = hi if sum_ + w - goal <= goal - sum_ else lo - 1
                    n.lo, n.hi, n.below = lo, hi, sum_
                    break
                sum_ += w


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (from 0 in each shard, gapless),
    grown_shard (null). Sizes are as near to equal as whole groups of equal texts allow.

    A null text has size 1 and checksum 0, as an empty one. Rows without doc_id and repeated
    rows are placed like others; further columns are not read. No rows give no rows.
    """
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keys = docs.select(
        "doc_id", (size + 1).alias("size"), crc.alias("text_crc32"),
        F.expr("coalesce(1000L * octet_length(text) div nullif(char_length(text), 0), 0L)").alias("_density"),
        F.monotonically_increasing_id().alias("_rid"),
    )
    keys = stored(keys, "shard_keys")
    tied = lambda c: F.shiftleft(F.col(c), 32).bitwiseOR(F.col("text_crc32"))
    keyed = keys.withColumns({"_k_size": tied("size"), "_k_density": tied("_density"), "_k_crc": F.col("text_crc32")})
    nodes = [Node(0, shards)]
    while any(n.shards > 1 for n in nodes):
        split = [n for n in nodes if n.shards > 1]
        _widest(keyed, split)
        _medians(keyed, split)
        done = [n for n in nodes if n.shards == 1]
        for n in split:
            left = n.shards // 2
            side = F.col(n.dim) <= n.cut if n.cut is not None else F.lit(True)
            done += [Node(n.first, left, n.where & side), Node(n.first + left, n.shards - left, n.where & ~side)]
        nodes = done
    pick = F.lit(0)
    for n in nodes:
        pick = F.when(n.where, F.lit(n.first)).otherwise(pick)
    placed = with_rank(keyed.withColumn("shard", pick.cast("int")), "shard", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
