"""Helpers of this subpackage: stored tables, word hashes, shingles, linked components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.session import scratch_path

#: Entries that a worker's word memo holds before it starts anew (about 150 bytes each).
MEMO_WORDS = 100_000
#: Bytes of a batch that goes to a Python worker.
BATCH = 8 << 20
#: Letters of text that a task turns into rows before it sends them on.
PIECE = 1 << 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files
    that every executor sees, whatever executor is lost. The shuffle files of the write go
    when it ends, so the disk holds those of one step and not of all."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with while_written(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def while_written(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Python tasks get batches of ``BATCH`` bytes at most: a batch
    is held by the task's executor and by its Python worker, and more than once by either.
    Shuffle files are removed at the end of the write, not when the driver collects garbage."""
    confs = {
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in confs}
    for key, value in confs.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Rows of a few numbers that are broadcast; with more, joins shuffle.
BROADCAST_ROWS = 1 << 19


def if_small(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if its count allows it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def with_rank(kept: DataFrame, by: str, rank: str) -> DataFrame:
    """Number the rows of each ``by`` from 0, without gaps, in a column ``rank``.

    ``kept`` is a stored table with ``_rid``, made by monotonically_increasing_id before it
    was stored: its upper bits name the part that wrote the row, so each window holds rows
    of one part, and a value that most rows share is never numbered in one task.
    """
    kept = kept.withColumn("_pid", F.shiftright("_rid", 33))
    by_part = kept.groupBy(by, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(by, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(by, "_pid").orderBy("_rid")
    rows = kept.withColumn("_row", F.row_number().over(own) - 1).join(base, [by, "_pid"])
    return rows.withColumn(rank, F.col("_row") + F.col("_base"))


def join_split(rows: DataFrame, single: DataFrame, by: list[str], count: str, parts: int = 1024) -> DataFrame:
    """``rows`` with the row of ``single`` (a stored table) that has the same ``by``.

    ``single`` has one row a key, and in ``count`` how many of the rows have it. The rows of
    a key that holds a ``parts``-th of all or more (there are ``parts`` of them at most) are
    split into slices of that size, so that no task gets them all.
    """
    total = single.agg(F.sum(count)).first()[0] or 1
    slices = F.ceil(F.col(count) * parts / total).cast("int")
    hot = F.broadcast(single.where(F.col(count) * parts >= total).select(*by, slices.alias("_slices")))
    dealt = rows.join(hot, by, "left").withColumn("_slice", F.when(F.col("_slices").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_slices"))).otherwise(0).cast("int")).drop("_slices")
    last = F.when(F.col(count) * parts >= total, slices - 1).otherwise(0)
    return dealt.join(single.withColumn("_slice", F.explode(F.sequence(F.lit(0), last))), [*by, "_slice"]).drop("_slice")


def release() -> None:
    """Give back what a task held: its worker lives on and waits beside those of the next stage."""
    _memo.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pd.DataFrame], size: int = PIECE) -> Iterator[pd.DataFrame]:
    """The rows of the batches, in slices of some ``size`` letters of ``text`` (a longer text
    is a slice of its own)."""
    try:
        for batch in batches:
            ends = np.cumsum([len(t) if t else 0 for t in batch["text"]])
            cuts = np.flatnonzero(np.diff(ends // size, prepend=0)) if len(ends) else []
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if a < b:
                    yield batch.iloc[a:b]
    finally:
        release()


class WordMemo(dict):
    """64-bit hash of each word of UTF-8 bytes, for the words of one task."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = WordMemo()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower case, ASCII punctuation and blanks between words dropped."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, in order; with fewer values none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = h[:n] + np.uint64(k)
    for j in range(1, k):
        x = mix(x) + h[j : n + j]
    return mix(x)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of k-word shingles; with fewer words the whole sequence is one."""
    return np.unique(runs(h, min(k, len(h)))) if len(h) else h


def to_long(x: Iterable | np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in ``edges``.

    Each round maps a vertex to the neighbour (or itself) of lowest hash, and the edges to
    what their ends map to. Hashed order makes the rounds few (logarithmic, in expectation)
    for chains too. A hub's edges are combined before the shuffle; its joins can be split.
    Each round is written to the shared folder. Null ids are left out.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = stored(edges, "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least("m", key("a"))["v"].alias("to"))
        low = stored(low, "low")
        edges = (
            edges.join(low, "a").select("b", F.col("to").alias("x"))
            .join(low.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        edges = stored(edges, "edges")
        labels = labels.join(low, labels.root == low.a, "left").select("id", F.coalesce("to", "root").alias("root"))
        labels = stored(labels, "labels")
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
