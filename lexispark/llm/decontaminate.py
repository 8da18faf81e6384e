"""Benchmark decontamination: MinHash containment search, then exact shingle containment.

Test items are partitioned by size (number of shingles, up to the next power of two). An
item of n shingles keeps as its sketch the n - ceil(n * percent / 100) + 1 of them with the
lowest values, so that its length follows the item's size and not that of a document: a
document that holds the given part of the item must hold one of these. Values are min-wise
hashes with the shingle's frequency among the items in front, so that a phrase of many
items is a sketch member only where nothing rarer is left. Documents that hold a member
are paired with its items, and pairs are decided by comparing the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import pieces, plain_words, runs, stored, to_long, word_hashes

#: Sketch members that each task may hold (8 bytes each). With more, documents send their
#: shingles to a join instead.
MAX_HELD = 1 << 20
ITEMS_PER_ROW = 64  # items compared with one copy of a document's text

def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """item_id, width (words in a shingle: k, or all of a shorter item), n, hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows = []
            for item, text in zip(batch.item_id, batch.text):
                w = plain_words(text)
                width = min(k, len(w))
                h = np.unique(runs(word_hashes(w), width)) if w else []
                rows += [(item, width, len(h), x) for x in to_long(h).tolist()] if len(w) else []
            yield pd.DataFrame(rows, columns=["item_id", "width", "n", "hash"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").distinct()
    return rows.mapInPandas(run, "item_id bigint, width int, n bigint, hash bigint")


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """item_id, width, class (size partition), hash: the sketch members."""
    rows = stored(item_shingles(items, k), "item_shingles")
    common = rows.groupBy("width", "hash").agg(F.count(F.lit(1)).alias("df"))
    valued = rows.join(common, ["width", "hash"]).select("item_id", "width", "n", F.struct(F.log2("df").cast("int").alias("f"), F.col("hash").alias("h")).alias("v"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    low = valued.groupBy("item_id", "width", "n").agg(F.array_sort(F.collect_set("v")).alias("v"))
    low = low.withColumn("v", F.slice("v", F.lit(1), most.cast("int")))
    return low.select("item_id", "width", F.ceil(F.log2("n")).cast("int").alias("class"), F.explode("v.h").alias("hash"))


def _texts_with_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """_row, doc_id, text, hits: the documents that hold a sketch member."""
    widths = sorted(r[0] for r in members.select("width").distinct().collect())  # 1 to k
    distinct = members.select("width", "hash").distinct()
    held = None
    if distinct.count() <= MAX_HELD:
        held = {w: [] for w in widths}
        for w, h in distinct.collect():  # its number was just checked
            held[w].append(h)
        held = docs.sparkSession.sparkContext.broadcast({w: np.sort(np.array(v, np.int64)) for w, v in held.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            out = []
            for text in batch["text"]:
                h, hits = word_hashes(plain_words(text)), []
                for w in widths:
                    x = to_long(runs(h, w))
                    if held is not None:
                        known = held.value[w]
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        x = x[known[at] == x]
                    hits += [(w, v) for v in np.unique(x).tolist()]
                out.append(hits)
            some = np.array([bool(h) for h in out], bool)
            kept = pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "hits": out})[some]
            yield kept.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = rows.mapInPandas(run, "doc_id bigint, text string, hits array<struct<width: int, hash: bigint>>")
    return stored(found.withColumn("_row", F.monotonically_increasing_id()), "with_members")


def _shared(text: pd.Series, items: pd.Series, k: pd.Series) -> pd.Series:
    out = []
    for t, some, size in zip(text, items, k):
        words, found, sets = plain_words(t), [], {}
        for item in some:
            w = plain_words(item["text"])
            width = min(int(size), len(w))
            if width not in sets:
                sets[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            own = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
            found.append({"item_id": item["item_id"], "item_shingles": len(own), "shared": len(own & sets[width])})
        out.append(found)
    return pd.Series(out)


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, item_id, item_shingles, shared: every pair where the document
    holds at least ``percent`` of the item's distinct k-word shingles.

    An item of fewer than k words is one shingle. Items without words or without item_id,
    and documents without text, are in no pair. Repeated rows give one pair; of a repeated
    item_id each text counts, and the pair has the larger share. Other columns are not read.
    """
    members = stored(sketches(items, k, percent), "sketches")
    texts = _texts_with_members(docs, members)
    hit = texts.select("_row", F.explode("hits").alias("x")).select("_row", "x.width", "x.hash")
    pairs = hit.join(members.select("width", "hash", "item_id"), ["width", "hash"]).select("_row", "item_id").distinct()
    chunk = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n") / ITEMS_PER_ROW))
    pairs = stored(pairs, "leak_pairs")
    dealt = pairs.join(pairs.groupBy("_row").agg(F.count(F.lit(1)).alias("n")), "_row").select("_row", "item_id", chunk.alias("_chunk"))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).distinct()
    lists = dealt.join(own, "item_id").groupBy("_row", "_chunk").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    count = F.pandas_udf(_shared, "array<struct<item_id: bigint, item_shingles: bigint, shared: bigint>>")
    shared = lists.join(texts.drop("hits"), "_row").select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(count("text", "items", F.lit(k))).alias("s"))
    return (
        shared.select("doc_id", "text_hash", "s.*").where(F.col("shared") * 100 >= F.col("item_shingles") * percent).where("item_shingles > 0")
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max_by(F.struct("item_shingles", "shared"), F.col("shared") / F.col("item_shingles")).alias("best"))
        .select("doc_id", "text_hash", "item_id", "best.item_shingles", "best.shared")
    )


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are in a pair of :func:`leaks`."""
    bad = leaks(docs, items, k, percent).select(F.col("doc_id").alias("_doc"), "text_hash").distinct()
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("b._doc")) & (F.xxhash64("d.text") == F.col("b.text_hash"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
