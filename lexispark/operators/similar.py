"""Entries that share a reading or written form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _texts(rdng: DataFrame, kanj: DataFrame) -> DataFrame:
    r = rdng.select("entr", F.lit("rdng").alias("kind"), "txt")
    return r.unionByName(kanj.select("entr", F.lit("kanj").alias("kind"), "txt")).distinct()


def similar_entries(candidates: DataFrame, entr: DataFrame, rdng: DataFrame, kanj: DataFrame) -> DataFrame:
    """(cid, id) of entries sharing a text with a candidate in the same corpus.

    `candidates` has cid, src, seq (excluded when not null), kind, txt: the texts of
    submissions, against which the whole corpus is looked up.
    """
    live = entr.where("stat < 4").select(F.col("id").alias("entr"), "src", F.col("seq").alias("_seq"))
    known = live.join(_texts(rdng, kanj), "entr")
    hit = candidates.join(known, ["src", "kind", "txt"])
    return hit.where("seq IS NULL OR seq <> _seq").select("cid", F.col("entr").alias("id")).distinct()


def similar_texts(entr: DataFrame, rdng: DataFrame, kanj: DataFrame) -> DataFrame:
    """J13 for every entry at once: (id, kind, txt, others).

    `others` counts live entries of the same corpus and another sequence number with that
    text.  Two counts per text, combined before the shuffle, replace the entry pairs, of
    which a frequent text would have a square number.
    """
    texts = _texts(rdng, kanj)
    e = entr.select(F.col("id").alias("entr"), "src", "seq", (F.col("stat") < 4).alias("live"))
    rows = texts.join(e, "entr")
    live = rows.where("live")
    per_text = live.groupBy("src", "kind", "txt").agg(F.count(F.lit(1)).alias("_all"))
    per_seq = live.groupBy("src", "kind", "txt", "seq").agg(F.count(F.lit(1)).alias("_own"))
    out = rows.join(per_text, ["src", "kind", "txt"]).join(per_seq, ["src", "kind", "txt", "seq"], "left")
    out = out.withColumn("others", F.col("_all") - F.coalesce("_own", F.lit(0)))
    return out.where("others > 0").select(F.col("entr").alias("id"), "kind", "txt", "others")
