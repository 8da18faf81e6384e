"""Counts, numbering and duplicate splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.functions.text import block_name, script_class, unicode_block
from lexispark.operators.skew import null_safe_join, spread_row_number


def group_counts(kwgrp: DataFrame, grp: DataFrame, entr: DataFrame, kwsrc: DataFrame) -> DataFrame:
    """Entries per group and corpus; a group without entries counts 1.

    Counted per (group, corpus) before the outer join, which then has one row per result.
    """
    g = grp.select("entr", F.col("kw").alias("id"))
    e = entr.select(F.col("id").alias("entr"), "src")
    per = g.join(e, "entr", "left").groupBy("id", "src").agg(F.count(F.lit(1)).alias("cnt"))
    out = kwgrp.join(per, "id", "left").join(
        kwsrc.select(F.col("id").alias("src"), F.col("kw").alias("corpus")), "src", "left"
    )
    keep = [c for c in ("id", "kw", "descr") if c in kwgrp.columns]
    return out.select(*keep, "corpus", F.coalesce("cnt", F.lit(1)).cast("bigint").alias("cnt"))


def load_report(entr: DataFrame, kwsrc: DataFrame) -> DataFrame:
    """Entries per corpus, and the total under a null name."""
    per = entr.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    named = per.join(kwsrc.select(F.col("id").alias("src"), "kw"), "src", "left").select("kw", "n")
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("kw"), "n")
    return named.unionByName(total)


def sequence_high_water(entr: DataFrame, kwsrc: DataFrame) -> DataFrame:
    """Per corpus the largest number used within its range, else the range start.

    `kwsrc` may have smin, smax, sinc and seq (the counter's name); corpora naming the same counter
    share it.  Columns: id, top, sinc.
    """
    opt = lambda c, v: (F.coalesce(c, F.lit(v)) if c in kwsrc.columns else F.lit(v)).cast("bigint")
    counter = F.col("seq") if "seq" in kwsrc.columns else F.col("id").cast("string")
    k = kwsrc.select(
        F.col("id").alias("src"), counter.alias("_q"), opt("smin", 1).alias("_lo"),
        opt("smax", 9223372036854775807).alias("_hi"), opt("sinc", 1).alias("sinc"),
    )
    # Combined per number first: only (corpus, number) pairs that exist matter for a maximum.
    used = entr.select("src", "seq").join(k, "src").where("seq BETWEEN _lo AND _hi")
    top = used.groupBy("_q").agg(F.max("seq").alias("_top"))
    start = k.groupBy("_q").agg(F.min("_lo").alias("_start"))
    water = start.join(top, "_q", "left").select("_q", F.coalesce("_top", "_start").alias("top"))
    return k.join(water, "_q").select(F.col("src").alias("id"), "top", "sinc")


def duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(first row per key, further rows).  `order` must tell the rows of a key apart."""
    pos = F.struct(*order)
    first = df.groupBy(*keys).agg(F.min(pos).alias("_first"))
    marked = null_safe_join(df, first, list(keys)).withColumn("_is", pos.eqNullSafe(F.col("_first")))
    return marked.where("_is").select(*df.columns), marked.where("NOT _is").select(*df.columns)


def char_histogram(
    items: DataFrame, entr: DataFrame, kwsrc: DataFrame, by: str = "block", corpus: str | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Characters of active approved entries per block or script class.

    Texts become characters and are counted at once, so the shuffle carries one row per
    (task, character), and the block lookup sees each distinct character once.  Groups
    with fewer than 100 distinct characters list them.
    """
    src = kwsrc.where(F.col("kw") == corpus if corpus else F.col("kw") != "test").select(F.col("id").alias("src"))
    e = entr.where("stat = 2 AND NOT unap").join(src, "src", "left_semi").select(F.col("id").alias("entr"))
    texts = items.select("entr", "txt").join(e, "entr", "left_semi")
    return text_histogram(texts, "txt", by, blocks)


def text_histogram(texts: DataFrame, col: str, by: str = "block", blocks: DataFrame | None = None) -> DataFrame:
    """(grp, total, uniq, chars) of a text column."""
    ch = texts.select(F.explode(F.split(col, "")).alias("ch")).where("ch <> ''")
    n = ch.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    if by == "class":
        named = n.withColumn("grp", script_class("ch").cast("string"))
    elif blocks is not None:
        named = unicode_block(n, blocks).withColumnRenamed("block", "grp")
    else:
        named = n.withColumn("grp", block_name("ch"))
    # At most 1.1 million distinct characters exist, so a group's set is bounded.
    out = named.groupBy("grp").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("uniq"), F.sort_array(F.collect_list("ch")).alias("_c")
    )
    return out.select("grp", "total", "uniq", F.when(F.col("uniq") < 100, F.array_join("_c", "")).alias("chars"))


# W4, W5 --------------------------------------------------------------------------


def renumber_children(
    items: DataFrame, keys: Sequence[str], ordinal: str, dependents: dict[str, DataFrame] | None = None,
    order: Sequence[str] | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Ordinals 1..n per parent in the present order, carried into dependent tables."""
    by = [F.col(c) for c in (order or [ordinal])]
    numbered = spread_row_number(items, keys, by, "_new")
    out = numbered.withColumn(ordinal, F.col("_new")).select(*items.columns)
    moved = {}
    if dependents:
        m = numbered.select(*keys, F.col(ordinal), "_new")
        for name, df in dependents.items():
            j = df.join(m, [*keys, ordinal])
            moved[name] = j.withColumn(ordinal, F.col("_new")).select(*df.columns)
    return out, moved


def stamp_last_history(hist: DataFrame) -> DataFrame:
    """The last history row of an entry records the entry's id in `eid`."""
    last = hist.groupBy("entr").agg(F.max("hist").alias("_last"))
    eid = F.when(F.col("hist") == F.col("_last"), F.col("entr")).otherwise(
        F.col("eid") if "eid" in hist.columns else F.lit(None)
    )
    cols = [c for c in hist.columns if c != "eid"]
    return hist.join(last, "entr").select(*cols, eid.cast("bigint").alias("eid"))


def section_breaks(df: DataFrame, key: str, order: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """True where `parts` differ from the row before, within `key`."""
    w = W.partitionBy(key).orderBy(*order)
    now = F.struct(*parts)
    prev = F.lag(now).over(w)
    return df.withColumn("sbreak", prev.isNull() | ~now.eqNullSafe(prev))
