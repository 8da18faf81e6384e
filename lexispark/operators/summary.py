"""Entry and sense summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.functions.text import freq_text


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], expr: Column | str, sep: str, name: str
) -> DataFrame:
    """Texts of a group joined in order; null texts are skipped, all-null gives null."""
    value = F.col(expr) if isinstance(expr, str) else expr
    src = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_txt"))
    by = ", ".join(f"_o{i}" for i in range(len(order)))
    sep = sep.replace("'", "\\'")
    return src.groupBy(*keys).agg(F.expr(f"listagg(_txt, '{sep}') WITHIN GROUP (ORDER BY {by})").alias(name))


def headwords(entr: DataFrame, rdng: DataFrame, kanj: DataFrame, key: str = "id") -> DataFrame:
    """Entries with their first reading and kanji.

    An entry that has readings but none with ordinal 1 drops out (likewise kanji): the
    filter comes after the outer join.  Written as first items plus an existence check,
    so the join stays one row per entry.
    """
    def first(df, o, name):
        return df.groupBy(F.col("entr").alias(key)).agg(
            F.max(F.when(F.col(o) == 1, F.col("txt"))).alias(name),
            F.max(F.col(o) == 1).alias(f"_has_{name}"),
        )

    out = entr.join(first(rdng, "rdng", "rtxt"), key, "left").join(first(kanj, "kanj", "ktxt"), key, "left")
    return out.where(
        F.coalesce("_has_rtxt", F.lit(True)) & F.coalesce("_has_ktxt", F.lit(True))
    ).drop("_has_rtxt", "_has_ktxt")


# A1 ------------------------------------------------------------------------------

# Which frequency rows make an entry or item popular, today and formerly.
POPULAR = "(kw IN (1, 2, 7) AND value = 1) OR kw = 4"
POPULAR_OLD = "kw IN (1, 2, 3, 4) AND value = 1"


def is_popular(entr: DataFrame, freq: DataFrame) -> DataFrame:
    """A1: entries with flag `p`."""
    hit = freq.where(POPULAR).select(F.col("entr").alias("id")).distinct().withColumn("p", F.lit(True))
    return entr.join(hit, "id", "left").withColumn("p", F.coalesce("p", F.lit(False)))


def is_popular_item(items: DataFrame, freq: DataFrame, ordinal: str, old_rule: bool = False) -> DataFrame:
    """A1 per reading or kanji; `old_rule` is the earlier definition of the mark."""
    rule = POPULAR_OLD if old_rule else POPULAR
    hit = freq.where(rule).where(F.col(ordinal).isNotNull()).select("entr", ordinal).distinct()
    return items.join(hit.withColumn("p", F.lit(True)), ["entr", ordinal], "left").withColumn(
        "p", F.coalesce("p", F.lit(False))
    )


# A2, A3 --------------------------------------------------------------------------


def sense_summary(sens: DataFrame, gloss: DataFrame) -> DataFrame:
    """A2: glosses of a sense joined by '; '."""
    g = ordered_concat(gloss, ["entr", "sens"], ["gloss"], "txt", "; ", "gloss")
    return sens.select("entr", "sens", "notes").join(g, ["entr", "sens"], "left").select(
        "entr", "sens", "gloss", "notes"
    )


def sense_counts(sens: DataFrame, key: str = "id") -> DataFrame:
    return sens.groupBy(F.col("entr").alias(key)).agg(F.count(F.lit(1)).alias("nsens"))


def entry_summary(
    entr: DataFrame, rdng: DataFrame, kanj: DataFrame, sens: DataFrame, gloss: DataFrame, freq: DataFrame
) -> DataFrame:
    """A2: one row per entry with headwords, glosses, sense count and popularity.

    Each table is shuffled once, by entry: glosses get their separator from the gloss
    before them in the entry ('; ' within a sense, ' / ' between senses), so the text of
    an entry needs no step per sense.  Glosses are taken to belong to a sense row.
    """
    before = F.lag("sens").over(W.partitionBy("entr").orderBy("sens", "gloss"))
    sep = F.when(before.isNull(), "").when(before == F.col("sens"), "; ").otherwise(" / ")
    pieces = gloss.select("entr", "sens", "gloss", F.concat(sep, "txt").alias("_t"))
    g = pieces.groupBy(F.col("entr").alias("id")).agg(
        F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY sens, gloss)").alias("_g")
    )
    s = sense_counts(sens).join(g, "id", "left").select("id", "nsens", F.coalesce("_g", F.lit("")).alias("gloss"))
    p = freq.where(POPULAR).select(F.col("entr").alias("id")).distinct().withColumn("p", F.lit(True))
    keep = [c for c in ("id", "seq", "stat", "src", "dfrm", "unap", "notes", "srcnote") if c in entr.columns]
    out = headwords(entr.select(*keep), rdng, kanj).join(s, "id", "left").join(p, "id", "left")
    return out.select(
        *keep,
        F.col("rtxt").alias("rdng"), F.col("ktxt").alias("kanj"), "gloss",
        F.coalesce("nsens", F.lit(0)).cast("bigint").alias("nsens"),
        F.coalesce("p", F.lit(False)).alias("p"),
    )


def entry_sense_summary(
    entr: DataFrame, rdng: DataFrame, kanj: DataFrame, sens: DataFrame, gloss: DataFrame
) -> DataFrame:
    """A2: one row per sense with the headwords of its entry."""
    h = headwords(entr.select("id", "seq", "src", "stat"), rdng, kanj).join(sense_counts(sens), "id")
    s = sense_summary(sens, gloss).select(F.col("entr").alias("id"), "sens", "gloss")
    return h.join(s, "id").select(
        "id", "seq", "src", "stat", "sens", F.col("rtxt").alias("rdng"), F.col("ktxt").alias("kanj"), "gloss", "nsens"
    )


def item_counts(entr: DataFrame, rdng: DataFrame, kanj: DataFrame, sens: DataFrame) -> DataFrame:
    """A3: readings, kanji and senses per entry, zeros kept."""
    out = entr.select("id", "seq")
    for df, name in ((rdng, "nrdng"), (kanj, "nkanj"), (sens, "nsens")):
        n = df.groupBy(F.col("entr").alias("id")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("id", "seq", zero("nrdng"), zero("nkanj"), zero("nsens"))


# A5 ------------------------------------------------------------------------------


def tag_texts(parents: DataFrame, tags: DataFrame, kw: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A5: comma list of tag names per parent, in tag order; null without tags."""
    named = tags.join(kw.select(F.col("id").alias("kw"), F.col("kw").alias("_kw")), "kw")
    texts = ordered_concat(named, keys, ["ord"], "_kw", ",", name)
    return parents.select(*keys).distinct().join(texts, list(keys), "left")


def item_texts(items: DataFrame, ordinal: str, name: str, infos: DataFrame | None = None, info: str = "") -> DataFrame:
    """A5: texts of an entry joined by '; ', each with its `[tags]` when `infos` is given."""
    text = F.col("txt")
    if infos is not None:
        items = items.join(infos, ["entr", ordinal], "left")
        text = F.concat(text, F.coalesce(F.concat(F.lit("["), F.col(info), F.lit("]")), F.lit("")))
    return ordered_concat(items, ["entr"], [ordinal], text, "; ", name)


def gloss_texts(gloss: DataFrame, kwginf: DataFrame | None = None) -> DataFrame:
    """A5: glosses per sense joined by '; '; with `kwginf`, marked unless plain."""
    text = F.col("txt")
    if kwginf is not None:
        gloss = gloss.join(kwginf.select(F.col("id").alias("ginf"), F.col("kw").alias("_kw")), "ginf")
        text = F.when(F.col("ginf") == 1, text).otherwise(F.concat(F.lit("["), F.col("_kw"), F.lit("] "), text))
    # Placed by entry, so that steps per sense and per entry share one shuffle.
    return ordered_concat(gloss.repartition(F.col("entr")), ["entr", "sens"], ["gloss"], text, "; ", "gtxt")


def sense_texts(
    sens: DataFrame, glosses: DataFrame, notes: bool = False,
    pos: DataFrame | None = None, misc: DataFrame | None = None,
) -> DataFrame:
    """A5: gloss texts of an entry joined by ' / '.

    With `notes` there is one row per distinct (entry, note), so an entry whose senses
    differ in their notes gives several rows, each with all senses.  `pos` and `misc`
    (texts per sense) are put in front of each sense.
    """
    text = F.col("gtxt")
    if pos is not None and misc is not None:
        glosses = glosses.join(pos, ["entr", "sens"], "left").join(misc, ["entr", "sens"], "left")
        box = lambda c: F.coalesce(F.concat(F.lit("["), F.col(c), F.lit("]")), F.lit(""))
        gap = F.when(F.col("ptxt").isNull() & F.col("mtxt").isNull(), "").otherwise(" ")
        text = F.concat(box("ptxt"), box("mtxt"), gap, F.col("gtxt"))
    joined = ordered_concat(glosses, ["entr"], ["sens"], text, " / ", "stxt")
    if not notes:
        return sens.select("entr").distinct().join(joined, "entr", "left")
    note = F.coalesce(F.concat(F.lit(" 《"), F.col("notes"), F.lit("》")), F.lit(""))
    out = sens.select("entr", "notes").distinct().join(joined, "entr", "left")
    return out.select("entr", F.concat("stxt", note).alias("stxt"))


def entry_texts(
    entr: DataFrame, rtexts: DataFrame, ktexts: DataFrame, stexts: DataFrame, sens: DataFrame, freq: DataFrame
) -> DataFrame:
    """A5: entries with reading, kanji and sense texts, sense count and popularity."""
    out = is_popular(entr, freq)
    for part in (rtexts, ktexts, stexts):
        out = out.join(part.withColumnRenamed("entr", "id"), "id", "left")
    out = out.join(sense_counts(sens), "id", "left")
    return out.withColumn("nsens", F.coalesce("nsens", F.lit(0)).cast("bigint"))


# A11 -----------------------------------------------------------------------------


def freq_texts(freq: DataFrame, kwfreq: DataFrame, keys: Sequence[str] = ("entr",)) -> DataFrame:
    """Sorted distinct frequency texts per key, as an array."""
    kw = kwfreq.select(F.col("id").alias("kw"), F.col("kw").alias("_kw"))
    texts = freq.join(kw, "kw").select(*keys, freq_text(F.col("_kw"), F.col("value")).alias("_t"))
    return texts.groupBy(*keys).agg(F.sort_array(F.collect_set("_t")).alias("freqs"))
