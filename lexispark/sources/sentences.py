"""Sentence pairs to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.functions.text import KANA, KANJI, is_reading, script_class, square_index
from lexispark.operators.skew import spread_row_number
from lexispark.session import cut
from lexispark.sources.records import number_in_file_order, read_lines

USES = 6

def _cut_end(x: Column, opening: str, closing: str) -> tuple[Column, Column]:
    """A text without the bracket it ends with, and what that bracket held (or null)."""
    has = x.endswith(closing) & x.contains(opening)
    at = F.instr(x, opening)
    return F.when(has, F.substring(x, F.lit(1), at - 1)).otherwise(x), F.when(has, F.substring(x, at + 1, F.length(x) - at - 1))


def pair_lines(lines: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(a_n, a, b): each `A: ` line with the next `B: ` line; other lines are skipped.

    An A line pairs with the first B line after it unless an earlier A line still waits
    for one, so the A lines that count are those whose previous A or B line is a B line
    (or nothing).  Looking back is done within blocks of line numbers; the last marked
    line of a block is handed to the next by one row per block.
    """
    text = F.regexp_replace("value", "^﻿", "")
    kind = F.when(text.startswith("A: "), "A").when(text.startswith("B: "), "B")
    rows = lines.select("n", kind.alias("kind"), F.trim(F.substring(text, 4, 1 << 30)).alias("txt")).where("kind IS NOT NULL")
    rows = rows.withColumn("_b", F.floor(F.col("n") / block))
    w = W.partitionBy("_b").orderBy("n")
    last = F.struct("n", "kind", "txt")
    ends = rows.groupBy("_b").agg(F.max_by(last, "n").alias("_end"), F.max_by(F.when(F.col("kind") == "A", last), F.when(F.col("kind") == "A", F.col("n"))).alias("_a"))
    # One row per block of lines: a few million at most even for very large inputs.
    carried = ends.select("_b", F.lag("_end").over(W.orderBy("_b")).alias("_before"))
    rows = rows.join(carried, "_b", "left").withColumn("_prev", F.coalesce(F.lag(last).over(w), F.col("_before")))
    starts = rows.where((F.col("kind") == "A") & (F.col("_prev").isNull() | (F.col("_prev.kind") == "B")))
    closes = rows.where((F.col("kind") == "B") & (F.col("_prev.kind") == "A"))
    # Between a start and its close there are only further A lines: number both alike.
    s = spread_row_number(starts.select("n", F.col("txt").alias("a")), [], [F.col("n")], "_i")
    c = spread_row_number(closes.select(F.col("n").alias("b_n"), F.col("txt").alias("b")), [], [F.col("b_n")], "_i")
    return s.join(c, "_i").where("b_n > n").select(F.col("n").alias("a_n"), "a", "b")


def _item(x: Column) -> Column:
    """Parts of an item, word(reading)[sense]...{form}~, taken off from its end."""
    prio = x.endswith("~")
    y, form = _cut_end(F.when(prio, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x), "{", "}")
    parts = F.split(y, r"\[")
    senses = F.slice(parts, 2, 1 << 30)
    k, r = _cut_end(F.get(parts, F.lit(0)), "(", ")")
    wrong = F.exists(senses, lambda s: ~s.endswith("]") | F.substring(s, F.lit(1), F.length(s) - 1).try_cast("int").isNull())
    bad = (k == "") | (r == "") | (form == "") | wrong | (F.translate(k, "([{~", "") != k)
    last = F.rtrim(F.element_at(senses, -1), F.lit("]"))
    return F.struct(x.alias("raw"), F.coalesce(bad, wrong | (k == "") | (F.translate(k, "([{~", "") != k)).alias("bad"), k.alias("k"), r.alias("r"), F.when(F.size(senses) > 0, last).alias("s"), form.alias("form"), prio.alias("prio"))


def read_sentence_pairs(spark: SparkSession, path: str, src: int = 1) -> dict[str, DataFrame]:
    """Entries of sentence pairs with unresolved references to their words.

    The number of a pair comes from its two sentence numbers; of equal numbers the first
    is kept.  Items in bad form, or whose form is not in the sentence, are dropped, and
    with them pairs left without items.  `warnings` tells which.
    """
    lines = number_in_file_order(read_lines(spark, path))
    p = pair_lines(lines)
    # An A line is `japanese TAB english #ID=n_m`.
    mark = F.split(F.translate(F.substring_index("a", "#", -1), " \t", ""), "[=_]")
    num = lambda i: F.when(F.col("a").contains("#") & (F.get(mark, F.lit(0)) == "ID") & (F.size(mark) == 3), F.get(mark, F.lit(i)).try_cast("bigint"))
    p = p.withColumns({"en": num(1), "jp": num(2)})
    p = p.withColumn("en", F.when(F.col("jp").isNotNull(), F.col("en"))).withColumn("jp", F.when(F.col("en").isNotNull(), F.col("jp")))
    body = F.when(F.col("en").isNotNull(), F.substring(F.col("a"), F.lit(1), F.length("a") - F.length(F.substring_index("a", "#", -1)) - 1)).otherwise(F.col("a"))
    p = p.withColumn("_en", F.substring_index(body, "\t", -1)).withColumn("body", body)
    both = F.col("body").contains("\t") & (F.trim("_en") != "")
    p = p.withColumns({"jtxt": F.when(both, F.ltrim(F.substring(F.col("body"), F.lit(1), F.length("body") - F.length("_en") - 1))).otherwise(""), "etxt": F.when(both, F.rtrim("_en")).otherwise("")}).drop("_en")
    p = p.withColumn("seq", square_index("en", "jp", base=1))
    items = F.transform(F.filter(F.split("b", r"\s+"), lambda x: x != ""), _item)
    kana = lambda c: is_reading(c) & (script_class(c).bitwiseAND(F.lit(KANA)) != 0) & (script_class(c).bitwiseAND(F.lit(KANJI)) == 0)
    error = lambda i: (
        F.when(i["bad"], "bad_item").when(i["r"].isNotNull() & ~is_reading(i["r"]), "reading_not_kana")
        .when(kana(i["k"]) & i["r"].isNotNull(), "double_kana").when(i["form"].isNotNull() & (F.instr(F.col("jtxt"), i["form"]) == 0), "form_not_in_sentence")
    )
    p = p.withColumn("items", F.transform(items, lambda i: i.withField("error", error(i))))
    good = F.filter("items", lambda i: i["error"].isNull())
    problem = F.when(F.col("en").isNull(), "no_id").when(F.col("jtxt") == "", "bad_a_line").when(F.size(good) == 0, "no_items")
    p = cut(p.withColumns({"good": good, "problem": problem}))
    ok = p.where("problem IS NULL").select("a_n", "seq", "jtxt", "etxt", "good")
    # Which line of equal numbers is first, then only those lines go on.
    keep = ok.groupBy("seq").agg(F.min("a_n").alias("a_n"))
    e = ok.join(keep, ["seq", "a_n"], "left_semi")
    e = spread_row_number(e, [], [F.col("a_n")], "entr").withColumn("entr", F.col("entr").cast("bigint"))
    reading = is_reading("jtxt")
    # Of several sense numbers the last one counts.
    senses = lambda i: F.when(i["s"].isNotNull(), F.array(i["s"].try_cast("int"))).otherwise(F.array().cast("array<int>"))
    flip = lambda i: kana(i["k"]) & i["r"].isNull()
    one = lambda i, t: F.struct(
        F.when(~flip(i), i["k"]).alias("ktxt"), F.when(flip(i), i["k"]).otherwise(i["r"]).alias("rtxt"), t.alias("tsens"), i["form"].alias("notes"), i["prio"].alias("prio")
    )
    refs = F.flatten(F.transform("good", lambda i: F.when(F.size(senses(i)) > 0, F.transform(senses(i), lambda t: one(i, t))).otherwise(F.array(one(i, F.lit(None).cast("int"))))))
    null = lambda t: F.lit(None).cast(t)
    x = e.select("entr", F.posexplode(refs).alias("_i", "x"))
    dup = ok.join(keep, ["seq", "a_n"], "left_anti").select("a_n", "seq", F.lit("duplicate").alias("code"), null("string").alias("detail"))
    warn = p.select("a_n", "seq", F.explode("items").alias("i")).where("i.error IS NOT NULL").select("a_n", "seq", F.col("i.error").alias("code"), F.col("i.raw").alias("detail"))
    bad = p.where("problem IS NOT NULL").select("a_n", "seq", F.col("problem").alias("code"), null("string").alias("detail"))
    return {
        "entr": e.select(
            F.col("entr").alias("id"), F.lit(src).alias("src"), F.lit(2).alias("stat"), "seq", null("bigint").alias("dfrm"), F.lit(False).alias("unap"),
            F.col("a_n").cast("string").alias("srcnote"), null("string").alias("notes"), null("bigint").alias("idx"),
        ),
        "rdng": e.where(reading).select("entr", F.lit(1).alias("rdng"), F.col("jtxt").alias("txt")),
        "kanj": e.where(~reading).select("entr", F.lit(1).alias("kanj"), F.col("jtxt").alias("txt")),
        "sens": e.select("entr", F.lit(1).alias("sens"), null("string").alias("notes")),
        "gloss": e.select("entr", F.lit(1).alias("sens"), F.lit(1).alias("gloss"), F.lit(1).alias("lang"), F.lit(1).alias("ginf"), F.col("etxt").alias("txt")),
        "xresolv": x.select(
            "entr", F.lit(1).alias("sens"), (F.col("_i") + 1).cast("int").alias("ord"), F.lit(USES).alias("typ"), "x.rtxt", "x.ktxt", "x.tsens",
            null("int").alias("vsrc"), null("bigint").alias("vseq"), "x.notes", "x.prio",
        ),
        "warnings": warn.unionByName(bad).unionByName(dup),
    }
