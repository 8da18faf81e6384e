"""Inflection tables.

Everything is built inside rows: an entry's readings, spellings and deny lists are arrays
beside its parts of speech. The rules are a small table, stored first, with the forms of a
conjugation's four kinds in order; after the one join of allowed pairs with it nothing is
shuffled, whatever is asked for: all forms, their texts, or the table of a conjugation's
four texts. Each form of a pair is made once, where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.session import kept


def conjugation_grid(conj: DataFrame, conjo: DataFrame, kwpos: DataFrame) -> DataFrame:
    """Part of speech, conjugation, polarity and politeness of every rule."""
    p = kwpos.select(F.col("id").alias("pos"), F.col("kw").alias("ptxt"))
    c = conj.select(F.col("id").alias("conj"), F.col("name").alias("ctxt"))
    return conjo.join(c, "conj").join(p, "pos").select("pos", "ptxt", "conj", "ctxt", "neg", "fml")


def _by_entry(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Merged with the entries, not broadcast: the size of compressed files says little about
    the arrays a driver would hold."""
    return rows.groupBy("entr").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias(name)).hint("merge")


def allowed_pairs(
    entr: DataFrame, sens: DataFrame, pos: DataFrame, rdng: DataFrame, kanj: DataFrame, restr: DataFrame, stagr: DataFrame, stagk: DataFrame
) -> DataFrame:
    """(id, seq, src, unap, pos, knum, ktxt, rnum, rtxt): each reading with each spelling of
    an entry, for every part of speech of a sense in which all three deny lists allow them.

    An entry without spellings, or without readings, has pairs with that side null. Each
    table is aggregated by entry once; pairs are made and checked inside the entry's row.
    """
    e = entr.select(F.col("id").alias("entr"), "seq", "src", "unap")
    e = e.join(_by_entry(pos.select("entr", "sens", F.col("kw").alias("pos")), "tagged", "pos", "sens"), "entr")
    e = e.join(_by_entry(sens.select("entr", "sens"), "senses", "sens"), "entr")
    e = e.withColumn("tagged", F.filter("tagged", lambda t: F.array_contains("senses.sens", t["sens"]))).drop("senses")
    sides = [(rdng, "r", "rdng"), (kanj, "k", "kanj")]
    for table, name, ordinal in sides:
        e = e.join(_by_entry(table.select("entr", F.col(ordinal).alias("num"), "txt"), name, "num", "txt"), "entr", "left")
    for table, name, a, b in [(restr, "no_pair", "rdng", "kanj"), (stagr, "no_reading", "sens", "rdng"), (stagk, "no_kanji", "sens", "kanj")]:
        e = e.join(_by_entry(table.select("entr", F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")), name, "a", "b"), "entr", "left")
    denied = lambda name, a, b: F.exists(F.coalesce(name, F.array().cast("array<struct<a:int,b:int>>")), lambda x: (x["a"] == a) & (x["b"] == b))
    one = lambda name, side: F.coalesce(name, F.array(F.lit(None).cast(dict(e.dtypes)[side][6:-1])))
    pairs = F.flatten(F.transform(one("r", "r"), lambda r: F.transform(one("k", "k"), lambda k: F.struct(r.alias("r"), k.alias("k")))))
    e = e.withColumn("pairs", F.filter(pairs, lambda p: ~F.coalesce(denied("no_pair", p["r"]["num"], p["k"]["num"]), F.lit(False))))
    e = e.withColumn("pos", F.explode(F.array_distinct("tagged.pos")))
    of_pos = F.transform(F.filter("tagged", lambda t: t["pos"] == F.col("pos")), lambda t: t["sens"])
    may = lambda p, s: ~denied("no_reading", s, p["r"]["num"]) & ~denied("no_kanji", s, p["k"]["num"])
    e = e.withColumn("in_senses", of_pos)
    e = e.withColumn("pair", F.explode(F.filter("pairs", lambda p: F.exists("in_senses", lambda s: F.coalesce(may(p, s), F.lit(True))))))
    return e.select(
        F.col("entr").alias("id"), "seq", "src", "unap", "pos", F.col("pair.k.num").alias("knum"), F.col("pair.k.txt").alias("ktxt"),
        F.col("pair.r.num").alias("rnum"), F.col("pair.r.txt").alias("rtxt"),
    )


def _kind(neg: Column, fml: Column) -> Column:
    return F.concat(F.when(neg, "neg").otherwise("aff"), F.lit("-"), F.when(fml, "polite").otherwise("plain"))


def rules_of_pos(kwpos: DataFrame, conj: DataFrame, conjo: DataFrame, conjo_notes: DataFrame) -> DataFrame:
    """(pos, ptxt, conj, ctxt, KINDS): a row per part of speech and conjugation; a column for
    each kind of form with its rules in order of their number, null if there is none. Rules
    without an ending are left out."""
    keys = ["pos", "conj", "neg", "fml", "onum"]
    notes = conjo_notes.groupBy(*keys).agg(F.sort_array(F.collect_list("note")).alias("notes"))
    rule = conjo.where("okuri IS NOT NULL").join(notes, keys, "left").withColumn("t", _kind(F.col("neg"), F.col("fml")))
    form = F.struct("onum", "neg", "fml", "stem", "okuri", "euphr", "euphk", "notes")
    mine = lambda t: F.sort_array(F.collect_list(F.when(F.col("t") == t, form)))
    of_conj = rule.groupBy("pos", "conj").agg(*[mine(t).alias(t) for t in KINDS])
    of_conj = of_conj.select("pos", "conj", *[F.when(F.size(F.col(f"`{t}`")) > 0, F.col(f"`{t}`")).alias(t) for t in KINDS])
    rules = of_conj.join(conj.select(F.col("id").alias("conj"), F.col("name").alias("ctxt")), "conj")
    return rules.join(kwpos.select(F.col("id").alias("pos"), F.col("kw").alias("ptxt")), "pos")


def _inflected(text: Column, rule: Column, euph: Column) -> Column:
    """Text without its stem letters, or one letter more and the changed sound, plus ending."""
    cut = lambda n: F.substring(text, F.lit(1), F.greatest(F.length(text) - n, F.lit(0)))
    return F.concat(F.coalesce(F.concat(cut(rule["stem"] + 1), euph), cut(rule["stem"])), rule["okuri"])


def _form(rule: Column, t: Column) -> Column:
    # A verb whose last letter but one is not hiragana is written with kanji to its end.
    sound = F.when(F.col("on_kanji"), rule["euphk"]).otherwise(rule["euphr"])
    return F.struct(
        rule["neg"].alias("neg"), rule["fml"].alias("fml"), t.alias("t"), rule["onum"].alias("onum"), _inflected(F.col("ktxt"), rule, sound).alias("kitxt"),
        _inflected(F.col("rtxt"), rule, rule["euphr"]).alias("ritxt"), rule["notes"].alias("notes"),
    )


# What names a row of the table, and its columns.
FORM_KEYS = ["id", "pos", "knum", "rnum", "conj"]
FOLLOWING = ["seq", "src", "unap", "ptxt", "ktxt", "rtxt", "ctxt"]
TEXT_KEYS = ["id", "seq", "src", "unap", "pos", "ptxt", "knum", "ktxt", "rnum", "rtxt", "conj", "ctxt"]
FORM = ["neg", "fml", "t", "onum", "kitxt", "ritxt", "notes"]
KINDS = ["aff-plain", "aff-polite", "neg-plain", "neg-polite"]


def paradigms(
    entr: DataFrame, sens: DataFrame, pos: DataFrame, kwpos: DataFrame, rdng: DataFrame, kanj: DataFrame,
    conj: DataFrame, conjo: DataFrame, conjo_notes: DataFrame,
    restr: DataFrame, stagr: DataFrame, stagk: DataFrame,
) -> DataFrame:
    """TEXT_KEYS, ``on_kanji`` and KINDS: a row per allowed pair and conjugation, with the
    rules of each kind; what is made of them makes the forms."""
    pairs = allowed_pairs(entr, sens, pos, rdng, kanj, restr, stagr, stagk).withColumn("on_kanji", F.col("ktxt").rlike("[^あ-ん].$"))
    rules, _ = kept(rules_of_pos(kwpos, conj, conjo, conjo_notes))
    return pairs.join(rules, "pos").select(*TEXT_KEYS, "on_kanji", *[f"`{t}`" for t in KINDS])


def _by_kind(rows: DataFrame) -> DataFrame:
    """A row for each kind of form that a conjugation has: `t` and its `rules`."""
    kinds = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"`{t}`").alias("rules")) for t in KINDS])
    return rows.select(*TEXT_KEYS, "on_kanji", F.inline(kinds)).where("rules IS NOT NULL")


def inflect(*tables: DataFrame) -> DataFrame:
    """Every inflected form of every allowed kanji/reading pair; tables as of paradigms."""
    rows = _by_kind(paradigms(*tables)).withColumn("rule", F.explode("rules"))
    form = _form(F.col("rule"), F.col("t"))
    return rows.select(*TEXT_KEYS, *[form[c].alias(c) for c in FORM])


def _with_forms(inflections: DataFrame) -> DataFrame:
    """Rows of inflect put together again."""
    rest = [F.any_value(c).alias(c) for c in FOLLOWING]
    return inflections.groupBy(*FORM_KEYS).agg(*rest, F.collect_list(F.struct(*FORM)).alias("forms"))


def _word(f: Column) -> Column:
    """`kanji【kana】 [notes]` of a form."""
    around = lambda text, *marks: F.concat(F.lit(marks[0]), text, F.lit(marks[1]))
    return F.concat(
        F.coalesce(F.concat(f["kitxt"], around(F.coalesce(f["ritxt"], F.lit("")), "【", "】")), f["ritxt"], F.lit("")),
        F.coalesce(around(F.array_join(f["notes"], ","), " [", "]"), F.lit("")),
    )


def _words(rules: Column, t: Column) -> Column:
    """The forms that rules of one kind make, each on its line; null if there is none."""
    one = lambda rule: _word(_form(rule, t))
    more = F.when(F.size(rules) > 1, F.array_join(F.transform(rules, one), ",\n"))
    return F.when(F.size(rules) == 1, one(F.get(rules, F.lit(0)))).otherwise(more)


def _variants(t: Column | str) -> Column:
    """The forms of one kind, each on its line; null if there is none."""
    some = F.array_sort(F.filter("forms", lambda f: f["t"] == t), lambda a, b: F.when(a["onum"] < b["onum"], -1).when(a["onum"] > b["onum"], 1).otherwise(0))
    return F.when(F.size(some) > 0, F.array_join(F.transform(some, _word), ",\n"))


def inflection_text(inflections: DataFrame) -> DataFrame:
    """Variants of a form in one text, each on its line; from inflect or paradigms."""
    if "on_kanji" in inflections.columns:
        return _by_kind(inflections).select(*TEXT_KEYS, "t", _words(F.col("rules"), F.col("t")).alias("word"))
    rows = _with_forms(inflections).withColumn("t", F.explode(F.array_distinct("forms.t")))
    return rows.select(*TEXT_KEYS, "t", _variants(F.col("t")).alias("word"))


def inflection_table(inflections: DataFrame) -> DataFrame:
    """One row per conjugation: w0 plain, w1 polite, w2 negative, w3 negative polite;
    from the rows of inflect or of paradigms."""
    if "on_kanji" in inflections.columns:
        word = lambda t: _words(F.col(f"`{t}`"), F.lit(t))
    else:
        inflections, word = _with_forms(inflections), lambda t: _variants(F.lit(t))
    return inflections.select(*TEXT_KEYS, *[word(t).alias(f"w{i}") for i, t in enumerate(KINDS)])


def inflection_notes(kwpos: DataFrame, conjo: DataFrame, conjo_notes: DataFrame, conotes: DataFrame) -> DataFrame:
    """C4: distinct notes of each part of speech."""
    used = conjo_notes.select("pos", "note").distinct().join(conjo.select("pos"), "pos", "left_semi")
    p = kwpos.select(F.col("id").alias("pos"), F.col("kw").alias("ptxt"))
    return used.join(p, "pos").join(conotes.select(F.col("id").alias("note"), "txt"), "note").select(
        "pos", "ptxt", F.col("note").alias("id"), "txt"
    )
