"""Data-quality audits: each returns the offending rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import fullwidth_in_gloss, is_reading, is_written
from lexispark.operators.edits import cycle_members
from lexispark.operators.similar import similar_texts
from lexispark.operators.skew import bucketed_lag, null_safe_join
from lexispark.session import by_entry, kept

Tables = dict[str, DataFrame]
ACTIVE = "stat = 2"
LIVE = "stat = 2 AND NOT unap"


def _without(parents: DataFrame, children: DataFrame, key: str = "id") -> DataFrame:
    return parents.join(children.select(F.col("entr").alias(key)), key, "left_anti")


def _typed(t: Tables, srct: Column) -> DataFrame:
    """Entries whose corpus type meets a condition."""
    src = t["kwsrc"].where(srct).select(F.col("id").alias("src"))
    return t["entr"].join(src, "src", "left_semi")


def approved_with_parent(t: Tables) -> DataFrame:
    """Q1"""
    return t["entr"].where(~F.col("unap") & F.col("dfrm").isNotNull()).select("id")


def parent_cycles(t: Tables) -> DataFrame:
    """Q2"""
    return cycle_members(t["entr"])


def multiple_active(t: Tables) -> DataFrame:
    """Q3"""
    out = (
        t["entr"].where(LIVE)
        .groupBy("src", "seq")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    return out.join(t["kwsrc"].select(F.col("id").alias("src"), "kw"), "src").select("id", "kw", "seq")


def parent_child_differ(t: Tables) -> DataFrame:
    """Q4"""
    kid = t["entr"].where("dfrm IS NOT NULL").select(
        F.col("dfrm").alias("id"), F.col("id").alias("id2"), F.col("src").alias("_src"), F.col("seq").alias("_seq")
    )
    return t["entr"].select("id", "src", "seq").join(kid, "id").where("src <> _src OR seq <> _seq").select("id", "id2")


def gloss_contains(t: Tables, char: str) -> DataFrame:
    return t["gloss"].where(F.col("txt").contains(char)).select(F.col("entr").alias("id"))


def fullwidth_semicolon(t: Tables) -> DataFrame:
    """Q5"""
    return gloss_contains(t, "；")


def fullwidth_space(t: Tables) -> DataFrame:
    """Q6"""
    return gloss_contains(t, "　")


def nothing_to_read(t: Tables) -> DataFrame:
    """Q7"""
    return _without(_without(t["entr"].where(ACTIVE).select("id"), t["rdng"]), t["kanj"])


def no_reading(t: Tables) -> DataFrame:
    """Q8"""
    e = _typed(t, F.col("srct").isin("jmdict", "jmnedict")).where(ACTIVE).select("id")
    return _without(e, t["rdng"])


def no_sense(t: Tables) -> DataFrame:
    """Q9"""
    return _without(_typed(t, F.col("srct") != "kanjidic").select("id"), t["sens"])


def no_gloss(t: Tables) -> DataFrame:
    """Q10"""
    s = t["sens"].select("entr", "sens").join(t["gloss"].select("entr", "sens"), ["entr", "sens"], "left_anti")
    return s.join(t["entr"].select(F.col("id").alias("entr")), "entr", "left_semi").select(F.col("entr").alias("id"), "sens")


def no_pos(t: Tables) -> DataFrame:
    """Q11"""
    bare = t["sens"].select("entr", "sens").join(t["pos"].select("entr", "sens"), ["entr", "sens"], "left_anti")
    e = _typed(t, F.col("srct") == "jmdict").select("id")
    return e.join(bare.select(F.col("entr").alias("id")), "id", "left_semi")


def broken_ordinals(items: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals are not 1..n by first, last and count."""
    agg = items.groupBy(*keys).agg(
        F.min(ordinal).alias("_lo"), F.max(ordinal).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    return agg.where("_lo <> 1 OR _n <> _hi").select(
        F.col(keys[0]).alias("id"), *keys[1:]
    )


def broken_kanji_ordinals(t: Tables) -> DataFrame:
    """Q12"""
    return broken_ordinals(t["kanj"], ["entr"], "kanj")


def broken_reading_ordinals(t: Tables) -> DataFrame:
    """Q13"""
    return broken_ordinals(t["rdng"], ["entr"], "rdng")


def broken_sense_ordinals(t: Tables) -> DataFrame:
    """Q14"""
    return broken_ordinals(t["sens"], ["entr"], "sens")


def broken_gloss_ordinals(t: Tables) -> DataFrame:
    """Q15"""
    return broken_ordinals(t["gloss"], ["entr", "sens"], "gloss")


def gone_without_history(t: Tables) -> DataFrame:
    """Q16"""
    return _without(t["entr"].where(F.col("stat").isin(4, 6)).select("id"), t["hist"])


def xref_to_same_seq(t: Tables) -> DataFrame:
    """Q17"""
    e = t["entr"].select("id", "src", "seq")
    x = t["xref"].join(t["sens"].select("entr", "sens"), ["entr", "sens"], "left_semi")
    x = x.select(F.col("entr").alias("id"), F.col("xentr").alias("id2"))
    target = e.select(F.col("id").alias("id2"), F.col("src").alias("_s"), F.col("seq").alias("_q"))
    return e.join(x, "id").join(target, "id2").where("src = _s AND seq = _q").select("id", "id2")


def nosens_xref_to_other_sense(t: Tables) -> DataFrame:
    """Q18"""
    x = t["xref"].where(F.col("nosens") & (F.col("xsens") != 1))
    x = x.join(t["sens"].select("entr", "sens"), ["entr", "sens"], "left_semi")
    return x.join(t["entr"].select(F.col("id").alias("entr")), "entr", "left_semi").select(F.col("entr").alias("id"))


def _deleted_beside(t: Tables, stat: int) -> DataFrame:
    """Pairs of an approved deleted entry and another entry of the same seq.

    Entries of one (src, seq) are paired only through counts: an entry appears as often as
    the deleted ones of its seq other than itself, so no pair list is formed per key.
    """
    gone = F.expr("stat = 4 AND NOT unap")
    n = t["entr"].where(gone).groupBy("src", "seq").agg(F.count(F.lit(1)).alias("_n"))
    out = t["entr"].where(F.col("stat") == stat).join(n, ["src", "seq"])
    times = F.col("_n") - F.when(gone, 1).otherwise(0)
    return out.where(times > 0).select("id", "src", "seq", times.alias("pairs"))


def deleted_and_active(t: Tables) -> DataFrame:
    """Q19: active entries, with the number of deleted ones beside each."""
    return _deleted_beside(t, 2)


def several_deleted(t: Tables) -> DataFrame:
    """Q20: deleted entries, with the number of other deleted ones beside each."""
    return _deleted_beside(t, 4)


def counter_behind(t: Tables) -> DataFrame:
    """Q21: `counters` has kw and last_value."""
    top = t["entr"].groupBy("src").agg(F.max("seq").alias("seq"))
    top = top.join(t["kwsrc"].select(F.col("id").alias("src"), "kw"), "src")
    out = top.groupBy("kw").agg(F.max("seq").alias("seq")).join(t["counters"], "kw")
    return out.where("seq > last_value").select("kw", "seq", F.col("last_value").alias("counter"))


def sequence_gaps(t: Tables, threshold: int = 150) -> DataFrame:
    """Jumps of at least `threshold` in the numbers of a corpus.

    Equal numbers have gap 0, so with a positive threshold the distinct numbers suffice.
    """
    if threshold < 1:
        raise ValueError("threshold must be positive")
    prev = bucketed_lag(t["entr"].select("src", "seq"), ["src"], "seq")
    gap = F.col("seq") - F.col("previous")
    return prev.select(gap.alias("gap"), "src", "seq", "previous").where(F.col("gap") >= threshold)


# Q24, Q25 ------------------------------------------------------------------------


def _issue(df: DataFrame, code: str, detail: Column | None = None) -> DataFrame:
    d = detail.cast("string") if detail is not None else F.lit(None).cast("string")
    return df.select(F.col("id"), F.lit(code).alias("code"), d.alias("detail"))


def gathered(parts: dict[str, tuple[DataFrame, Column | str, Sequence[Column | str]]]) -> DataFrame:
    """`id` and, for each part (table, key, columns), the array of its rows with that key.

    Rows travel as they are, and those of tables in buckets by entry not at all. A part named like a table that is not
    there can be left out; its array is then missing, so callers ask for what they gave.
    """
    rows = [df.select((F.col(k) if isinstance(k, str) else k).cast("bigint").alias("id"), F.struct(*c).alias(name)) for name, (df, k, c) in parts.items()]
    rows = [by_entry(df.where("id IS NOT NULL"), "id") for df in rows]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return both.groupBy("id").agg(*[F.collect_list(name).alias(name) for name in parts])


def _many(values: Column) -> Column:
    """Values of an array that occur more than once, each once."""
    return F.array_distinct(F.filter(values, lambda v: F.size(F.filter(values, lambda w: w.eqNullSafe(v))) > 1))


def _has(values: Column | str, v: Column) -> Column:
    return F.coalesce(F.array_contains(values, v), F.lit(False))


def _typed_rows(t: Tables) -> DataFrame:
    """Entries with the type of their corpus; `known` tells whether there is one."""
    src = t["kwsrc"].select(F.col("id").alias("src"), "srct", F.lit(True).alias("known"))
    return t["entr"].join(src, "src", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def entry_errors(t: Tables) -> DataFrame:
    """Q24: (id, code, detail) of what makes an entry unacceptable.

    One pass: the rows of an entry in all tables meet once, and each error is a condition
    on its arrays.
    """
    own = [c for c in ("lang", "txt") if c in t["gloss"].columns]
    e = gathered({
        "e": (_typed_rows(t), "id", ["srct", "known"]), "r": (t["rdng"], "entr", ["txt"]), "k": (t["kanj"], "entr", ["txt"]),
        "s": (t["sens"], "entr", ["sens"]), "g": (t["gloss"], "entr", ["sens", *own]), "p": (t["pos"], "entr", ["sens"]),
    })
    is_entry, none = F.size("e") > 0, lambda c: F.size(c) == 0
    jm = F.exists("e", lambda x: F.coalesce(x["srct"] == "jmdict", F.lit(False)))
    issue = lambda code, cond: F.when(cond, F.array(F.struct(F.lit(code).alias("code"), F.lit(None).cast("string").alias("detail")))).otherwise(F.array())
    each = lambda code, values, text: F.transform(values, lambda v: F.struct(F.lit(code).alias("code"), text(v).cast("string").alias("detail")))
    senses = F.col("s.sens")
    found = [
        issue("no_corpus", F.exists("e", lambda x: ~x["known"])), issue("no_reading", jm & none("r")),
        issue("no_reading_or_kanji", is_entry & none("r") & none("k")), issue("no_sense", is_entry & none("s")),
        each("no_gloss", F.filter(senses, lambda s: ~_has("g.sens", s)), lambda s: s),
        F.when(jm, each("no_pos", F.filter(senses, lambda s: ~_has("p.sens", s)), lambda s: s)).otherwise(F.array()),
        each("duplicate_reading", _many(F.col("r.txt")), lambda v: v), each("duplicate_kanji", _many(F.col("k.txt")), lambda v: v),
        each("duplicate_gloss", _many(F.col("g")), lambda v: F.concat_ws(":", v["sens"], v["txt"])),
    ]
    kind = "array<struct<code:string,detail:string>>"
    return e.select("id", F.inline(F.concat(*[f.cast(kind) for f in found])))


def entry_warnings(t: Tables) -> DataFrame:
    """Q25: (id, code, detail) of what a reviewer should look at."""
    bare = t["sens"].select("entr", "sens").join(t["pos"].select("entr", "sens"), ["entr", "sens"], "left_anti")
    wide = t["gloss"].withColumn("_w", fullwidth_in_gloss("txt")).where(F.size("_w") > 0)
    as_id = lambda df: df.withColumn("id", F.col("entr"))
    sim = similar_texts(t["entr"], t["rdng"], t["kanj"])
    jm = _typed(t, F.col("srct") == "jmdict").select("id")
    parts = [
        _issue(sim, "similar", F.concat_ws(":", "kind", "txt", F.col("others").cast("string"))),
        _issue(_without(jm, t["rdng"]), "no_reading"),
        _issue(as_id(t["kanj"].where(~is_written("txt"))), "bad_kanji", F.col("txt")),
        _issue(as_id(t["rdng"].where(~is_reading("txt"))), "bad_reading", F.col("txt")),
        _issue(as_id(bare).join(jm, "id", "left_semi"), "no_pos", F.col("sens")),
        _issue(as_id(wide), "fullwidth_in_gloss", F.concat_ws(":", "sens", F.array_join("_w", ""))),
    ]
    return reduce(DataFrame.unionByName, parts)


# Q26 -----------------------------------------------------------------------------


def violations_unique(df: DataFrame, keys: Sequence[str], where: str | None = None) -> DataFrame:
    src = df if where is None else df.where(where)
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations_foreign_key(child: DataFrame, cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str]) -> DataFrame:
    """Child rows without parent; rows with a null in the key are exempt."""
    p = parent.select(*[F.col(pc).alias(c) for pc, c in zip(parent_cols, cols)])
    full = child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    return full.join(p, list(cols), "left_anti")


# Parents of each child table, as (child, columns, parent, columns).
FOREIGN_KEYS = [
    ("entr", ["src"], "kwsrc", ["id"]), ("entr", ["dfrm"], "entr", ["id"]),
    ("rdng", ["entr"], "entr", ["id"]), ("kanj", ["entr"], "entr", ["id"]),
    ("sens", ["entr"], "entr", ["id"]), ("hist", ["entr"], "entr", ["id"]),
    ("gloss", ["entr", "sens"], "sens", ["entr", "sens"]), ("pos", ["entr", "sens"], "sens", ["entr", "sens"]),
    ("misc", ["entr", "sens"], "sens", ["entr", "sens"]), ("fld", ["entr", "sens"], "sens", ["entr", "sens"]),
    ("dial", ["entr", "sens"], "sens", ["entr", "sens"]), ("lsrc", ["entr", "sens"], "sens", ["entr", "sens"]),
    ("xref", ["entr", "sens"], "sens", ["entr", "sens"]), ("xref", ["xentr", "xsens"], "sens", ["entr", "sens"]),
    ("xresolv", ["entr", "sens"], "sens", ["entr", "sens"]),
    ("kinf", ["entr", "kanj"], "kanj", ["entr", "kanj"]), ("rinf", ["entr", "rdng"], "rdng", ["entr", "rdng"]),
    ("freq", ["entr", "rdng"], "rdng", ["entr", "rdng"]), ("freq", ["entr", "kanj"], "kanj", ["entr", "kanj"]),
    ("restr", ["entr", "rdng"], "rdng", ["entr", "rdng"]), ("restr", ["entr", "kanj"], "kanj", ["entr", "kanj"]),
    ("stagr", ["entr", "sens"], "sens", ["entr", "sens"]), ("stagr", ["entr", "rdng"], "rdng", ["entr", "rdng"]),
    ("stagk", ["entr", "sens"], "sens", ["entr", "sens"]), ("stagk", ["entr", "kanj"], "kanj", ["entr", "kanj"]),
    ("grp", ["entr"], "entr", ["id"]),
]


def constraint_violations(t: Tables) -> DataFrame:
    """Q26: (id, rule, n): violating rows per entry and rule, over the tables given.

    Rows that an entry's own rows decide meet in one pass. Edits and references are also
    sent to the entry they name, and what fails there is summed by the entry it is from.
    """
    children = [c for c in dict.fromkeys(c for c, *_ in FOREIGN_KEYS) if c in t and c != "entr"]
    parts = {"entr": (_typed_rows(t) if "kwsrc" in t else t["entr"], "id", ["id", *(["known"] if "kwsrc" in t else []), "src", "unap", "dfrm"])} if "entr" in t else {}
    for child in children:
        parts[child] = (t[child], "entr", [c for c in t[child].columns if c in ("rdng", "kanj", "sens", "lang", "txt", "rtxt", "ktxt", "entr", "xentr")])
    if "entr" in t:
        parts["edit"] = (t["entr"].where("dfrm IS NOT NULL"), "dfrm", ["id"])
    if "xref" in t:
        parts["target"] = (t["xref"].where("xentr IS NOT NULL AND xsens IS NOT NULL"), "xentr", [F.col("entr").alias("id"), "xsens"])
    e, rules, away = gathered(parts), [], []

    def add(rule: str, n: Column) -> None:
        rules.append(F.struct(F.lit(rule).alias("rule"), n.cast("bigint").alias("n")))

    for child, cols, parent, pcols in FOREIGN_KEYS:
        if child not in t or parent not in t:
            continue
        rule = f"{child}({','.join(cols)}) has no {parent}"
        if parent == "kwsrc":
            add(rule, F.size(F.filter("entr", lambda x: x["src"].isNotNull() & ~x["known"])))
        elif cols == ["dfrm"]:
            away.append((rule, F.when(F.size("entr") == 0, F.col("edit.id"))))
        elif cols == ["xentr", "xsens"]:
            away.append((rule, F.transform(F.filter("target", lambda x: ~_has("sens.sens", x["xsens"])), lambda x: x["id"])))
        elif parent == "entr":
            add(rule, F.when(F.size("entr") == 0, F.size(child)).otherwise(0))
        else:
            add(rule, F.size(F.filter(child, lambda x: x[cols[1]].isNotNull() & ~_has(f"{parent}.{pcols[1]}", x[cols[1]]))))
    for table in ("rdng", "kanj"):
        if table in t:
            add(f"{table}(entr,txt) repeated", F.size(_many(F.col(f"{table}.txt"))))
    if "gloss" in t:
        add("gloss(entr,sens,lang,txt) repeated", F.size(_many(F.transform("gloss", lambda x: F.struct(*[x[c] for c in ("sens", "lang", "txt") if c in t["gloss"].columns])))))
    if "entr" in t:
        add("entr approved with parent", F.size(F.filter("entr", lambda x: x["dfrm"].isNotNull() & ~x["unap"])))
    if "freq" in t:
        add("freq needs reading or kanji, not both", F.size(F.filter("freq", lambda x: x["rdng"].isNull() == x["kanj"].isNull())))
    if "xresolv" in t:
        add("xresolv needs a text", F.size(F.filter("xresolv", lambda x: x["rtxt"].isNull() & x["ktxt"].isNull())))
    if "xref" in t:
        add("xref to its own entry", F.size(F.filter("xref", lambda x: x["entr"] == x["xentr"])))
    here = F.transform(F.filter(F.array(*rules), lambda r: r["n"] > 0), lambda r: F.struct(F.lit(None).cast("bigint").alias("of"), r["rule"].alias("rule"), r["n"].alias("n")))
    one_each = lambda rule: lambda i: F.struct(i.alias("of"), F.lit(rule).alias("rule"), F.lit(1).cast("bigint").alias("n"))
    ids = lambda c: F.coalesce(c.cast("array<bigint>"), F.array().cast("array<bigint>"))
    there = [F.transform(ids(c), one_each(rule)) for rule, c in away]
    found, _ = kept(e.select("id", F.inline(F.concat(here, *there))))  # read twice, made once
    out = found.where("of IS NULL").select("id", "rule", "n")
    if away:
        out = out.unionByName(found.where("of IS NOT NULL").groupBy(F.col("of").alias("id"), "rule").agg(F.sum("n").alias("n")))
    if "entr" in t:
        twice = violations_unique(t["entr"], ["src", "seq"], LIVE)
        hit = null_safe_join(t["entr"].where(LIVE), twice.select("src", "seq"), ["src", "seq"], "left_semi")
        out = out.unionByName(hit.select(F.col("id").cast("bigint").alias("id"), F.lit("entr(src,seq) active twice").alias("rule"), F.lit(1).cast("bigint").alias("n")))
    return out


# Q23 -----------------------------------------------------------------------------

CHECKS: dict[int, tuple[str, Callable[[Tables], DataFrame]]] = {
    1: ("approved but edit of another entry", approved_with_parent),
    2: ("parent cycles", parent_cycles),
    3: ("multiple active entries", multiple_active),
    4: ("edit set with several corpora or numbers", parent_child_differ),
    5: ("fullwidth semicolon in gloss", fullwidth_semicolon),
    6: ("fullwidth space in gloss", fullwidth_space),
    7: ("no readings or kanji", nothing_to_read),
    8: ("no readings", no_reading),
    9: ("no senses", no_sense),
    10: ("no glosses", no_gloss),
    11: ("no part of speech", no_pos),
    12: ("kanji numbers not sequential", broken_kanji_ordinals),
    13: ("reading numbers not sequential", broken_reading_ordinals),
    14: ("sense numbers not sequential", broken_sense_ordinals),
    15: ("gloss numbers not sequential", broken_gloss_ordinals),
    16: ("deleted or rejected without history", gone_without_history),
    17: ("reference to same number", xref_to_same_seq),
    18: ("sense-less reference to other than first sense", nosens_xref_to_other_sense),
    19: ("deleted and active entries together", deleted_and_active),
    20: ("several deleted entries", several_deleted),
    21: ("counter behind", counter_behind),
    22: ("gaps in sequence numbers", sequence_gaps),
}


#: Checks that the rows of one entry decide.
OWN_ROWS = (1, *range(5, 19))


def entry_findings(t: Tables) -> DataFrame:
    """(id, src, check, n): what the checks of OWN_ROWS find in each entry, in one pass.

    The rows of an entry in all tables meet once; `src` is null where there is no entry. A
    reference brings the corpus and number of its target along, from a join of its own.
    """
    target = t["entr"].select(F.col("id").alias("xentr"), F.col("src").alias("_src"), F.col("seq").alias("_seq"))
    x = t["xref"].join(target, "xentr", "left")
    e = gathered({
        "e": (_typed_rows(t), "id", ["src", "srct", "stat", "unap", "dfrm", "seq"]), "r": (t["rdng"], "entr", ["rdng"]), "k": (t["kanj"], "entr", ["kanj"]),
        "s": (t["sens"], "entr", ["sens"]), "p": (t["pos"], "entr", ["sens"]), "h": (t["hist"], "entr", [F.lit(1).alias("one")]),
        "g": (t["gloss"], "entr", ["sens", "gloss", F.col("txt").contains("；").alias("semi"), F.col("txt").contains("　").alias("space")]),
        "x": (x, "entr", ["sens", (F.col("nosens") & (F.col("xsens") != 1)).alias("odd"), "_src", "_seq"]),
    })
    own = lambda cond: F.exists("e", lambda x: F.coalesce(cond(x), F.lit(False)))
    is_entry, none = F.size("e") > 0, lambda c: F.size(c) == 0
    count = lambda arr, cond: F.size(F.filter(arr, lambda x: F.coalesce(cond(x), F.lit(False))))
    once = lambda cond: F.when(cond, 1).otherwise(0)
    broken = lambda values: (F.size(values) > 0) & ((F.array_min(values) != 1) | (F.array_max(values) != F.size(values)))
    of_sense = lambda s: F.transform(F.filter("g", lambda g: g["sens"] == s), lambda g: g["gloss"])
    here, first = lambda x: _has("s.sens", x["sens"]), F.get("e", F.lit(0))
    n = {
        1: once(own(lambda x: ~x["unap"] & x["dfrm"].isNotNull())), 5: count("g", lambda g: g["semi"]), 6: count("g", lambda g: g["space"]),
        7: once(own(lambda x: x["stat"] == 2) & none("r") & none("k")),
        8: once(own(lambda x: x["srct"].isin("jmdict", "jmnedict") & (x["stat"] == 2)) & none("r")), 9: once(own(lambda x: x["srct"] != "kanjidic") & none("s")),
        10: F.when(is_entry, count("s", lambda s: ~_has("g.sens", s["sens"]))).otherwise(0),
        11: once(own(lambda x: x["srct"] == "jmdict") & (count("s", lambda s: ~_has("p.sens", s["sens"])) > 0)),
        12: once(broken(F.col("k.kanj"))), 13: once(broken(F.col("r.rdng"))), 14: once(broken(F.col("s.sens"))),
        15: F.size(F.filter(F.array_distinct("g.sens"), lambda s: broken(of_sense(s)))), 16: once(own(lambda x: x["stat"].isin(4, 6)) & none("h")),
        17: count("x", lambda x: here(x) & (x["_src"] == first["src"]) & (x["_seq"] == first["seq"])),
        18: F.when(is_entry, count("x", lambda x: x["odd"] & here(x))).otherwise(0),
    }
    found = F.array(*[F.struct(F.lit(k).alias("check"), v.cast("bigint").alias("n")) for k, v in n.items()])
    return e.select("id", first["src"].alias("src"), F.inline(F.filter(found, lambda f: f["n"] > 0)))


def number_findings(t: Tables) -> DataFrame:
    """(src, check, n) of the checks that compare entries of one number: 3, 19 and 20, from
    one count by number."""
    e = t["entr"].where("src IS NOT NULL AND seq IS NOT NULL")
    count = lambda cond: F.count_if(F.expr(cond))
    n = e.groupBy("src", "seq").agg(count(LIVE).alias("live"), count("stat = 4 AND NOT unap").alias("gone"), count("stat = 2").alias("active"), count("stat = 4").alias("deleted"))
    n = n.join(t["kwsrc"].select(F.col("id").alias("src"), F.lit(1).alias("known")), "src", "left")
    found = {3: F.when((F.col("live") > 1) & F.col("known").isNotNull(), 1).otherwise(0), 19: F.col("gone") * F.col("active"), 20: F.col("gone") * (F.col("deleted") - 1)}
    return n.select("src", F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("bigint").alias("n")) for k, v in found.items()])))


def audit_report(
    t: Tables, checks: Sequence[int] = (), exclude: bool = False, corpus: int | None = None
) -> DataFrame:
    """Q23: (check, title, failures, passed) of the chosen checks, as one job.

    `checks` selects, or with `exclude` leaves out; `corpus` keeps failures whose `id` is
    an entry of that corpus (checks without ids are not restricted). Checks on an entry's
    own rows come from one pass over all tables, those on numbers from one count.
    """
    chosen = [n for n in CHECKS if (not checks or (n in checks) != exclude) and (n != 21 or "counters" in t)]
    parts = []
    for group, make in ((OWN_ROWS, entry_findings), ((3, 19, 20), number_findings)):
        if set(group) & set(chosen):
            found = make(t) if corpus is None else make(t).where(F.col("src") == corpus)
            parts.append(found.select("check", "n"))
    for n in chosen:
        if n in (2, 4, 21, 22):
            bad = CHECKS[n][1](t)
            if corpus is not None and "id" in bad.columns:
                bad = bad.join(t["entr"].where(F.col("src") == corpus).select("id"), "id", "left_semi")
            parts.append(bad.select(F.lit(n).alias("check"), F.lit(1).cast("bigint").alias("n")))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(CHECKS[n][0]).alias("title")) for n in chosen])).alias("c")
    titles = t["entr"].sparkSession.range(1).select(names).select("c.*")
    sums = reduce(DataFrame.unionByName, parts).groupBy("check").agg(F.sum("n").alias("n"))
    failures = F.coalesce("n", F.lit(0)).cast("bigint")
    return titles.join(sums, "check", "left").select("check", "title", failures.alias("failures"), (failures == 0).alias("passed"))


def audit_rows(t: Tables, check: int, corpus: int | None = None, limit: int | None = None) -> DataFrame:
    """Q23: failing rows of one check, with the display limit of the report."""
    bad = CHECKS[check][1](t)
    if corpus is not None and "id" in bad.columns:
        bad = bad.join(t["entr"].where(F.col("src") == corpus).select("id"), "id", "left_semi")
    return bad.limit(limit) if limit else bad
