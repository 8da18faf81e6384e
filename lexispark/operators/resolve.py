"""Resolving textual references to entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.functions.text import is_written
from lexispark.operators.pairs import no_kanji_readings, valid_pairs
from lexispark.operators.skew import null_safe_join

REF = ["entr", "sens", "typ", "ord"]
_KEY = ["kind", "rkey", "kkey"]
_PLACE = ["tsrc", "tstat", "tunap", "rdng", "kanj", "nokanji"]
_GROUP = [*_KEY, *_PLACE]


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _targets(t: dict[str, DataFrame]) -> DataFrame:
    """Every way an entry can be named: reading and kanji together, or one of them."""
    ns = t["sens"].groupBy(F.col("entr").alias("id")).agg(F.count(F.lit(1)).alias("nsens"))
    e = t["entr"].select(
        "id", F.col("src").alias("tsrc"), F.col("stat").alias("tstat"), F.col("unap").alias("tunap")
    ).join(ns, "id", "left").withColumn("nsens", F.coalesce("nsens", F.lit(0)))
    rdng, kanj = t["rdng"], t["kanj"]
    has_kanji = kanj.select("entr").distinct().withColumn("_k", F.lit(True))
    bare = rdng.join(has_kanji, "entr", "left").withColumn("nokanji", F.col("_k").isNull())
    if "restr" in t:
        pairs = valid_pairs(rdng, kanj, t["restr"], "rdng", "kanj")
        denied = no_kanji_readings(t["entr"].withColumn("seq", F.lit(0)), rdng, kanj, t["restr"])
        denied = denied.select(F.col("id").alias("entr"), "rdng", F.lit(True).alias("_d"))
        bare = bare.join(denied, ["entr", "rdng"], "left").withColumn(
            "nokanji", F.col("nokanji") | F.coalesce("_d", F.lit(False))
        )
    else:
        pairs = rdng.select("entr", "rdng", F.col("txt").alias("ltxt")).join(
            kanj.select("entr", "kanj", F.col("txt").alias("rtxt")), "entr"
        )
    both = pairs.select(
        F.col("entr").alias("id"), F.lit("rk").alias("kind"), F.col("ltxt").alias("rkey"),
        F.col("rtxt").alias("kkey"), "rdng", "kanj", F.lit(False).alias("nokanji"),
    )
    r = bare.select(
        F.col("entr").alias("id"), F.lit("r").alias("kind"), F.col("txt").alias("rkey"), F.lit("").alias("kkey"),
        "rdng", _null("int").alias("kanj"), "nokanji",
    )
    k = kanj.select(
        F.col("entr").alias("id"), F.lit("k").alias("kind"), F.lit("").alias("rkey"), F.col("txt").alias("kkey"),
        _null("int").alias("rdng"), "kanj", _null("boolean").alias("nokanji"),
    )
    return both.unionByName(r).unionByName(k).join(e, "id")


def _with_keys(refs: DataFrame) -> DataFrame:
    kind = F.concat(
        F.when(F.col("rtxt").isNotNull(), "r").otherwise(""), F.when(F.col("ktxt").isNotNull(), "k").otherwise("")
    )
    return refs.withColumns(
        {"kind": kind, "rkey": F.coalesce("rtxt", F.lit("")), "kkey": F.coalesce("ktxt", F.lit(""))}
    )


def _groups(named: DataFrame, exact: bool, ok: Column) -> DataFrame:
    """One row per way to be named, corpus, status and position: entries in the group, lowest
    id and most senses, and the sums that give the entry left when one of two goes.

    `exact` adds what is lowest and most without the first ones, in groups of three and more.
    """
    top = named.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("nentr"), F.min("id").alias("_id1"), F.max(F.struct("nsens", "id")).alias("_s1"),
        F.sum(F.col("id").cast("decimal(38,0)")).alias("_ids"), F.sum("nsens").alias("_nss"),
    )
    if not exact:
        top = top.withColumns({"_id2": _null("bigint"), "_s2": _null("bigint")})
    else:
        large = top.where("nentr > 2").select(*_GROUP, "_id1", "_s1")
        second = null_safe_join(named, large, _GROUP).groupBy(*_GROUP).agg(
            F.min(F.when(F.col("id") != F.col("_id1"), F.col("id"))).alias("_id2"),
            F.max(F.when(F.col("id") != F.col("_s1.id"), F.col("nsens"))).alias("_s2"),
        )
        top = null_safe_join(top, second, _GROUP, "left")
    return top.withColumn("_ok", F.coalesce(ok, F.lit(False)))


def _grouped_candidates(refs: DataFrame, named: DataFrame, groups: DataFrame, exact: bool) -> DataFrame:
    """`refs` (with `_KEY`) with `_c`, the groups of possible targets as an array of structs.

    Fields: tsrc, tstat, tunap, rdng, kanj, nokanji, targ (lowest id), nentr (entries in the
    group), nsens (most senses), ok, and times (rows that the group stands for). An entry is
    never its own target.

    Entries are grouped by text *before* the join, and a text's groups are one row: a
    reference stays one row, however many entries share its text. Groups that contain the
    referring entry are corrected in that row. A group left with one entry follows from
    the sums; `exact` also finds the lowest id and most senses of larger ones, which the
    choice of a target never looks at.
    """
    own = named.groupBy(F.col("id").alias("entr")).agg(F.collect_list(F.struct(*_KEY, *_PLACE, "nsens")).alias("_own"))
    mine = F.filter("_own", lambda o: F.forall(F.array(*[o[c] == F.col(c) for c in _KEY]), lambda x: x))
    # Without the referring entry, a group is the same for all references to a text.
    plain = F.struct(*_PLACE, F.col("_id1").alias("targ"), "nentr", F.col("_s1.nsens").alias("nsens"), F.col("_ok").alias("ok"), F.lit(1).alias("times"))
    sums = F.struct(F.col("_s1.id").alias("most"), "_ids", "_nss", "_id2", "_s2")
    texts = groups.groupBy(*_KEY).agg(F.collect_list(F.struct(plain.alias("g"), sums.alias("s"))).alias("_groups"))
    out = refs.join(own, "entr", "left").withColumn("_own", F.when(F.size("_own") > 0, mine)).join(texts, _KEY, "left")

    def corrected(x: Column) -> Column:
        g, s = x["g"], x["s"]
        same = F.filter("_own", lambda o: F.forall(F.array(*[o[c].eqNullSafe(g[c]) for c in _PLACE]), lambda y: y))
        times, sense = F.size(same), F.get(same, F.lit(0))["nsens"]
        n = g["nentr"] - F.when(times > 0, 1).otherwise(0)
        pair = (times > 0) & (n == 1)
        targ = F.when(pair, (s["_ids"] - F.col("entr")).cast("bigint"))
        nsens = F.when(pair, s["_nss"] - sense)
        if exact:
            targ = targ.when((times > 0) & (g["targ"] == F.col("entr")), s["_id2"])
            nsens = nsens.when((times > 0) & (s["most"] == F.col("entr")), s["_s2"])
        return F.struct(
            *[g[c].alias(c) for c in _PLACE], targ.otherwise(g["targ"]).alias("targ"), n.alias("nentr"),
            nsens.otherwise(g["nsens"]).alias("nsens"), g["ok"].alias("ok"), F.greatest(times, F.lit(1)).alias("times"),
        )

    left = F.filter(F.transform("_groups", corrected), lambda g: g["nentr"] > 0)
    return out.withColumn("_c", F.when(F.size("_own") > 0, left).otherwise(F.col("_groups.g"))).drop("_own", "_groups")


def reference_candidates(refs: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """R1 (a) / U1: references with groups of possible targets, one row of nulls where
    nothing but the referring entry itself matched.

    Adds tsrc, tstat, tunap, rdng, kanj, nokanji, targ, nentr and nsens. Whether a reference
    is found is known from the number of its groups, so only references are shuffled, and
    groups are made rows at the end.
    """
    named = _targets(targets)
    groups = _groups(named, True, F.lit(True))
    heads = groups.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_list(F.when(F.col("nentr") == 1, F.col("_id1"))).alias("_lone")
    )
    others = F.coalesce("_n", F.lit(0)) > F.coalesce(F.size(F.filter("_lone", lambda i: i == F.col("entr"))), F.lit(0))
    v = _with_keys(refs.dropna(subset=REF)).join(heads, _KEY, "left").withColumn("_here", others).drop("_n", "_lone")
    v = v.repartition("entr").distinct().withColumn("_f", F.max("_here").over(W.partitionBy(*REF))).where("_here OR NOT _f")
    out = _grouped_candidates(v, named, groups, exact=True).withColumn("_c", F.explode_outer("_c"))
    return out.select(*refs.columns, *[f"_c.{c}" for c in (*_PLACE, "targ", "nentr", "nsens")])


def resolve_references(
    xresolv: DataFrame, source: DataFrame, targets: dict[str, DataFrame],
    source_filter: Column | None = None, target_filter: Column | None = None,
    start: int | None = None, stop: int | None = None, active_only: bool = False,
) -> DataFrame:
    """Outcome of every reference, and its resolved edge where there is one.

    `source_filter` is a condition on `src`, `target_filter` on `tsrc` (null passes).
    Outcomes: rule1 the only candidate; rule2 first reading of an entry without kanji;
    rule3 first reading or kanji; rule4 any single candidate; not_found; ambiguous;
    sense_too_big; filtered_out (source not selected, or all candidates rejected).
    """
    src = source.select(F.col("id").alias("entr"), "src", F.col("stat").alias("_stat"), F.col("unap").alias("_unap"))
    refs = xresolv.join(src, "entr")
    take = F.col("_stat") == 2
    if active_only:
        take = take & ~F.col("_unap")
    if source_filter is not None:
        take = take & source_filter
    if start is not None:
        take = take & (F.col("entr") >= start)
    if stop is not None:
        take = take & (F.col("entr") < stop)
    refs = refs.withColumn("_take", take)
    ok = F.col("tstat").isNull() | (F.col("tstat") == 2)
    if target_filter is not None:
        ok = ok & (F.col("tsrc").isNull() | target_filter)
    named = _targets(targets)
    taken = _with_keys(refs.where("_take").select(*REF, "rtxt", "ktxt"))
    cands = _grouped_candidates(taken, named, _groups(named, False, ok), exact=False)

    # A group that held only the referring entry stands for "nothing found" unless
    # another group of the reference matched.
    def pick(g: Column) -> Column:
        single = g["nentr"] == 1
        first = (F.col("rtxt").isNotNull() & (g["rdng"] == 1)) | (F.col("ktxt").isNotNull() & (g["kanj"] == 1))
        rule = (
            F.when(single & F.col("ktxt").isNull() & (g["rdng"] == 1) & g["nokanji"], 2)
            .when(single & F.coalesce(first, F.lit(False)), 3)
            .when(single, 4)
        )
        return F.when(rule.isNotNull(), F.struct(rule.alias("rule"), *[g[c].alias(c) for c in ("targ", "rdng", "kanj", "nsens")]))

    fit = F.filter("_c", lambda g: g["ok"])
    cands = cands.select(
        *REF, (F.coalesce(F.size("_c"), F.lit(0)) > 0).alias("_any"),
        F.coalesce(F.aggregate(fit, F.lit(0), lambda n, g: n + g["times"]), F.lit(0)).alias("_rows"),
        F.array_min(F.transform(fit, pick)).alias("_p"),
    )
    per_ref = cands.groupBy(*REF).agg(F.max("_any").alias("_any"), F.sum("_rows").alias("_rows"), F.min("_p").alias("_p"))
    out = refs.join(per_ref, REF, "left")
    sense = F.when(F.coalesce("tsens", F.lit(0)) == 0, 1).otherwise(F.col("tsens"))
    outcome = (
        F.when(~F.col("_take"), "filtered_out")
        .when(~F.col("_any"), "not_found")
        .when(F.col("_rows") == 0, "filtered_out")
        .when(F.col("_p").isNull(), "ambiguous")
        .when(sense > F.col("_p.nsens"), "sense_too_big")
        .when(F.col("_rows") == 1, "rule1")
        .otherwise(F.concat(F.lit("rule"), F.col("_p.rule").cast("string")))
    )
    done = outcome.startswith("rule")
    only = lambda c: F.when(done, c)
    no_tsens = F.coalesce("tsens", F.lit(0)) == 0
    notes = [F.col("notes")] if "notes" in xresolv.columns else []
    return out.select(
        *REF, *notes, outcome.alias("outcome"),
        only(F.col("_p.targ")).alias("xentr"), only(sense).cast("int").alias("xsens"),
        only(F.col("_p.rdng")).alias("rdng"), only(F.col("_p.kanj")).alias("kanj"),
        only(no_tsens & (F.col("_p.nsens") != 1)).alias("nosens"),
        only(~F.coalesce("prio", F.lit(True))).alias("lowpri"),
    )


def resolved_xrefs(resolution: DataFrame) -> DataFrame:
    """Rows for the reference table; the ordinal of the reference becomes the edge's."""
    return resolution.where(F.col("outcome").startswith("rule")).drop("outcome").withColumnRenamed("ord", "xref")


def drop_resolved(
    xresolv: DataFrame, xref: DataFrame, source: DataFrame, target: DataFrame,
    source_filter: Column | None = None, target_filter: Column | None = None,
    start: int | None = None, stop: int | None = None, active_only: bool = False,
) -> DataFrame:
    """R2: references left after those with an edge of the same (entr, sens, typ, ordinal).

    Edges count only under the same filters as in R1.
    """
    s = source.where("stat = 2")
    if active_only:
        s = s.where(~F.col("unap"))
    if source_filter is not None:
        s = s.where(source_filter)
    if start is not None:
        s = s.where(F.col("id") >= start)
    if stop is not None:
        s = s.where(F.col("id") < stop)
    t = target.where("stat = 2").select(F.col("id").alias("xentr"), F.col("src").alias("tsrc"))
    if target_filter is not None:
        t = t.where(target_filter)
    x = xref.join(s.select(F.col("id").alias("entr")), "entr", "left_semi").join(t.select("xentr"), "xentr", "left_semi")
    return xresolv.join(x.select("entr", "sens", "typ", F.col("xref").alias("ord")), REF, "left_anti").select(*xresolv.columns)


def detect_script(refs: DataFrame) -> DataFrame:
    """R3 `detect`: a lone text goes to the side its script belongs to."""
    lone_k = F.col("ktxt").isNotNull() & F.col("rtxt").isNull()
    lone_r = F.col("rtxt").isNotNull() & F.col("ktxt").isNull()
    swap = (lone_k & ~is_written("ktxt")) | (lone_r & is_written("rtxt"))
    return refs.withColumns(
        {
            "ktxt": F.when(swap, F.col("rtxt")).otherwise(F.col("ktxt")),
            "rtxt": F.when(swap, F.col("ktxt")).otherwise(F.col("rtxt")),
        }
    )


def resolve_strict(
    refs: DataFrame, t: dict[str, DataFrame], one_entry: bool = True, one_sense: bool = False,
    detect: bool = False, keys: Sequence[str] = REF,
) -> tuple[DataFrame, DataFrame]:
    """(edges, failures) of references that must name one sequence number.

    `refs` has the key columns, rtxt, ktxt, `senses` (array, null for all), `enum` and
    `corpus`; `enum` is a sequence number when a corpus is given, else an entry id.
    Failures carry `error`: no_text, not_found, multiple_entries, sense_missing or
    several_senses.

    Equal lookups are answered once: a text asked by many references joins its entries
    once, and only answers with one sequence number are expanded to senses.
    """
    if detect:
        refs = detect_script(refs)
    look = ["kind", "rkey", "kkey", "corpus", "enum"]
    v = _with_keys(refs)
    asked = v.select(*look).distinct()
    ns = t["sens"].groupBy(F.col("entr").alias("id")).agg(F.count(F.lit(1)).alias("ns"))
    e = t["entr"].where("stat = 2").select("id", "src", "seq").join(ns, "id", "left")
    e = e.withColumn("ns", F.coalesce("ns", F.lit(0)))
    r = t["rdng"].select(F.col("entr").alias("id"), "rdng", F.col("txt").alias("rkey"))
    k = t["kanj"].select(F.col("entr").alias("id"), "kanj", F.col("txt").alias("kkey"))
    blank = F.lit("")
    names = (
        r.join(k, "id").select("id", F.lit("rk").alias("kind"), "rkey", "kkey", "rdng", "kanj")
        .unionByName(r.select("id", F.lit("r").alias("kind"), "rkey", blank.alias("kkey"), "rdng", _null("int").alias("kanj")))
        .unionByName(k.select("id", F.lit("k").alias("kind"), blank.alias("rkey"), "kkey", _null("int").alias("rdng"), "kanj"))
    )
    named = e.join(names, "id")
    same = ["kind", "rkey", "kkey"]
    in_corpus = asked.where("kind <> '' AND corpus IS NOT NULL").join(
        named.withColumn("corpus", F.col("src")), [*same, "corpus"]
    ).where("enum IS NULL OR seq = enum")
    anywhere = asked.where("kind <> '' AND corpus IS NULL").join(named, same).where("enum IS NULL OR id = enum")
    # Named by number only: the first reading and kanji stand for the entry.
    one = lambda df, o: df.groupBy(F.col("entr").alias("id")).agg(F.min(o).alias(o))
    heads = e.join(one(t["rdng"], "rdng"), "id", "left").join(one(t["kanj"], "kanj"), "id", "left")
    by_seq = asked.where("kind = '' AND corpus IS NOT NULL AND enum IS NOT NULL").join(
        heads.withColumns({"corpus": F.col("src"), "enum": F.col("seq")}), ["corpus", "enum"]
    )
    by_id = asked.where("kind = '' AND corpus IS NULL AND enum IS NOT NULL").join(
        heads.withColumn("enum", F.col("id")), "enum"
    )
    cols = [*look, "id", "seq", "ns", "rdng", "kanj"]
    hits = in_corpus.select(*cols)
    for part in (anywhere, by_seq, by_id):
        hits = hits.unionByName(part.select(*cols))
    facts = hits.groupBy(*look).agg(
        F.min("seq").alias("_q1"), F.max("seq").alias("_q2"), F.min("ns").alias("_ns1"), F.max("ns").alias("_ns2")
    )
    v = null_safe_join(v, facts, look, "left")
    listed = F.coalesce(F.size("senses"), F.lit(0)) > 0
    several = F.col("_q1") != F.col("_q2")
    error = (
        F.when((F.col("kind") == "") & F.col("enum").isNull(), "no_text")
        .when(F.col("_q1").isNull(), "not_found")
        .when(several & (F.lit(one_entry) | listed), "multiple_entries")
        .when(listed & ((F.array_min("senses") < 1) | (F.array_max("senses") > F.col("_ns1"))), "sense_missing")
        .when(~listed & F.lit(one_sense) & (F.col("_ns2") > 1), "several_senses")
    )
    v = v.withColumn("error", error)
    good = v.where("error IS NULL").select(*keys, *look, "senses")
    edges = null_safe_join(good, hits.select(*look, "id", "rdng", "kanj"), look)
    edges = edges.join(t["sens"].select(F.col("entr").alias("id"), F.col("sens").alias("xsens")), "id")
    edges = edges.where(
        F.col("senses").isNull() | (F.size("senses") == 0) | F.expr("array_contains(senses, xsens)")
    )
    done = edges.select(*keys, F.col("id").alias("xentr"), "xsens", "rdng", "kanj")
    return done, v.where("error IS NOT NULL").select(*keys, "error")
