"""Literal rows for what the bridge does not reach."""

import datetime as dt

import pytest
from compared_rows import tuples
from pyspark.sql import functions as F

from lexispark.operators import audit, clips, counts, edits, inflect, pairs, refs, resolve, search, similar, skew, summary

ENTR = "id BIGINT, src INT, stat INT, seq BIGINT, dfrm BIGINT, unap BOOLEAN"


# --- skew helpers ------------------------------------------------------------------


def test_spread_row_number_equals_window(spark):
    df = spark.range(2000).selectExpr("IF(id < 1500, 0, id % 7) AS k", "hash(id) AS v", "id")
    got = skew.spread_row_number(df, ["k"], [F.col("v"), F.col("id")], "rn", slices=8)
    want = df.selectExpr("k", "v", "id", "CAST(row_number() OVER (PARTITION BY k ORDER BY v, id) AS INT) AS rn")
    assert tuples(got, "k", "v", "id", "rn") == tuples(want)
    flat = skew.spread_row_number(df.select("id"), [], [F.col("id")], "rn", slices=5)
    assert all(r.rn == r.id + 1 for r in flat.collect())


def test_bucketed_lag_equals_window(spark):
    df = spark.range(800).selectExpr("CAST(IF(id % 3 = 0, 0, id % 5) AS INT) AS src", "id * id % 9000 AS seq")
    got = skew.bucketed_lag(df, ["src"], "seq", width=64)
    want = df.distinct().selectExpr("src", "seq", "lag(seq) OVER (PARTITION BY src ORDER BY seq) AS previous")
    assert tuples(got) == tuples(want)


# --- pairs and summaries -----------------------------------------------------------


def test_headword_rules(rows):
    e = rows("id BIGINT", (1,), (2,), (3,), (4,), (5,), (6,))
    r = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (3, 1, "a"), (3, 2, "b"), (4, 1, "a"), (4, 2, "b"), (5, 1, "a"), (5, 2, "b"))
    k = rows("entr BIGINT, kanj INT, txt STRING", (2, 1, "K"), (3, 1, "K"), (4, 1, "K"), (5, 1, "K"), (5, 2, "L"))
    restr = rows("entr BIGINT, rdng INT, kanj INT", (3, 1, 1), (5, 1, 1))
    misc = rows("entr BIGINT, sens INT, kw INT", (4, 1, 22))
    stagr = rows("entr BIGINT, sens INT, rdng INT", (4, 1, 1))
    got = pairs.choose_headword(e, r, k, restr, misc, stagr, uk=22)
    assert tuples(got) == [(1, 1, None), (2, None, 1), (3, 1, None), (4, 2, None), (5, 2, 1), (6, None, None)]


def test_headwords_drop_entries_without_first_ordinal(rows):
    e = rows("id BIGINT, seq BIGINT", (1, 1), (2, 2), (3, 3))
    r = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (2, 2, "b"))
    k = rows("entr BIGINT, kanj INT, txt STRING")
    assert tuples(summary.headwords(e, r, k), "id", "rtxt", "ktxt") == [(1, "a", None), (3, None, None)]


def test_entry_summary_nulls(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False))
    none = lambda s: rows(s)
    sens = rows("entr BIGINT, sens INT, notes STRING", (1, 1, None))
    got = summary.entry_summary(e, none("entr BIGINT, rdng INT, txt STRING"), none("entr BIGINT, kanj INT, txt STRING"), sens,
                                none("entr BIGINT, sens INT, gloss INT, txt STRING"), none("entr BIGINT, kw INT, value INT"))
    # A sense without gloss counts and gives an empty text; no sense gives null.
    assert tuples(got, "id", "gloss", "nsens", "p") == [(1, "", 1, False), (2, None, 0, False)]


# --- search ------------------------------------------------------------------------


def test_search_groups(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False), (3, 1, 4, 3, None, False))
    pos = rows("entr BIGINT, sens INT, kw INT", (1, 1, 5), (1, 2, 6), (2, 1, 5))
    misc = rows("entr BIGINT, sens INT, kw INT", (1, 2, 9), (3, 1, 9))
    t = {"pos": pos, "misc": misc}
    c = lambda table, cond, **kw: search.Condition(table, cond, **kw)
    # Different tables are independent: the two tags come from different senses.
    assert tuples(search.search(e, t, [c("pos", F.col("kw") == 5), c("misc", F.col("kw") == 9)])) == [(1,)]
    # The same table must be met by one row, unless the aliases differ.
    assert tuples(search.search(e, t, [c("pos", F.col("kw") == 5), c("pos", F.col("sens") == 2)])) == []
    assert tuples(search.search(e, t, [c("pos", F.col("kw") == 5, alias="a"), c("pos", F.col("sens") == 2, alias="b")])) == [(1,)]
    either = [c("pos", F.col("kw") == 6), c("misc", F.col("kw") == 9)]
    assert tuples(search.search(e, t, either, any_of=True)) == [(1,)]
    outer = [c("pos", F.col("kw") == 6, outer=True), c("misc", F.col("kw") == 9, outer=True)]
    assert tuples(search.search(e, t, outer, any_of=True)) == [(1,), (3,)]


def test_criteria():
    c = search.SearchCriteria(src=["jm"], texts=[search.TextCriterion("家", "kanj", "starts")], which=-1)
    assert search.SearchCriteria.from_json(c.to_json()) == c
    with pytest.raises(AttributeError):
        c.colour = 1
    with pytest.raises(search.UnknownTag):
        search.corpus_selector("nosuch", {"jm": 1})
    assert search.page_size(None) == 100 and search.page_size(0) == 100 and search.page_size(5000, most=5000) == 5000
    with pytest.raises(ValueError):
        search.page_size(5000)


def test_invert_forms(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False))
    t = {"entr": e, "rdng": rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (1, 2, "b"), (2, 1, "a"))}
    ask = lambda inv: tuples(search.search_entries(t, search.SearchCriteria(texts=[search.TextCriterion("a", "rdng", "is", inv)])))
    assert ask("any_row") == [(1,)] and ask("no_row") == [] and ask(False) == [(1,), (2,)]


# --- audits ------------------------------------------------------------------------


def test_cycles(rows):
    # 1->2->3->1 is a ring, 4 hangs on it, 5->6 is a chain, 7 points at itself.
    e = rows(ENTR, *[(i, 1, 2, i, d, True) for i, d in ((1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None), (7, 7))])
    assert tuples(audit.parent_cycles({"entr": e})) == [(1,), (2,), (3,), (7,)]
    assert tuples(audit.approved_with_parent({"entr": e.withColumn("unap", F.lit(False))}))[0] == (1,)


def test_gloss_audits(rows):
    g = rows("entr BIGINT, sens INT, gloss INT, lang INT, txt STRING", (1, 1, 1, 1, "a；b"), (2, 1, 1, 1, "a　b"), (3, 1, 1, 1, "ok"), (3, 1, 2, 1, "ok"), (3, 1, 3, 2, "ok"))
    s = rows("entr BIGINT, sens INT", (1, 1), (2, 1), (3, 1), (3, 2))
    e = rows(ENTR, *[(i, 1, 2, i, None, False) for i in (1, 2, 3)])
    src = rows("id INT, kw STRING, srct STRING", (1, "jm", "jmdict"))
    r = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "か"), (2, 1, "abc"), (3, 1, "か"))
    k = rows("entr BIGINT, kanj INT, txt STRING", (1, 1, "か"))
    p = rows("entr BIGINT, sens INT, kw INT", (1, 1, 1), (2, 1, 1), (3, 1, 1))
    t = {"entr": e, "gloss": g, "sens": s, "kwsrc": src, "rdng": r, "kanj": k, "pos": p}
    assert tuples(audit.fullwidth_semicolon(t)) == [(1,)] and tuples(audit.fullwidth_space(t)) == [(2,)]
    assert tuples(audit.no_gloss(t)) == [(3, 2)]
    assert tuples(audit.entry_errors(t)) == [(3, "duplicate_gloss", "1:ok"), (3, "no_gloss", "2"), (3, "no_pos", "2")]
    warn = tuples(audit.entry_warnings(t))
    assert (1, "bad_kanji", "か") in warn and (2, "bad_reading", "abc") in warn and (1, "fullwidth_in_gloss", "1:；") in warn
    assert (1, "similar", "rdng:か:1") in warn and (3, "similar", "rdng:か:1") in warn


def test_counter_and_water(rows):
    e = rows(ENTR, (1, 1, 2, 50, None, False), (2, 1, 2, 900, None, False), (3, 2, 2, 7, None, False))
    k = rows("id INT, kw STRING, seq STRING, smin BIGINT, smax BIGINT", (1, "a", "qa", 10, 100), (2, "b", "qb", None, None), (3, "c", "qc", 5, 9))
    assert tuples(counts.sequence_high_water(e, k), "id", "top") == [(1, 50), (2, 7), (3, 5)]
    c = rows("kw STRING, last_value BIGINT", ("a", 60), ("b", 7))
    assert tuples(audit.counter_behind({"entr": e, "kwsrc": k, "counters": c})) == [("a", 900, 60)]
    new = rows(ENTR, (10, 1, 2, None, None, False), (11, 1, 2, None, None, False), (12, 3, 2, None, None, False), (13, 2, 2, 99, None, False))
    assert tuples(edits.assign_seq(new, e, k), "id", "seq") == [(10, 51), (11, 52), (12, 6), (13, 99)]


# --- similar -----------------------------------------------------------------------


def test_similar(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False), (3, 1, 4, 3, None, False), (4, 2, 2, 4, None, False), (5, 1, 2, 1, None, True))
    r = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (4, 1, "a"), (5, 1, "a"))
    k = rows("entr BIGINT, kanj INT, txt STRING", (2, 1, "K"))
    c = rows("cid INT, src INT, seq BIGINT, kind STRING, txt STRING", (1, 1, 1, "rdng", "a"), (1, 1, 1, "kanj", "K"), (2, 1, None, "rdng", "a"))
    assert tuples(similar.similar_entries(c, e, r, k)) == [(1, 2), (2, 1), (2, 2), (2, 5)]
    assert tuples(similar.similar_texts(e, r, k)) == [(1, "rdng", "a", 1), (2, "rdng", "a", 2), (3, "rdng", "a", 3), (5, "rdng", "a", 1)]


# --- clips -------------------------------------------------------------------------


def test_align_clips(rows):
    lab = rows("file INT, lab INT, strt BIGINT, leng BIGINT, trns STRING", (1, 1, 0, 100, "a"), (1, 2, 200, 100, "b"), (1, 3, 500, 10, "c"), (2, 1, 0, 100, "a"))
    clip = rows("file INT, id INT, strt BIGINT, leng BIGINT, trns STRING",
                (1, 10, 0, 100, "a"), (1, 11, 190, 60, "x"), (1, 12, 250, 60, "y"), (1, 13, 510, 10, "c"), (1, 14, 90, 20, "z"))
    done, rest = clips.align_clips(lab, clip, bin_width=32)
    assert tuples(done, "file", "lab", "clip", "action") == [(1, 1, 10, "Skip"), (1, 2, 11, "Update"), (1, 3, None, "Add"), (2, 1, None, "Add")]
    assert tuples(rest, "id") == [(12,), (13,), (14,)]


# --- references --------------------------------------------------------------------

XREF = "entr BIGINT, sens INT, xref INT, typ INT, xentr BIGINT, xsens INT, notes STRING"


def edge(n, target, sense, entry=7):
    return (entry, 1, n, 3, target, sense, None)


@pytest.mark.parametrize("edges,targets,want", [
    # all of a number's entries are meant, by one edge to each: the first says so
    ([edge(1, 31, 1), edge(2, 32, 1), edge(3, 33, 1)], [(31, 2, False), (32, 2, True), (33, 2, False)], [True, False, False]),
    # one of three is left out
    ([edge(1, 31, 1), edge(2, 33, 1)], [(31, 2, False), (32, 2, False), (33, 2, False)], [None, None]),
    # a deleted target makes no set; the living one is a set of its own
    ([edge(1, 31, 2)], [(31, 4, False)], [None]),
    ([edge(1, 32, 2)], [(31, 4, False), (32, 2, False)], [True]),
    # two senses of a single target stand for themselves
    ([edge(1, 31, 1), edge(2, 31, 4)], [(31, 2, True)], [True, True]),
    # two referring entries don't add up
    ([edge(1, 31, 1), edge(1, 32, 1, entry=8)], [(31, 2, False), (32, 2, False)], [None, None]),
])
def test_seq_xrefs(rows, edges, targets, want):
    e = rows(ENTR, *[(i, 1, s, 12345, None, u) for i, s, u in targets])
    out = refs.mark_seq_xrefs(refs.xref_sense_lists(rows(XREF, *edges)), e)
    assert [r.seq_xref for r in out.orderBy("entr", "sens", "xref").collect()] == want


def test_directions(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False), (3, 1, 4, 3, None, False), (4, 1, 2, 4, 2, True))
    x = rows("entr BIGINT, sens INT, typ INT, xentr BIGINT, xsens INT, lowpri BOOLEAN",
             (1, 1, 3, 2, 1, False), (2, 1, 3, 1, 1, False), (1, 2, 3, 3, 1, False), (1, 1, 3, 4, 1, False), (2, 2, 3, 1, 2, True))
    got = tuples(refs.merge_xref_directions(e, x, drop_unapproved=True), "entr", "sens", "xentr", "xsens", "direc")
    assert got == [(1, 1, 2, 1, 0), (2, 1, 1, 1, 0), (2, 2, 1, 2, 1), (3, 1, 1, 2, -1), (4, 1, 1, 1, -1)]


# --- resolution --------------------------------------------------------------------


def _lexicon(rows):
    return {
        "entr": rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False), (3, 1, 2, 3, None, False), (4, 1, 4, 4, None, False), (5, 1, 2, 5, None, False)),
        "rdng": rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (2, 1, "b"), (2, 2, "a"), (3, 1, "x"), (3, 2, "c"), (5, 1, "y"), (5, 3, "c"), (4, 1, "d")),
        "kanj": rows("entr BIGINT, kanj INT, txt STRING", (2, 1, "K"), (3, 1, "L"), (5, 1, "M")),
        "sens": rows("entr BIGINT, sens INT", (1, 1), (2, 1), (2, 2), (3, 1), (5, 1)),
        "restr": rows("entr BIGINT, rdng INT, kanj INT"),
    }


REFS = "entr BIGINT, sens INT, typ INT, ord INT, rtxt STRING, ktxt STRING, tsens INT, prio BOOLEAN"


def test_resolution_rules(rows):
    t = _lexicon(rows)
    x = rows(
        REFS,
        (1, 1, 3, 1, "b", "K", None, None),  # both texts: the only candidate
        (3, 1, 3, 1, "a", None, None, True),  # two positions, one without kanji: rule 2
        (1, 1, 3, 3, "c", None, None, False),  # neither is a first reading: rule 4
        (1, 1, 3, 4, "zz", None, None, None),
        (1, 1, 3, 5, "d", None, None, None),  # only a deleted entry
        (1, 1, 3, 6, "b", None, 5, None),  # sense out of range
        (1, 1, 3, 7, "a", None, None, None),  # itself is not a candidate: entry 2 is left
        (4, 1, 3, 8, "b", None, None, None),  # source is not active
    )
    got = tuples(resolve.resolve_references(x, t["entr"], t), "ord", "entr", "outcome", "xentr", "xsens", "rdng", "nosens", "lowpri")
    assert got == [
        (1, 1, "rule1", 2, 1, 1, True, False), (1, 3, "rule2", 1, 1, 1, False, False), (3, 1, "rule4", 3, 1, 2, False, True),
        (4, 1, "not_found", None, None, None, None, None), (5, 1, "filtered_out", None, None, None, None, None),
        (6, 1, "sense_too_big", None, None, None, None, None), (7, 1, "rule1", 2, 1, 2, True, False),
        (8, 4, "filtered_out", None, None, None, None, None),
    ]


def test_candidates_never_the_entry_itself(rows):
    t = _lexicon(rows)
    t["rdng"] = rows("entr BIGINT, rdng INT, txt STRING", *[(i, 1, "s") for i in (1, 2, 3, 5)])
    t["kanj"] = rows("entr BIGINT, kanj INT, txt STRING")
    x = rows(REFS, (1, 1, 3, 1, "s", None, None, None), (2, 1, 3, 1, "s", None, None, None), (9, 1, 3, 1, "s", None, None, None))
    got = tuples(resolve.reference_candidates(x, t), "entr", "nentr", "targ", "nsens")
    assert got == [(1, 3, 2, 2), (2, 3, 1, 1), (9, 4, 1, 2)]
    t["rdng"] = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "s"))
    assert tuples(resolve.reference_candidates(x.where("entr = 1"), t), "entr", "nentr", "targ") == [(1, None, None)]


def test_candidates_of_repeated_references(rows):
    """A reference with several texts is found if one is; rows that come twice count twice in
    the choice of a rule, and not as candidates."""
    t = _lexicon(rows)
    t["entr"] = t["entr"].where("id <= 3 AND stat = 2")
    t["rdng"] = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "s"), (2, 1, "s"), (2, 1, "s"), (3, 2, "u"), (3, 2, "u"))
    t["kanj"] = rows("entr BIGINT, kanj INT, txt STRING")
    x = rows(
        REFS, (1, 1, 3, 1, "s", None, None, None), (1, 1, 3, 1, "no", None, None, None), (1, 1, 3, 1, "s", None, None, None), (2, 1, 3, 1, "s", None, None, None),
        (3, 1, 3, 1, "u", None, None, None), (3, 1, 3, 2, None, None, None, None), (None, 1, 3, 1, "s", None, None, None))
    got = tuples(resolve.reference_candidates(x, t), "entr", "ord", "rdng", "nentr", "targ")
    assert got == [(1, 1, 1, 2, 2), (2, 1, 1, 2, 1), (3, 1, 2, 1, 3), (3, 2, None, None, None)]
    outcomes = tuples(resolve.resolve_references(x, t["entr"], t), "entr", "ord", "outcome")
    assert outcomes == [(1, 1, "ambiguous"), (1, 1, "ambiguous"), (1, 1, "ambiguous"), (2, 1, "ambiguous"), (3, 1, "rule4"), (3, 2, "not_found")]


def test_candidates_without_a_row_for_each_group(rows, spark):
    """References are shuffled as one row each: groups are made rows after the last shuffle."""
    t = _lexicon(rows)
    out = resolve.reference_candidates(rows(REFS, (9, 1, 3, 1, "s", None, None, None)), t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_c" in plan and plan.index("Generate explode(_c") < plan.index("Join")


def test_strict_resolution(rows):
    t = _lexicon(rows)
    q = rows("entr INT, sens INT, typ INT, ord INT, rtxt STRING, ktxt STRING, senses ARRAY<INT>, enum BIGINT, corpus INT",
             (0, 1, 3, 1, "b", "K", None, None, None), (0, 1, 3, 2, "b", None, [2], None, 1), (0, 1, 3, 3, "a", None, None, None, None),
             (0, 1, 3, 4, None, None, None, None, None), (0, 1, 3, 5, "d", None, None, None, None), (0, 1, 3, 6, "b", None, [3], None, None),
             (0, 1, 3, 7, None, None, None, 2, 1), (0, 1, 3, 8, "a", None, None, 1, None), (0, 1, 3, 9, "a", None, None, 1, 1))
    edges, bad = resolve.resolve_strict(q, t)
    assert tuples(edges, "ord", "xentr", "xsens", "rdng", "kanj") == [
        (1, 2, 1, 1, 1), (1, 2, 2, 1, 1), (2, 2, 2, 1, None), (7, 2, 1, 1, 1), (7, 2, 2, 1, 1), (8, 1, 1, 1, None), (9, 1, 1, 1, None)]
    assert tuples(bad, "ord", "error") == [(3, "multiple_entries"), (4, "no_text"), (5, "not_found"), (6, "sense_missing")]
    loose, bad2 = resolve.resolve_strict(q.where("ord IN (1, 3)"), t, one_entry=False, one_sense=True)
    assert tuples(bad2, "ord", "error") == [(1, "several_senses"), (3, "several_senses")]
    swapped = resolve.detect_script(rows("rtxt STRING, ktxt STRING", ("家", None), (None, "いえ"), ("いえ", "家")))
    assert tuples(swapped) == [("いえ", "家"), ("いえ", None), (None, "家")]


# --- conjugation -------------------------------------------------------------------


def test_inflection(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False))
    r = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "たべる"), (2, 1, "くる"))
    k = rows("entr BIGINT, kanj INT, txt STRING", (1, 1, "食べる"), (2, 1, "来る"))
    s = rows("entr BIGINT, sens INT", (1, 1), (2, 1))
    p = rows("entr BIGINT, sens INT, kw INT", (1, 1, 28), (2, 1, 45))
    kwpos = rows("id INT, kw STRING", (28, "v1"), (45, "vk"))
    conj = rows("id INT, name STRING", (2, "Past"))
    o = "pos INT, conj INT, neg BOOLEAN, fml BOOLEAN, onum INT, stem INT, okuri STRING, euphr STRING, euphk STRING"
    conjo = rows(o, (28, 2, False, False, 1, 1, "た", None, None), (28, 2, True, False, 1, 1, "なかった", None, None), (45, 2, False, False, 1, 1, "た", "き", "来"))
    notes = rows("pos INT, conj INT, neg BOOLEAN, fml BOOLEAN, onum INT, note INT", (28, 2, False, False, 1, 3), (28, 2, False, False, 1, 1))
    no = lambda a, b: rows(f"entr BIGINT, {a} INT, {b} INT")
    out = inflect.inflect(e, s, p, kwpos, r, k, conj, conjo, notes, no("rdng", "kanj"), no("sens", "rdng"), no("sens", "kanj"))
    assert tuples(out, "id", "t", "kitxt", "ritxt", F.col("notes").cast("string")) == [
        (1, "aff-plain", "食べた", "たべた", "[1, 3]"), (1, "neg-plain", "食べなかった", "たべなかった", None), (2, "aff-plain", "来た", "きた", None)]
    table = inflect.inflection_table(out)
    assert tuples(table, "id", "w0", "w1", "w2") == [(1, "食べた【たべた】 [1,3]", None, "食べなかった【たべなかった】"), (2, "来た【きた】", None, None)]


# --- edit trees --------------------------------------------------------------------


def _tree(rows):
    #  1 <- 2 <- 3,  2 <- 4 <- 5;  6 alone and unapproved;  7 approved alone;  8 <-> 9 ring
    return rows(ENTR, *[(i, 1, 2, 1, d, u) for i, d, u in (
        (1, None, False), (2, 1, True), (3, 2, True), (4, 2, True), (5, 4, True), (6, None, True), (7, None, False), (8, 9, True), (9, 8, True), (10, 99, True))])


def test_edit_trees(rows):
    e = _tree(rows)
    base = edits.edit_base_paths(e)
    s = lambda df: sorted((r.root, list(r.path)) for r in df.collect())
    assert s(base) == [(1, [1, 2]), (1, [1, 2, 3]), (1, [1, 2, 4]), (1, [1, 2, 4, 5]), (6, [6])]
    paths = edits.edit_paths(base, e)
    assert s(paths) == [(1, [1, 2, 3]), (1, [1, 2, 4, 5]), (6, [6])]
    three = edits.entry_edit_paths(paths, rows("id BIGINT", (3,), (6,)))
    assert sorted((r.id, list(r.path)) for r in three.collect()) == [(3, [1, 2, 3]), (3, [1, 2, 4, 5])]
    assert tuples(edits.edit_leafs(paths)) == [(1, 3), (1, 5), (2, 3), (2, 5), (3, 3), (4, 5), (5, 5), (6, 6)]
    where = edits.edit_positions(e)
    pos = {r.id: r for r in where.collect()}
    lists = {r.id: r for r in edits.edit_tails(where, e).collect()}
    assert [lists[i].tail for i in (1, 2, 3, 4, 5)] == [None, None, None, [5], None]
    assert lists[5].segment == [4, 5] and lists[3].segment == [3] and lists[4].segment is None and lists[6].segment == [6]
    assert [(i, pos[i].n_leafs, pos[i].n_paths) for i in sorted(pos)] == [(1, 2, 2), (2, 2, 2), (3, 1, 2), (4, 1, 2), (5, 1, 2), (6, 1, 1)]
    assert [(pos[i].leaf, pos[i].tail_length, pos[i].segment_length, pos[i].segment_top, pos[i].segment_second) for i in (4, 5, 6)] == [(5, 1, None, None, None), (5, 0, 2, 4, 5), (6, 0, 1, 6, None)]
    tree = {r.id: r for r in edits.edit_tree(e).collect()}
    assert {i: (t.root, t.depth, t["size"]) for i, t in tree.items()} == {1: (1, 1, 5), 2: (1, 2, 4), 3: (1, 3, 1), 4: (1, 3, 2), 5: (1, 4, 1), 6: (6, 1, 1), 7: (7, 1, 1)}
    assert [i for i in pos if pos[i].approvable] == [6]
    assert tuples(edits.descendants(e, rows("id BIGINT", (2,), (8,)))) == [(2,), (3,), (4,), (5,), (8,), (9,)]


def test_edit_positions_of_a_deep_chain_and_a_wide_entry(spark, rows):
    n, wide = 10_000, 3_000
    chain = spark.range(1, n + 1).selectExpr("id", "if(id > 1, id - 1, null) AS dfrm", "id > 1 AS unap")
    fan = spark.range(n + 2, n + 2 + wide).selectExpr("id", f"CAST({n + 1} AS BIGINT) AS dfrm", "true AS unap")
    top = rows("id BIGINT, dfrm BIGINT, unap BOOLEAN", (n + 1, None, False))
    at = edits.edit_positions(chain.unionByName(fan).unionByName(top)).cache()
    assert at.count() == n + wide + 1
    assert at.where(f"id <= {n} AND root = 1 AND n_leafs = 1 AND leaf = {n} AND tail_length = {n} - id AND depth = id").count() == n
    assert tuples(at.where(f"id = {n}"), "segment_length", "segment_top", "segment_second", "approvable") == [(n, 1, 2, True)]
    assert at.where(f"id > {n + 1} AND n_paths = {wide} AND segment_length = 1 AND segment_top = id AND NOT approvable").count() == wide
    assert list(edits.edit_tails(at, rows("id BIGINT", (n - 2,))).first().tail) == [n - 1, n]
    at.unpersist()


def test_history_and_freq(rows):
    h = rows("entr BIGINT, hist INT, stat INT, unap BOOLEAN, dt TIMESTAMP_NTZ, name STRING, notes STRING, eid BIGINT",
             (1, 1, 2, False, dt.datetime(2020, 1, 1), "a", None, None), (1, 2, 2, False, dt.datetime(2020, 1, 2), "b", "n", 1))
    links = rows("entr BIGINT, parent BIGINT", (5, 1), (6, None))
    info = rows("entr BIGINT, stat INT, unap BOOLEAN, dt TIMESTAMP_NTZ, name STRING", (5, 4, True, dt.datetime(2021, 1, 1, 1, 1, 1, 500000), "c"), (6, 2, True, dt.datetime(2021, 1, 1), "d"))
    got = edits.append_history(h, links, info)
    assert tuples(got, "entr", "hist", "stat", "name", "eid") == [(5, 1, 2, "a", None), (5, 2, 2, "b", None), (5, 3, 4, "c", 5), (6, 1, 2, "d", 6)]
    assert max(r.dt for r in got.where("hist = 3").collect()) == dt.datetime(2021, 1, 1, 1, 1, 1)
    f = rows("entr BIGINT, rdng INT, kanj INT, kw INT, value INT", (1, 1, None, 7, 1), (1, 2, None, 1, 2))
    old = rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (1, 2, "b"))
    new = rows("entr BIGINT, rdng INT, txt STRING", (5, 1, "b"), (5, 2, "c"), (5, 3, "a"))
    assert tuples(edits.copy_freqs(rows("child BIGINT, parent BIGINT", (5, 1)), new, old, f, "rdng")) == [(5, 1, None, 1, 2), (5, 3, None, 7, 1)]


def test_realign(rows):
    x = rows("entr BIGINT, sens INT, xref INT, typ INT, xentr BIGINT, xsens INT, rdng INT, kanj INT",
             (9, 1, 1, 3, 1, 1, 1, None), (9, 1, 2, 3, 1, 2, 1, None), (9, 1, 3, 3, 1, 1, 2, None), (9, 1, 4, 3, 1, 1, None, 1))
    r = "entr BIGINT, rdng INT, txt STRING"
    old = {"rdng": rows(r, (1, 1, "a"), (1, 2, "b")), "kanj": rows("entr BIGINT, kanj INT, txt STRING", (1, 1, "K"))}
    new = {"rdng": rows(r, (2, 1, "c"), (2, 2, "a")), "kanj": rows("entr BIGINT, kanj INT, txt STRING"), "sens": rows("entr BIGINT, sens INT", (2, 1))}
    got = edits.realign_reverse_xrefs(x, rows("old BIGINT, new BIGINT", (1, 2)), old, new)
    assert tuples(got, "xref", "xentr", "rdng", "outcome") == [(1, 2, 2, "kept"), (2, 1, 1, "no_sense"), (3, 1, 2, "no_reading"), (4, 1, None, "no_kanji")]


def test_realign_joins_references_once(rows):
    """What the two entries hold is put beside their link; rows of a number and equal texts multiply."""
    x = rows("entr BIGINT, sens INT, xref INT, typ INT, xentr BIGINT, xsens INT, rdng INT, kanj INT", (9, 1, 1, 3, 1, 1, 1, None), (9, 1, 2, 3, 5, 1, 1, None))
    r, k = "entr BIGINT, rdng INT, txt STRING", rows("entr BIGINT, kanj INT, txt STRING")
    old = {"rdng": rows(r, (1, 1, "a"), (1, 1, "b"), (1, 1, None)), "kanj": k}
    new = {"rdng": rows(r, (2, 3, "a"), (2, 4, "a"), (2, 5, None)), "kanj": k, "sens": rows("entr BIGINT, sens INT", (2, 1))}
    got = edits.realign_reverse_xrefs(x, rows("old BIGINT, new BIGINT", (1, 2), (5, None)), old, new)
    want = [(1, 1, 1, "no_reading"), (1, 1, 1, "no_reading"), (1, 2, 3, "kept"), (1, 2, 4, "kept"), (2, 5, 1, "no_sense")]
    assert sorted(tuples(got, "xref", "xentr", "rdng", "outcome")) == want
    node = got._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1:
        node = node.children().head()
    sides = [node.children().apply(i).toString() for i in range(2)]
    assert min(s.count("Join") for s in sides) == 0  # the references go into the last join as they are


def test_remove_tag_needs_both_id_and_name(rows):
    e = rows(ENTR, (1, 1, 2, 1, None, False))
    tags = rows("entr BIGINT, sens INT, ord INT, kw INT", (1, 1, 1, 7), (1, 3, 1, 7), (1, 3, 2, 8))
    kw = rows("id INT, kw STRING", (7, "eK"), (8, "x"))
    h = rows("entr BIGINT, hist INT", (1, 4))
    left, added = edits.remove_tag(e, tags, kw, h, 7, "eK", "misc")
    assert tuples(left, "sens", "kw") == [(3, 8)]
    assert tuples(added, "hist", "notes") == [(5, "In-situ deletion of MISC 'eK' tag from sens #1, 3")]
    left, added = edits.remove_tag(e, tags, kw, h, 7, "x", "misc")
    assert left.count() == 3 and added.count() == 0


def test_reap_and_clone_and_blank(rows):
    e = rows(ENTR, (1, 1, 4, 1, None, False), (2, 1, 6, 2, None, False), (3, 1, 4, 3, 1, True), (4, 2, 4, 4, None, False))
    h = rows("entr BIGINT, hist INT, dt TIMESTAMP_NTZ", *[(i, 1, dt.datetime(2020, 1, i)) for i in (1, 2, 3, 4)])
    assert tuples(edits.reap(e, h, dt.datetime(2020, 2, 1))) == [(2,), (4,)]
    assert tuples(edits.reap(e, h, dt.datetime(2020, 1, 3), corpora=[1])) == [(2,)]
    x = rows("entr BIGINT, sens INT, xref INT, xentr BIGINT, xsens INT", (1, 1, 1, 2, 1), (2, 1, 1, 1, 1))
    t = edits.clone_entries({"entr": e, "xref": x}, rows("id BIGINT", (2,)))
    assert tuples(t["xref"], "entr", "xentr") == [(1, 2), (1, 5), (2, 1), (5, 1)]
    b = edits.blank_deleted({"entr": e, "xref": x, "hist": h}, rows("id BIGINT", (2,)))
    assert tuples(b["entr"], "id", "stat")[1] == (2, 4) and b["xref"].count() == 0 and b["hist"].count() == 4


def test_section_breaks_and_duplicates(rows):
    d = rows("id INT, o INT, a INT, b INT", (1, 1, 1, None), (1, 2, 1, None), (1, 3, 2, None), (2, 1, 2, None))
    assert [r.sbreak for r in counts.section_breaks(d, "id", ["o"], ["a", "b"]).orderBy("id", "o").collect()] == [True, False, True, True]
    first, more = counts.duplicates(d, ["a"], ["id", "o"])
    assert tuples(first, "id", "o") == [(1, 1), (1, 3)] and tuples(more, "id", "o") == [(1, 2), (2, 1)]


def test_renumber(rows):
    r = rows("entr BIGINT, rdng INT, txt STRING", (1, 2, "a"), (1, 5, "b"), (2, 1, "c"))
    dep = rows("entr BIGINT, rdng INT, kw INT", (1, 5, 9), (1, 7, 9), (2, 1, 9))
    out, moved = counts.renumber_children(r, ["entr"], "rdng", {"rinf": dep})
    assert tuples(out) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")] and tuples(moved["rinf"]) == [(1, 2, 9), (2, 1, 9)]
