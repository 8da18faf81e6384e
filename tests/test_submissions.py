"""Batches of submissions and bulk edits on small literal trees."""

import pytest
from compared_rows import tuples

from lexispark.operators.bulk import bulk_edit, read_commands
from lexispark.operators.submissions import apply_in_rounds, apply_submissions, judge_submissions

ENTR = "id BIGINT, src INT, stat INT, seq BIGINT, dfrm BIGINT, unap BOOLEAN, srcnote STRING, notes STRING, idx BIGINT"
SUBS = "sid BIGINT, parent BIGINT, disp STRING, stat INT, src INT, seq BIGINT, editor BOOLEAN, name STRING, notes STRING"
HIST = "entr BIGINT, hist INT, stat INT, unap BOOLEAN, dt TIMESTAMP_NTZ, userid STRING, name STRING, email STRING, diff STRING, refs STRING, notes STRING, eid BIGINT"
TXT = {"rdng": "entr BIGINT, rdng INT, txt STRING", "kanj": "entr BIGINT, kanj INT, txt STRING"}


@pytest.fixture(scope="module")
def tables(rows):
    # 1 <- 2 <- 3,  2 <- 4;  5 approved;  6 <- 7;  8 rejected;  9 new and unapproved;  11 approved, edited by 12
    e = [(1, None, False, 2, 10), (2, 1, True, 2, 10), (3, 2, True, 2, 10), (4, 2, True, 2, 10), (5, None, False, 2, 20), (6, None, False, 2, 30),
         (7, 6, True, 2, 30), (8, None, False, 6, 40), (9, None, True, 2, 50), (11, None, False, 2, 60), (12, 11, True, 2, 60)]
    ids = [x[0] for x in e]
    return {
        "kwsrc": rows("id INT, kw STRING", (1, "jm")),
        "entr": rows(ENTR, *[(i, 1, s, q, d, u, None, None, None) for i, d, u, s, q in e]),
        "rdng": rows(TXT["rdng"], *[(i, 1, f"r{i}") for i in ids], (5, 2, "x5")),
        "kanj": rows(TXT["kanj"], (5, 1, "K5"), (5, 2, "L5")),
        "sens": rows("entr BIGINT, sens INT, notes STRING", *[(i, 1, None) for i in ids]),
        "gloss": rows("entr BIGINT, sens INT, gloss INT, lang INT, ginf INT, txt STRING", *[(i, 1, 1, 1, 1, f"g{i}") for i in ids]),
        "freq": rows("entr BIGINT, rdng INT, kanj INT, kw INT, value INT", (5, 1, None, 7, 1), (5, None, 2, 1, 1)),
        "pos": rows("entr BIGINT, sens INT, ord INT, kw INT", (5, 1, 1, 17)),
        "restr": rows("entr BIGINT, rdng INT, kanj INT", (5, 2, 2)),
        "hist": rows(HIST, (5, 1, 2, False, None, None, "first", None, None, None, "made", 5)),
        "xresolv": rows("entr BIGINT, sens INT, ord INT, typ INT, rtxt STRING, ktxt STRING, tsens INT, vsrc INT, vseq BIGINT, notes STRING, prio BOOLEAN"),
        "xref": rows("entr BIGINT, sens INT, xref INT, typ INT, xentr BIGINT, xsens INT", (9, 1, 1, 3, 6, 1)),
    }


def test_judgements(rows, tables):
    s = rows(
        SUBS,
        (1, 99, "", 2, 1, 10, False, "a", None),  # no such parent
        (2, 8, "", 2, 1, 40, True, "a", None),  # parent rejected
        (3, 2, "a", 2, 1, 10, True, "a", None),  # not a leaf
        (4, 5, "a", 2, 1, 20, True, "a\x08", None),  # control character
        (5, 6, "a", 2, 1, 30, True, "a", None),  # has an edit of its own
        (6, 11, "r", 2, 1, 60, True, "a", None),  # not a leaf
        (7, None, "a", 2, 1, 60, True, "a", None),  # number is taken
        (8, 9, "x", 2, 1, 50, True, "a", None),
    )
    got = judge_submissions(s, tables, {})
    assert tuples(got, "sid", "error") == [
        (1, "noroot"), (2, "parent_rejected"), (3, "non_leaf"), (4, "bad_characters"), (5, "non_leaf"), (6, "non_leaf"), (7, "seq_vio"), (8, "bad_disposition")]
    s2 = rows(SUBS, (1, 3, "a", 2, 1, 10, True, "a", None), (2, 5, "r", 2, 1, 20, True, "a", None), (3, 7, "a", 2, 1, 30, True, "a", None),
              (4, 6, "", 2, 1, 30, True, "a", None), (5, 12, "", 6, 1, 60, True, "a", None))
    x = tables["xresolv"].union(rows("a INT, b INT, c INT, d INT, e STRING, f STRING, g INT, h INT, i INT, j STRING, k BOOLEAN", (3, 1, 1, 3, "q", None, None, None, None, None, None)))
    got = judge_submissions(s2, tables, {"xresolv": x}, allow_forks=False)
    assert tuples(got, "sid", "error", "deferred") == [
        (1, "branches", False), (2, "approved", False), (3, "unresolved_references", False), (4, None, True), (5, "bad_status", False)]
    fork = judge_submissions(rows(SUBS, (1, 2, "", 2, 1, 10, False, "a", None)), tables, {}, allow_forks=False)
    assert tuples(fork, "error") == [("newer_edits",)]


def test_apply(rows, tables):
    s = rows(
        SUBS,
        (1, 5, "", 2, 1, 20, False, "ann", "better"),  # edit by a visitor
        (2, 7, "a", 2, 1, 30, True, "ed", None),  # approve an edit
        (3, 3, "r", 2, 1, 10, True, "ed", None),  # reject one branch
        (4, None, "", 2, 1, None, False, "ann", None),  # new entry
        (5, 12, "", 4, 1, 60, True, "ed", None),  # ask for deletion
        (6, 12, "", 2, 1, 60, True, "late", None),
    )
    content = {
        "rdng": rows(TXT["rdng"], (1, 1, "x5"), (1, 2, "﻿r5"), (2, 1, "new6"), (3, 1, "n"), (4, 1, "fresh"), (5, 1, "ignored")),
        "kanj": rows(TXT["kanj"], (1, 1, "L5")),
        "sens": rows("entr BIGINT, sens INT, notes STRING", *[(i, 1, None) for i in range(1, 6)]),
        "gloss": rows("entr BIGINT, sens INT, gloss INT, lang INT, ginf INT, txt STRING", *[(i, 1, 1, 1, 1, f"new{i}") for i in range(1, 6)]),
        "freq": rows("entr BIGINT, rdng INT, kanj INT, kw INT, value INT", (1, 1, None, 4, 1), (4, 1, None, 4, 1)),
    }
    out, res = apply_submissions(tables, s, content)
    assert tuples(res) == [(1, "added", 13, 20), (2, "added", 14, 30), (3, "added", 15, 10), (4, "added", 16, 61), (5, "added", 17, 60), (6, "deferred", None, None)]
    e = {r.id: r for r in out["entr"].collect()}
    # Approval removed 6 and 7; rejection removed 3 and nothing else of its tree.
    assert sorted(e) == [1, 2, 4, 5, 8, 9, 11, 12, 13, 14, 15, 16, 17]
    state = lambda i: (e[i].stat, e[i].unap, e[i].dfrm)
    assert [state(i) for i in (13, 14, 15, 16, 17)] == [(2, True, 5), (2, False, None), (6, False, None), (2, True, None), (4, True, 12)]
    assert tuples(out["rdng"].where("entr > 12"), "entr", "txt") == [(13, "r5"), (13, "x5"), (14, "new6"), (15, "n"), (16, "fresh"), (17, "r12")]
    # A visitor's frequency rows give way to the parent's, matched by text; on new entries they stay.
    assert tuples(out["freq"].where("entr > 12")) == [(13, 2, None, 7, 1), (13, None, 1, 1, 1), (16, 1, None, 4, 1)]
    h = out["hist"].where("entr = 13").orderBy("hist").collect()
    assert [(r.hist, r.stat, r.unap, r.name, r.notes, r.eid) for r in h] == [(1, 2, False, "first", "made", None), (2, 2, True, "ann", "better", 13)]
    assert "changed gloss[1][1].txt - g5 + new1" in h[1].diff
    assert out["xref"].count() == 0  # its target is gone


def test_rounds(rows, tables):
    s = rows(SUBS, (1, 5, "", 2, 1, 20, False, "a", None), (2, 5, "", 2, 1, 20, False, "b", None), (3, 5, "a", 2, 1, 20, True, "c", None), (4, 12, "a", 2, 1, 60, True, "d", None), (5, 12, "", 2, 1, 60, True, "late", None))
    content = {"rdng": rows(TXT["rdng"], *[(i, 1, f"n{i}") for i in range(1, 6)])}
    out, res = apply_in_rounds(tables, s, content)
    got = {r.sid: (r.outcome, r.id) for r in res.collect()}
    # Both edits of 5 go in; it then has edits, so it can't be approved; 12 is gone once it is approved.
    assert [got[i][0] for i in range(1, 6)] == ["added", "added", "non_leaf", "added", "noroot"]
    new = {got[i][1]: f"n{i}" for i in (1, 2, 4)}
    assert {r.entr: r.txt for r in out["rdng"].where("entr > 12").collect()} == new


def test_bulk_batches_feed_submissions(rows, tables, kw):
    cmds = rows("batch INT, n INT, cmd STRING, operand STRING, place STRING, old STRING, new STRING", (0, 1, "repl", "rdng", None, "r6", "one"), (3, 5, "repl", "rdng", None, "one", "two"), (3, 6, "add", "rdng", None, None, "three"))
    targets = rows("batch INT, kind STRING, num BIGINT, src INT", (0, "id", 6, 1), (3, "id", 6, 1))
    subs, content, skipped = bulk_edit(tables, cmds, targets, kw)
    assert skipped.count() == 0 and tuples(subs, "sid", "disp", "editor") == [(6, "", True)]
    out, res = apply_in_rounds(tables, subs, content)
    assert [r.outcome for r in res.collect()] == ["added"]
    assert tuples(out["rdng"].where("entr > 12"), "rdng", "txt") == [(1, "two"), (2, "three")]


def test_bulk(spark, rows, tables, kw, tmp_path):
    f = tmp_path / "cmds.txt"
    f.write_text(
        "# comment\n20\nrepl kanj K5 \"K five\"\nadd kinf[2] ateji\nadd gloss[1] \"second one\"\nadd comment \"why\"\n"
        "seq 30 60\nadd pos n\n\nid 9\n99\ndel gloss[1] g9\nid 5\ndel kanj L5\nadd pos[3] n\nseq 10\ndel entr x\n"
    )
    cmds, targets, errors = read_commands(spark, str(f), {"jm": 1}, kw, "jm")
    assert errors.count() == 0
    assert tuples(cmds, "cmd", "operand", "place", "old", "new")[0] == ("add", "comment", None, None, "why")
    assert len({r.batch for r in targets.collect()}) == 5
    subs, content, skipped = bulk_edit(tables, cmds.where("n < 14"), targets, kw)
    assert tuples(skipped) == [(99, "not_found")]
    assert {r.sid: (r.stat, r.notes) for r in subs.collect()} == {
        5: (2, "why\n-*- bulk -*-"), 6: (2, "-*- bulk -*-"), 11: (2, "-*- bulk -*-"), 9: (2, "-*- bulk -*-")}
    assert tuples(content["kanj"].where("entr = 5"), "kanj", "txt") == [(1, "K five"), (2, "L5")]
    assert tuples(content["kinf"], "entr", "kanj", "kw") == [(5, 2, 4)]
    assert tuples(content["gloss"].where("entr IN (5, 9)"), "entr", "gloss", "txt") == [(5, 1, "g5"), (5, 2, "second one")]
    assert tuples(content["pos"], "entr", "ord", "kw") == [(11, 1, 17), (5, 1, 17), (6, 1, 17)]
    # The kept kanji keeps its frequency and restriction rows; the replaced one has none.
    assert tuples(content["freq"], "rdng", "kanj") == [(1, None), (None, 2)] and tuples(content["restr"]) == [(5, 2, 2)]
    one = cmds.where("operand = 'kanj' AND cmd = 'del' OR place = '3'")
    subs, content, skipped = bulk_edit(tables, one, targets, kw)
    assert (5, "no_sense") in tuples(skipped)
    subs, content, _ = bulk_edit(tables, cmds.where("operand = 'kanj' AND cmd = 'del'"), targets, kw)
    assert tuples(content["kanj"]) == [(5, 1, "K5")] and content["restr"].count() == 0
    bad = tmp_path / "bad.txt"
    bad.write_text("seq x\nadd pos nosuch\nadd kanj[1] a\nfoo bar\nadd gloss[z] a\nrepl rdng a\n")
    _, _, errors = read_commands(spark, str(bad), {"jm": 1}, kw, "jm")
    assert [t[1] for t in tuples(errors)] == ["bad_number", "unknown_tag", "no_place_allowed", "bad_directive", "bad_sense_number", "too_few_values"]
