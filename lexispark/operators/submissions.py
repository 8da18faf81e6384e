"""Batches of submitted edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import clean_control, strip_bom
from lexispark.operators.compare import entry_changes
from lexispark.operators.edits import (
    CHILD_TABLES, append_history, assign_seq, cascade_delete, copy_freqs, descendants, edit_base_paths, edit_paths, edit_roots, new_ids, path_positions,
)
from lexispark.session import cut

ACTIVE, DELETED, REJECTED = 2, 4, 6
CONTENT = [t for t in CHILD_TABLES if t != "hist"]


def _all_entries(entr: DataFrame, others: DataFrame | None) -> DataFrame:
    return entr if others is None else entr.unionByName(others.select(*entr.columns))


def judge_submissions(subs: DataFrame, tables: dict[str, DataFrame], content: dict[str, DataFrame], allow_forks: bool = True, others: DataFrame | None = None) -> DataFrame:
    """E5 decision: submissions with `error` (null when accepted) and what to remove.

    `subs`: sid, parent (null for a new entry), disp ('' edit, 'a' approve, 'r' reject), stat, src, seq,
    editor, and the history columns.  Adds root, drop_id (entry whose subtree goes) and
    `deferred`: of the submissions to one edit tree, or to one new (src, seq), only the one with the
    lowest sid is judged now; the others belong to the next batch. `others` are entries of
    trees that no submission names, where `tables` has only those of the named ones.
    """
    entr = tables["entr"]
    pos = path_positions(edit_paths(edit_base_paths(entr), entr))
    parent = entr.select(
        F.col("id").alias("parent"), F.col("stat").alias("_pstat"), F.col("unap").alias("_punap"),
        F.col("src").alias("_psrc"), F.col("seq").alias("_pseq"),
    )
    s = subs.join(parent, "parent", "left").join(pos.withColumnRenamed("id", "parent"), "parent", "left")
    lone = F.col("root").isNull() & F.col("_pstat").isNotNull()
    own = F.col("parent")
    s = s.withColumns({
        "is_leaf": F.when(lone, True).otherwise(F.col("is_leaf")), "n_paths": F.when(lone, 1).otherwise(F.col("n_paths")),
        "segment": F.when(lone, F.array(own)).otherwise(F.col("segment")), "root": F.when(lone, own).otherwise(F.col("root")),
    })
    s = s.withColumns({
        "stat": F.when(F.col("parent").isNull(), F.lit(ACTIVE)).otherwise(F.col("stat")),
        "src": F.coalesce("src", "_psrc"),
        "seq": F.when(F.col("parent").isNull() & ~F.col("editor"), None).otherwise(F.coalesce("seq", "_pseq")),
    })
    # One submission per tree (or per number given to a new entry) and batch.
    key = F.coalesce(F.concat(F.lit("t"), "root"), F.concat_ws("-", F.lit("s"), "src", F.coalesce(F.col("seq").cast("string"), F.concat(F.lit("new"), "sid"))))
    s = s.withColumn("_key", key)
    first = s.groupBy("_key").agg(F.min("sid").alias("_first"))
    s = s.join(first, "_key").withColumn("deferred", F.col("sid") != F.col("_first"))
    roots = entr.select(F.col("id").alias("root"), F.col("unap").alias("_runap"))
    s = s.join(roots, "root", "left")
    if "xresolv" in content:
        has = content["xresolv"].select(F.col("entr").alias("sid")).distinct().withColumn("_unres", F.lit(True))
        s = s.join(has, "sid", "left")
    else:
        s = s.withColumn("_unres", F.lit(False))
    live = _all_entries(entr, others).where("stat = 2 AND NOT unap").select("src", "seq", F.col("id").alias("_live"))
    # At most one active approved entry per number outside the tree matters.
    live = live.groupBy("src", "seq").agg(F.min("_live").alias("_l1"), F.max("_live").alias("_l2"))
    s = s.join(live, ["src", "seq"], "left")
    clash = (F.col("_l1") != F.coalesce("root", F.lit(-1))) | (F.col("_l2") != F.coalesce("root", F.lit(-1)))
    dirty = None
    for c in ("name", "email", "notes", "refs"):
        if c in subs.columns:
            d = F.coalesce(F.col(c) != clean_control(c), F.lit(False))
            dirty = d if dirty is None else dirty | d
    dirty = dirty if dirty is not None else F.lit(False)
    edit, app, rej = F.col("disp") == "", F.col("disp") == "a", F.col("disp") == "r"
    has_parent, leaf = F.col("parent").isNotNull(), F.coalesce("is_leaf", F.lit(False))
    only_root = (F.size("segment") == 1) & (F.col("segment")[0] == F.col("root")) & ~F.col("_runap")
    error = (
        F.when(has_parent & F.col("_pstat").isNull(), "noroot")
        .when(has_parent & ~leaf & F.lit(not allow_forks), "newer_edits")
        .when(has_parent & (F.col("_pstat") == REJECTED), "parent_rejected")
        .when(app & F.coalesce("_unres", F.lit(False)) & (F.col("stat") == ACTIVE), "unresolved_references")
        .when(dirty, "bad_characters")
        .when(~(edit | app | rej), "bad_disposition")
        .when((edit | app) & (F.col("stat") == REJECTED), "bad_status")
        .when(app & has_parent & ~leaf, "non_leaf")
        .when(app & has_parent & (F.col("n_paths") > 1), "branches")
        .when(app & (F.col("stat") == ACTIVE) & F.coalesce(clash, F.lit(False)), "seq_vio")
        .when(rej & ~leaf, "non_leaf")
        .when(rej & only_root, "approved")
    )
    cutoff = F.when((F.col("segment")[0] == F.col("root")) & ~F.col("_runap"), F.get("segment", F.lit(1))).otherwise(F.get("segment", F.lit(0)))
    drop = F.when(app & has_parent, F.col("root")).when(rej, cutoff)
    return s.select(
        "sid", "parent", "disp", "stat", "src", "seq", "editor",
        *[c for c in ("dt", "userid", "name", "email", "notes", "refs", "srcnote", "enotes") if c in subs.columns],
        "root", "deferred", F.when(~F.col("deferred"), error).alias("error"), F.when(error.isNull(), drop).alias("drop_id"),
    )


def apply_submissions(
    tables: dict[str, DataFrame], subs: DataFrame, content: dict[str, DataFrame], allow_forks: bool = True, others: DataFrame | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """E5: (new tables, outcomes) of one batch.

    `content` holds the child rows of the submitted entries, keyed by `entr` = sid.
    Nothing stored is changed: accepted submissions add entries, approvals take away the
    whole old edit tree, rejections the rejected branch.  A deletion keeps the parent's
    content; people who are not editors keep the parent's frequency rows.

    Outcomes: sid, outcome (added, deferred or an error), id, seq.
    """
    entr = tables["entr"]
    v = cut(judge_submissions(subs, tables, content, allow_forks, others))
    good = v.where("error IS NULL AND NOT deferred")
    top = _all_entries(entr, others).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    ids = cut(new_ids(good.select(F.col("sid").alias("id")), top)).withColumnRenamed("id", "sid").withColumnRenamed("new", "id")
    good = good.join(ids, "sid")
    edit = F.col("disp") == ""
    col = lambda c, a: (F.col(c) if c in v.columns else F.lit(None).cast("string")).alias(a)
    added = good.select(
        "id", F.col("src").cast("int").alias("src"), F.when(F.col("disp") == "r", REJECTED).otherwise(F.col("stat")).cast("int").alias("stat"),
        F.col("seq").cast("bigint").alias("seq"), F.when(edit, F.col("parent")).cast("bigint").alias("dfrm"), edit.alias("unap"),
        col("srcnote", "srcnote"), col("enotes", "notes"), F.lit(None).cast("bigint").alias("idx"),
    )
    added = cut(assign_seq(added, _all_entries(entr, others), tables["kwsrc"]) if "kwsrc" in tables else added)
    keep = cascade_delete(tables, good.where("drop_id IS NOT NULL").select(F.col("drop_id").alias("id")))
    new: dict[str, DataFrame] = {}
    from_parent = good.where(F.col("stat") == DELETED).select("id", "parent")
    from_sub = good.where(F.col("stat") != DELETED).select("id", F.col("sid").alias("entr"))
    for name in CONTENT:
        parts = []
        if name in content:
            df = content[name].join(from_sub, "entr").withColumn("entr", F.col("id")).select(*content[name].columns)
            if name in ("kanj", "rdng"):
                df = df.withColumn("txt", strip_bom("txt"))
            parts.append(df)
        if name in tables:
            df = tables[name]
            parts.append(df.join(from_parent.withColumnRenamed("parent", "entr"), "entr").withColumn("entr", F.col("id")).select(*df.columns))
        if parts:
            new[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    links = good.where("parent IS NOT NULL").select(F.col("id").alias("child"), "parent", "editor")
    if "freq" in tables and "rdng" in new and "kanj" in new:
        lay = links.where(~F.col("editor")).select("child", "parent")
        own = new["freq"].join(lay.select(F.col("child").alias("entr")), "entr", "left_anti").select(*new["freq"].columns)
        for o in ("rdng", "kanj"):
            own = own.unionByName(copy_freqs(lay, new[o], tables[o], tables["freq"], o), allowMissingColumns=True)
        new["freq"] = own
    if "hist" in tables:
        pairs = links.select(F.col("parent").alias("old"), F.col("child").alias("new"))
        parts = [n for n in ("rdng", "kanj", "sens", "gloss", "pos", "misc") if n in tables and n in new]
        diff = entry_changes(pairs, {n: tables[n] for n in parts}, {n: new[n] for n in parts})
        line = F.concat_ws(" ", "outcome", "path", F.concat(F.lit("- "), "old_value"), F.concat(F.lit("+ "), "new_value"))
        diff = diff.select(F.col("new").alias("entr"), "path", line.alias("_l")).groupBy("entr").agg(
            F.expr("listagg(_l, '\\n') WITHIN GROUP (ORDER BY path)").alias("diff")
        )
        info = good.select(F.col("id").alias("entr"), *[c for c in ("dt", "userid", "name", "email", "notes", "refs") if c in good.columns])
        info = info.join(added.select(F.col("id").alias("entr"), "stat", "unap"), "entr").join(diff, "entr", "left")
        if "diff" not in tables["hist"].columns:
            info = info.drop("diff")
        info = info.select(*[c for c in info.columns if c in tables["hist"].columns])
        new["hist"] = append_history(
            tables["hist"], good.select(F.col("id").alias("entr"), "parent"), info
        )
    out = dict(keep)
    out["entr"] = keep["entr"].unionByName(added.select(*[c for c in added.columns if c in entr.columns]), allowMissingColumns=True)
    for name, df in new.items():
        if name in keep:
            cols = [c for c in df.columns if c in keep[name].columns]
            out[name] = keep[name].unionByName(df.select(*cols), allowMissingColumns=True)
    outcome = v.join(ids, "sid", "left").join(added.select("id", F.col("seq").alias("_q")), "id", "left")
    return out, outcome.select(
        "sid", F.when(F.col("deferred"), "deferred").otherwise(F.coalesce("error", F.lit("added"))).alias("outcome"), "id", F.col("_q").alias("seq")
    )


def apply_in_rounds(
    tables: dict[str, DataFrame], subs: DataFrame, content: dict[str, DataFrame], allow_forks: bool = True
) -> tuple[dict[str, DataFrame], DataFrame]:
    """E5 for any number of submissions per edit tree: (new tables, outcomes).

    Submissions to one tree are applied in the order of sid, each to what the ones before
    it have left.  A round takes one per tree, so there are as many rounds as the busiest
    tree has submissions.  Rounds carry the trees that submissions name and nothing else;
    all other rows are taken over once, at the end, as they were.
    """
    entr = tables["entr"]
    roots = edit_roots(entr).join(subs.select(F.col("parent").alias("id")), "id", "left_semi").select("root").distinct()
    mine = cut(descendants(entr, roots.select(F.col("root").alias("id")).unionByName(subs.where("parent IS NOT NULL").select(F.col("parent").alias("id")))))
    by = {name: "id" if name == "entr" else "entr" for name in tables if name == "entr" or name in CHILD_TABLES}
    part = lambda name, how: tables[name].join(mine.withColumnRenamed("id", by[name]), by[name], how).select(*tables[name].columns)
    others = part("entr", "left_anti")
    state, settled = {name: cut(part(name, "left_semi")) if name in by else df for name, df in tables.items()}, None
    while True:
        state, outcome = apply_submissions(state, subs, content, allow_forks, others)
        outcome = cut(outcome)
        done = outcome.where("outcome <> 'deferred'")
        settled = done if settled is None else settled.unionByName(done)
        state = {name: cut(df) if name in by else df for name, df in state.items()}
        left = outcome.where("outcome = 'deferred'").select("sid")
        if left.isEmpty():
            break
        subs = cut(subs.join(left, "sid", "left_semi"))
        still = left.withColumnRenamed("sid", "entr")
        content = {name: df.join(still, "entr", "left_semi").select(*df.columns) for name, df in content.items()}
    gone = mine.join(state["entr"].select("id"), "id", "left_anti")
    out = dict(tables)
    for name in by:
        rest = part(name, "left_anti")
        if name == "xref":
            rest = rest.join(gone.withColumnRenamed("id", "xentr"), "xentr", "left_anti").select(*tables[name].columns)
        out[name] = rest.unionByName(state[name], allowMissingColumns=True)
    return out, settled
