"""Edit trees: parent pointers, paths, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.counts import sequence_high_water
from lexispark.operators.skew import bucketed_lag, spread_row_number
from lexispark.session import cut, kept

# Parent pointers are followed by doubling: each round replaces "my parent" by "my
# parent's parent", so a chain of depth d takes log2(d) rounds.  A round writes the rows
# that are still open to the shared folder, which keeps the plan short and survives lost
# executors; finished rows stay where they were written.


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _round(state: DataFrame) -> tuple[DataFrame, int]:
    state = cut(state)
    return state, state.where("up IS NOT NULL").count()


def follow(rows: DataFrame, sums: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(key, end, ...) of every `key` whose pointers `next` lead to an end, a row without.

    `sums` combines the other columns of a row with those of the rows after it, up to the
    end.  Rows that lead to a missing key or into a cycle are left out: after as many steps
    as there are rows, only what walks in cycles is still open.
    """
    names = list(sums)
    done = [rows.where("next IS NULL").select("key", F.col("key").alias("end"), *names)]
    open_ = rows.where("next IS NOT NULL").select("key", "next", *names)
    null = lambda t: F.lit(None).cast(t)
    kind, steps, left = dict(rows.dtypes)["key"], 1, open_.count()
    most = left
    while left and steps <= most:
        hop = open_.withColumn("end", null(kind)).unionByName(_union(done).withColumn("next", null(kind)))
        hop = hop.select(F.col("key").alias("next"), F.col("next").alias("_next"), F.col("end").alias("_end"), *[F.col(n).alias(f"_{n}") for n in names])
        both = open_.join(hop, "next").select(
            "key", F.col("_next").alias("next"), F.col("_end").alias("end"), *[f(F.col(n), F.col(f"_{n}")).alias(n) for n, f in sums.items()]
        )
        both, left = kept(both, F.col("next").isNotNull())
        done.append(both.where("next IS NULL").select("key", "end", *names))
        open_, steps = both.where("next IS NOT NULL").select("key", "next", *names), 2 * steps
    return _union(done)


def edit_base_paths(entr: DataFrame) -> DataFrame:
    """(root, path) for every unapproved entry: ids from the tree's root down to it.

    Entries on or below a cycle, or below a missing parent, have no root and no path.
    """
    rows = entr.select(F.col("id").alias("key"), F.col("dfrm").alias("next"), F.array("id").alias("path"), "unap")
    paths = follow(rows, {"path": lambda own, above: F.concat(above, own), "unap": lambda own, above: own})
    return paths.where("unap").select(F.col("end").alias("root"), "path")


def edit_roots(entr: DataFrame) -> DataFrame:
    """(id, root) of the entries that have a root."""
    up = follow(entr.select(F.col("id").alias("key"), F.col("dfrm").alias("next")), {})
    return up.select(F.col("key").alias("id"), F.col("end").alias("root"))


def edit_tree(entr: DataFrame) -> DataFrame:
    """(id, parent, root, depth, size, first, n_leafs, leaf_from, is_leaf) of the entries that
    have a root: their places on a walk around their tree.

    The walk enters an entry, goes around its edits in order of id, and leaves it. With
    the sums of what comes after each step, an entry's subtree is an interval: `size` entries
    from number `first` on, counted from the end of the walk. `n_leafs` is the number of
    paths (of unapproved leafs) in it, `leaf_from` that of paths from there to the end:
    of two entries with one path each, it is the same path if that number is the same.
    """
    add = {"n": lambda a, b: a + b}
    up = follow(entr.select(F.col("id").alias("key"), F.col("dfrm").alias("next"), F.lit(1).cast("bigint").alias("n")), add)
    node = entr.select("id", F.col("dfrm").alias("parent"), "unap").join(up.select(F.col("key").alias("id"), F.col("end").alias("root"), F.col("n").alias("depth")), "id")
    node, _ = kept(node)
    kids = bucketed_lag(node.where("parent IS NOT NULL").select("parent", "id"), ["parent"], "id", name="before")
    ends = kids.groupBy("parent").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    family = node.join(ends.withColumnRenamed("parent", "id"), "id", "left")
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    leaf = F.col("_first").isNull() & F.col("unap")
    down = family.select(enter("id").alias("key"), F.coalesce(enter("_first"), leave("id")).alias("next"), F.lit(1).cast("bigint").alias("n"), one(leaf).alias("m"))
    after = kids.where("before IS NOT NULL").select(F.col("before").alias("id"), F.col("id").alias("_after"))
    back = node.join(after, "id", "left").select(leave("id").alias("key"), F.coalesce(enter("_after"), leave("parent")).alias("next"), one(F.lit(False)).alias("n"), one(F.lit(False)).alias("m"))
    walk, _ = kept(follow(kept(down.unionByName(back))[0], {"n": add["n"], "m": add["n"]}))
    into = walk.where("key % 2 = 0").select((F.col("key") / 2).cast("bigint").alias("id"), "n", "m")
    out = walk.where("key % 2 = 1").select(((F.col("key") - 1) / 2).cast("bigint").alias("id"), F.col("n").alias("_n"), F.col("m").alias("_m"))
    return family.join(into, "id").join(out, "id").select(
        "id", "parent", "root", "depth", (F.col("n") - F.col("_n")).alias("size"), F.col("n").alias("first"), (F.col("m") - F.col("_m")).alias("n_leafs"),
        F.col("m").alias("leaf_from"), leaf.alias("is_leaf"),
    )


def edit_paths(base: DataFrame, entr: DataFrame) -> DataFrame:
    """Paths that end at a leaf, that is at nobody's parent."""
    parents = entr.where("dfrm IS NOT NULL").select(F.col("dfrm").alias("_leaf"))
    return base.withColumn("_leaf", F.element_at("path", -1)).join(parents, "_leaf", "left_anti").drop("_leaf")


def entry_edit_paths(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """Every path under the root of each asked entry, as (id, root, path).

    `ids` names the entries of interest; asking for all would repeat each tree once per
    member.  For whole-table questions use `edit_positions`.
    """
    places = paths.where(F.size("path") > 1).select("root", F.explode("path").alias("id"))
    asked = places.join(ids.select("id").distinct(), "id", "left_semi").distinct()
    return asked.join(paths, "root").select("id", "root", "path")


def edit_places(paths: DataFrame) -> DataFrame:
    """(id, root, path, place): each path once per member, `place` from 1."""
    return paths.select("root", "path", F.posexplode("path").alias("_i", "id")).select(
        "id", "root", "path", (F.col("_i") + 1).alias("place")
    )


def edit_leafs(paths: DataFrame) -> DataFrame:
    """(id, leaf) for every path that holds the entry."""
    return edit_places(paths).select("id", F.element_at("path", -1).alias("leaf"))


def edit_positions(entr: DataFrame) -> DataFrame:
    """E4 for all entries of all trees, one row each, from the tree's intervals.

    n_leafs: paths through the entry; n_paths: paths of its tree; is_leaf; approvable: it
    is the tree's only leaf.  Where only one path passes, `leaf` is its end and `tail_length`
    what follows the entry on it.  A leaf has `segment_length`, the number of entries at the
    end of its path that no other path shares, the first two of them as `segment_top` and
    `segment_second`.  `edit_tails` gives the lists.
    """
    tree, _ = kept(edit_tree(entr).where("n_leafs > 0"))
    leaf = tree.where("is_leaf").select("root", "leaf_from", F.col("id").alias("leaf"), F.col("depth").alias("_d"))
    own = tree.where("n_leafs = 1").join(leaf, ["root", "leaf_from"]).select("id", "parent", "depth", "leaf", (F.col("_d") - F.col("depth")).alias("tail_length"))
    own, _ = kept(own)
    top = own.groupBy("leaf").agg(F.min_by("id", "depth").alias("segment_top"), F.count(F.lit(1)).alias("segment_length"))
    second = own.select("leaf", F.col("parent").alias("segment_top"), F.col("id").alias("segment_second"))
    seg = top.join(second, ["leaf", "segment_top"], "left").withColumnRenamed("leaf", "id")
    paths = tree.where("parent IS NULL").select("root", F.col("n_leafs").alias("n_paths"))
    out = tree.join(paths, "root").join(own.select("id", "leaf", "tail_length"), "id", "left").join(seg, "id", "left")
    return out.select(
        "id", "root", "parent", "depth", "n_leafs", "n_paths", "is_leaf", (F.col("is_leaf") & (F.col("n_paths") == 1)).alias("approvable"),
        "leaf", "tail_length", "segment_length", "segment_top", "segment_second",
    )


def edit_tails(positions: DataFrame, ids: DataFrame) -> DataFrame:
    """E4 lists of asked entries (id): `tail`, what follows an entry on its only path (null
    if several paths pass, or none follows), and `segment` of a leaf."""
    own = positions.where("leaf IS NOT NULL").select("leaf", "id", "depth")
    asked = positions.join(ids.select("id").distinct(), "id", "left_semi")
    wanted = asked.where("leaf IS NOT NULL").select("leaf").distinct()
    lists = own.join(wanted, "leaf", "left_semi").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "id")))["id"].alias("_ids"))
    out = asked.join(lists, "leaf", "left")
    tail = F.expr("slice(_ids, size(_ids) - cast(tail_length as int) + 1, cast(tail_length as int))")
    return out.select("id", F.when(F.col("tail_length") > 0, tail).alias("tail"), F.when(F.col("is_leaf"), F.col("_ids")).alias("segment"))


def path_positions(paths: DataFrame) -> DataFrame:
    """E4 for the members of some paths, one row each; a path is copied to each of its
    members, so this is for the trees of a batch. `edit_positions` is for whole tables.

    n_leafs: paths through the entry; n_paths: paths of its tree; is_leaf; approvable: it
    is the tree's only leaf; tail: what follows it when only one path passes; segment: for
    a leaf, the end of its path that no other path shares.
    """
    places = edit_places(paths)
    per_id = places.groupBy("id").agg(
        F.first("root").alias("root"),
        F.count(F.lit(1)).alias("n_leafs"),
        # One path is kept per entry; it is read only when it is the only one.
        F.max_by(F.expr("slice(path, place + 1, size(path))"), "place").alias("_tail"),
        F.max(F.col("place") == F.size("path")).alias("is_leaf"),
    )
    per_root = paths.groupBy("root").agg(F.count(F.lit(1)).alias("n_paths"))
    own = places.join(per_id.where("n_leafs = 1").select("id"), "id", "left_semi")
    seg = own.groupBy(F.element_at("path", -1).alias("id")).agg(
        F.any_value("path").alias("_p"), F.count(F.lit(1)).alias("_k")
    )
    seg = seg.select("id", F.expr("slice(_p, size(_p) - cast(_k as int) + 1, cast(_k as int))").alias("_seg"))
    out = per_id.join(per_root, "root").join(seg, "id", "left")
    tail = F.when((F.col("n_leafs") == 1) & (F.size("_tail") > 0), F.col("_tail"))
    return out.select(
        "id", "root", "n_leafs", "n_paths", "is_leaf",
        (F.col("is_leaf") & (F.col("n_paths") == 1)).alias("approvable"),
        tail.alias("tail"), F.when(F.col("is_leaf"), F.col("_seg")).alias("segment"),
    )


def cycle_members(entr: DataFrame) -> DataFrame:
    """Q2: ids on a cycle of parent pointers.

    After N steps up, with N at least the number of entries still walking, only cycle
    members can be reached, and each cycle member is.
    """
    first = entr.where("dfrm IS NOT NULL").select("id", F.col("dfrm").alias("up"))
    state = cut(first)
    left, steps = state.count(), 1
    while left and steps < left:
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        state = cut(state.join(above, "up").select("id", F.col("_up").alias("up")))
        left, steps = state.count(), steps * 2
    return state.join(first.select(F.col("id").alias("up")), "up", "left_semi").select(
        F.col("up").alias("id")
    ).distinct()


def descendants(entr: DataFrame, ids: DataFrame) -> DataFrame:
    """The given entries and everything edited from them, as (id)."""
    hit = ids.select("id", F.lit(True).alias("_h")).distinct()
    state = entr.select("id", F.col("dfrm").alias("up")).join(hit, "id", "left")
    state = state.select("id", F.coalesce("_h", F.lit(False)).alias("dead"), "up")
    state, open_ = _round(state)
    steps = 1
    while open_ and steps <= open_:
        above = state.select(F.col("id").alias("up"), F.col("dead").alias("_d"), F.col("up").alias("_up"))
        walk = state.where("up IS NOT NULL").join(above, "up", "left")
        walk = walk.select("id", (F.col("dead") | F.coalesce("_d", F.lit(False))).alias("dead"), F.col("_up").alias("up"))
        state, open_ = _round(state.where("up IS NULL").unionByName(walk))
        steps *= 2
    return state.where("dead").select("id")


# Child tables of an entry and the column naming the entry.
CHILD_TABLES = (
    "rdng kanj sens gloss hist dial fld misc pos kinf rinf freq lsrc restr stagr stagk grp "
    "xref xresolv chr cinf krslv entrsnd rdngsnd"
).split()


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the entries, their descendants, children and references."""
    dead = cut(descendants(tables["entr"], ids))
    gone = lambda df, col: df.join(dead.select(F.col("id").alias(col)), col, "left_anti")
    out = dict(tables)
    out["entr"] = gone(tables["entr"], "id")
    for name in CHILD_TABLES:
        if name in tables:
            out[name] = gone(tables[name], "entr")
    if "xref" in out:
        out["xref"] = gone(out["xref"], "xentr")
    return {n: df.select(*tables[n].columns) for n, df in out.items()}


# E6, E7, E8 ------------------------------------------------------------------------


def copy_freqs(
    links: DataFrame, child_items: DataFrame, parent_items: DataFrame, freq: DataFrame, ordinal: str
) -> DataFrame:
    """Frequency rows of children taken from their parents by equal text.

    `links` has child, parent.  Run once for readings and once for kanji; the result
    replaces whatever the children had.
    """
    to = links.join(child_items.select(F.col("entr").alias("child"), F.col(ordinal).alias("_to"), "txt"), "child")
    first = parent_items.groupBy(F.col("entr").alias("parent"), "txt").agg(F.min(ordinal).alias("_from"))
    rows = freq.where(F.col(ordinal).isNotNull()).select(
        F.col("entr").alias("parent"), F.col(ordinal).alias("_from"), "kw", "value"
    )
    out = to.join(first, ["parent", "txt"]).join(rows, ["parent", "_from"])
    sides = {o: (F.col("_to") if o == ordinal else F.lit(None)).cast("int").alias(o) for o in ("rdng", "kanj")}
    return out.select(F.col("child").alias("entr"), sides["rdng"], sides["kanj"], "kw", "value")


def append_history(hist: DataFrame, links: DataFrame, info: DataFrame) -> DataFrame:
    """History of each new entry: its parent's rows and one more.

    `links` has entr and parent (null for new entries); `info` has entr and the columns of
    the added row (stat, unap, dt, userid, name, email, diff, refs, notes).
    """
    cols = [c for c in hist.columns if c not in ("entr", "hist", "eid")]
    old = links.join(hist.withColumnRenamed("entr", "parent"), "parent").select(
        "entr", "hist", *cols, F.lit(None).cast("bigint").alias("eid")
    )
    last = old.groupBy("entr").agg(F.max("hist").alias("_last"))
    row = info.join(links.select("entr"), "entr", "left_semi").join(last, "entr", "left")
    value = lambda c: (
        F.date_trunc("second", c).cast("timestamp_ntz").alias(c) if c == "dt" and c in info.columns
        else F.col(c) if c in info.columns else F.lit(None).cast(hist.schema[c].dataType).alias(c)
    )
    row = row.select(
        "entr", (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("hist"),
        *[value(c) for c in cols], F.col("entr").cast("bigint").alias("eid"),
    )
    return old.unionByName(row)


def realign_reverse_xrefs(
    xref: DataFrame, links: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]
) -> DataFrame:
    """References to an edited entry, renumbered for its new version.

    `links` has old, new entry ids; `old` / `new` hold rdng, kanj (and new sens).  Adds
    `outcome`: kept, no_sense, no_reading or no_kanji; only kept rows stay valid.
    """
    moves = links.select(F.col("old").alias("xentr"), F.col("new").alias("_new"))
    moves = moves.join(new["sens"].groupBy(F.col("entr").alias("_new")).agg(F.count(F.lit(1)).alias("_ns")), "_new", "left")
    for o in ("rdng", "kanj"):
        items = lambda t, key, name: t[o].groupBy(F.col("entr").alias(key)).agg(F.collect_list(F.struct(F.col(o).alias("n"), "txt")).alias(name))
        moves = moves.join(items(old, "xentr", f"_was{o}"), "xentr", "left").join(items(new, "_new", f"_now{o}"), "_new", "left")
    # What a link knows of its two entries is one row, so references meet it in one join.
    x = xref.join(moves, "xentr")
    for o in ("rdng", "kanj"):
        none = F.array(F.lit(None).cast(dict(new[o].dtypes)[o]))
        or_none = lambda c: F.when(F.size(c) > 0, c).otherwise(none)  # noqa: B023, E731
        numbers = lambda w: or_none(F.transform(F.filter(f"_now{o}", lambda n: n["txt"] == w["txt"]), lambda n: n["n"]))  # noqa: B023, E731
        was = F.filter(f"_was{o}", lambda w: w["n"] == F.col(o))  # noqa: B023
        x = x.withColumn(f"_n{o}", F.explode(or_none(F.flatten(F.transform(was, numbers))))).drop(f"_was{o}", f"_now{o}")
    outcome = (
        F.when(F.col("xsens") > F.coalesce("_ns", F.lit(0)), "no_sense")
        .when(F.col("rdng").isNotNull() & F.col("_nrdng").isNull(), "no_reading")
        .when(F.col("kanj").isNotNull() & F.col("_nkanj").isNull(), "no_kanji")
        .otherwise("kept")
    )
    kept = outcome == "kept"
    cols = []
    for c in xref.columns:
        moved = {"xentr": "_new", "rdng": "_nrdng", "kanj": "_nkanj"}.get(c)
        cols.append(F.when(kept, F.col(moved)).otherwise(F.col(c)).alias(c) if moved else F.col(c))
    return x.select(*cols, outcome.alias("outcome"))


# E10, E12, E13, E14, E15, E16, V1 ---------------------------------------------------


def remove_tag(
    entr: DataFrame, tags: DataFrame, kw: DataFrame, hist: DataFrame, tag_id: int, tag: str, domain: str,
    ordinal: str = "sens",
) -> tuple[DataFrame, DataFrame]:
    """(tag rows left, history rows added) after removing one tag everywhere.

    Nothing happens unless both the id and the name belong to the same tag.
    """
    real = kw.where((F.col("id") == tag_id) & (F.col("kw") == tag)).select(F.col("id").alias("kw"))
    gone = tags.join(real, "kw", "left_semi")
    left = tags.join(real, "kw", "left_anti").select(*tags.columns)
    senses = gone.groupBy("entr").agg(
        F.expr(f"listagg(cast({ordinal} as string), ', ') WITHIN GROUP (ORDER BY {ordinal})").alias("_s")
    )
    last = hist.groupBy("entr").agg(F.max("hist").alias("_h"))
    e = entr.select(F.col("id").alias("entr"), "stat", "unap")
    added = senses.join(e, "entr").join(last, "entr", "left").select(
        "entr", (F.coalesce("_h", F.lit(0)) + 1).cast("int").alias("hist"), "stat", "unap",
        F.lit("dbmaint").alias("name"),
        # Fixed text form of the note.
        F.concat(F.lit(f"In-situ deletion of {domain.upper()} '{tag}' tag from {ordinal} #"), "_s").alias("notes"),
    )
    return left, added


def new_ids(ids: DataFrame, start: int, name: str = "new") -> DataFrame:
    """Ids in order mapped to consecutive numbers after `start`."""
    out = spread_row_number(ids.select("id").distinct(), [], [F.col("id")], "_n")
    return out.select("id", (F.col("_n") + F.lit(start)).cast("bigint").alias(name))


def clone_entries(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables with a copy of each entry under a new id, references included."""
    entr = tables["entr"]
    top = entr.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    m = cut(new_ids(entr.join(ids.select("id"), "id", "left_semi"), top))
    out = dict(tables)

    def copies(df, col):
        key = m.select(F.col("id").alias(col), "new")
        return df.join(key, col).withColumn(col, F.col("new")).select(*df.columns)

    out["entr"] = entr.unionByName(copies(entr, "id"))
    for name in CHILD_TABLES:
        if name in tables:
            out[name] = tables[name].unionByName(copies(tables[name], "entr"))
    if "xref" in tables:
        out["xref"] = out["xref"].unionByName(copies(tables["xref"], "xentr"))
    return out


def blank_deleted(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Entries marked deleted, their contents removed; entry and history stay."""
    out = dict(tables)
    hit = ids.select("id", F.lit(True).alias("_h")).distinct()
    e = tables["entr"]
    out["entr"] = e.join(hit, "id", "left").withColumn(
        "stat", F.when(F.col("_h"), F.lit(4)).otherwise(F.col("stat"))
    ).select(*e.columns)
    kept = {"hist", "grp", "chr", "cinf", "krslv", "entrsnd"}
    for name in CHILD_TABLES:
        if name in tables and name not in kept:
            df = tables[name]
            df2 = df.join(ids.select(F.col("id").alias("entr")), "entr", "left_anti")
            if name == "xref":
                df2 = df2.join(ids.select(F.col("id").alias("xentr")), "xentr", "left_anti")
            out[name] = df2.select(*df.columns)
    return out


def reap(
    entr: DataFrame, hist: DataFrame, before, stats: Sequence[int] = (4, 6), corpora: Sequence[int] = ()
) -> DataFrame:
    """Ids of approved dead entries that are nobody's parent and whose newest history
    row is older than `before` (a timestamp)."""
    e = entr.where(F.col("stat").isin(list(stats)) & ~F.col("unap"))
    if corpora:
        e = e.where(F.col("src").isin(list(corpora)))
    newest = hist.groupBy(F.col("entr").alias("id")).agg(F.max("dt").alias("_dt"))
    old = newest.where(F.col("_dt") < F.lit(before)).select("id")
    parents = entr.where("dfrm IS NOT NULL").select(F.col("dfrm").alias("id"))
    return e.join(old, "id", "left_semi").join(parents, "id", "left_anti").select("id")


def expire(df: DataFrame, ts: str, now, max_idle: str = "240 minutes") -> DataFrame:
    """Rows idle for longer than `max_idle` at `now`."""
    return df.where(F.col(ts) < F.lit(now) - F.expr(f"INTERVAL {max_idle}"))


def split_paired_freq(freq: DataFrame) -> DataFrame:
    """One row per side for old rows naming both a reading and a kanji."""
    r = freq.where("rdng IS NOT NULL").withColumn("kanj", F.lit(None).cast("int"))
    k = freq.where("kanj IS NOT NULL").withColumn("rdng", F.lit(None).cast("int"))
    return r.unionByName(k).distinct()


def assign_seq(entries: DataFrame, existing: DataFrame, kwsrc: DataFrame) -> DataFrame:
    """V1: entries without `seq` numbered per corpus after its high-water mark.

    `kwsrc` has id and optionally smin, smax, sinc.  Corpora are few and large, so the
    numbering is spread over slices and not done by one task per corpus.
    """
    water = sequence_high_water(existing, kwsrc).select(F.col("id").alias("src"), "top", "sinc")
    todo = spread_row_number(entries.where("seq IS NULL"), ["src"], [F.col("id")], "_n")
    done = todo.join(water, "src").withColumn("seq", F.col("top") + F.col("_n") * F.col("sinc"))
    return entries.where("seq IS NOT NULL").unionByName(done.select(*entries.columns))
