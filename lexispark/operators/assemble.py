"""Entries as nested rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Child tables by parent, with the columns that order them.
RDNG_KIDS = {"rinf": ["ord", "kw"], "freq": ["kw", "value"], "restr": ["kanj"], "rdngsnd": ["ord", "snd"]}
KANJ_KIDS = {"kinf": ["ord", "kw"], "freq": ["kw", "value"]}
SENS_KIDS = {
    "gloss": ["gloss"], "pos": ["ord", "kw"], "misc": ["ord", "kw"], "fld": ["ord", "kw"], "dial": ["ord", "kw"],
    "lsrc": ["ord", "lang", "txt"], "stagr": ["rdng"], "stagk": ["kanj"], "xref": ["xref"], "xrer": ["typ", "entr", "sens"],
    "xresolv": ["typ", "ord"],
}
ENTR_KIDS = {"hist": ["hist"], "entrsnd": ["ord", "snd"], "grp": ["kw"], "krslv": ["kw", "value"]}
SUMMARY_TABLES = ("entr", "rdng", "kanj", "sens", "gloss", "xref")


def _rows(df: DataFrame, key: str, first: Sequence[str], name: str) -> DataFrame:
    """Rows of a child table as one ordered array per entry.

    They are merged with the entries, not broadcast: by entry that needs no further shuffle,
    and the size of compressed files says little about the arrays a driver would hold.
    """
    first = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in first and c != key]
    return df.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias(name)).hint("merge")


def _drop(struct_cols: Sequence[str], x, *keys):
    return F.struct(*[x[c].alias(c) for c in struct_cols if c not in keys])


def assemble_entries(tables: dict[str, DataFrame], ids: DataFrame | None = None, reverse: bool = True) -> DataFrame:
    """One row per entry with its readings, kanji, senses and the rest nested in order.

    Each child table is shuffled once, by entry; the two-level nesting (a reading's tags,
    a sense's glosses) is done on the arrays of an entry, without further shuffles.
    Children whose parent row is missing are dropped.  Pass fewer tables for a summary.
    """
    t = dict(tables)
    if "xref" in t:
        if reverse:
            t["xrer"] = t["xref"].where(~F.col("lowpri"))
        if "xref" not in t["xref"].columns:
            SORT = ["xentr", "xsens", "typ"]
        else:
            SORT = ["xref"]
    if ids is not None:
        keep = ids.select("id").distinct()
        t["entr"] = t["entr"].join(keep, "id", "left_semi")
        for n, df in t.items():
            if n != "entr":
                key = "xentr" if n == "xrer" else "entr"
                t[n] = df.join(keep.withColumnRenamed("id", key), key, "left_semi")
    out = t["entr"]

    def kids_of(parent, ordinal, kids):
        nonlocal out
        fields = [c for c in t[parent].columns if c != "entr"]
        out = out.join(_rows(t[parent], "entr", [ordinal], f"_{parent}"), "id", "left")
        parts = []
        for kid, order in kids.items():
            if kid not in t:
                continue
            df, key, ref = t[kid], "entr", ordinal
            if kid == "xrer":
                key, ref = "xentr", "xsens"
            if kid == "xref":
                order = SORT
            if kid == "freq":
                df = df.where(F.col(ordinal).isNotNull()).select("entr", ordinal, "kw", "value")
            name = f"_{parent}_{kid}"
            out = out.join(_rows(df, key, order, name), "id", "left")
            parts.append((kid, name, ref, [c for c in df.columns if c not in (key, ref)]))
        empty = lambda n: F.coalesce(F.col(n), F.expr(f"filter({n}, x -> false)"))

        def build(p):
            cols = [p[c].alias(c) for c in fields]
            for kid, name, ref, sub in parts:
                mine = F.filter(F.col(name), lambda x: x[ref] == p[ordinal])
                cols.append(
                    F.coalesce(F.transform(mine, lambda x: F.struct(*[x[c].alias(c) for c in sub])), F.array()).alias(kid)
                )
            return F.struct(*cols)

        arr = F.transform(F.col(f"_{parent}"), build)
        out = out.withColumn(parent, F.coalesce(arr, F.array())).drop(f"_{parent}", *[n for _, n, _, _ in parts])

    if "rdng" in t:
        kids_of("rdng", "rdng", RDNG_KIDS)
    if "kanj" in t:
        kids_of("kanj", "kanj", KANJ_KIDS)
    if "sens" in t:
        kids_of("sens", "sens", SENS_KIDS)
    for kid, order in ENTR_KIDS.items():
        if kid in t:
            out = out.join(_rows(t[kid], "entr", order, kid), "id", "left").withColumn(kid, F.coalesce(kid, F.array()))
    if "chr" in t:
        c = t["chr"]
        cols = [F.col(x) for x in c.columns if x != "entr"]
        if "cinf" in t:
            c = c.withColumnRenamed("entr", "id").join(_rows(t["cinf"], "entr", ["kw", "value"], "cinf"), "id", "left")
            cols.append(F.coalesce("cinf", F.array()).alias("cinf"))
        else:
            c = c.withColumnRenamed("entr", "id")
        out = out.join(c.select("id", F.struct(*cols).alias("chr")), "id", "left")
    return out
