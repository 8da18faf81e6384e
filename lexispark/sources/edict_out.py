"""Entries as dictionary lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.assemble import assemble_entries
from lexispark.sources.dictionary_out import _plain_map


def edict_lines(tables: dict[str, DataFrame], kw: dict[str, DataFrame]) -> DataFrame:
    """(id, line) in the form `K;K(inf)(P) [R(restr)(inf)(P)] /(pos) (n) gloss/.../(P)/`."""
    e = assemble_entries({k: v for k, v in tables.items() if k not in ("xref", "hist")}, reverse=False)
    have = {p: set(e.schema[p].dataType.elementType.names) if p in e.columns else set() for p in ("rdng", "kanj", "sens")}
    m = {d: _plain_map(kw.get(d)) for d in ("kinf", "rinf", "pos", "misc", "dial", "fld", "ginf")}
    K = F.col("kanj") if have["kanj"] else F.array()
    R = F.col("rdng") if have["rdng"] else F.array()
    empty = F.lit("")

    def popular(p, parent) -> Column:
        if "freq" not in have[parent]:
            return F.lit(False)
        return F.exists(p["freq"], lambda f: (f["kw"].isin(1, 2, 7) & (f["value"] == 1)) | (f["kw"] == 4))

    def names(p, parent, field, dom, tail="") -> Column:
        """Comma list of tag names, null without tags."""
        if field not in have[parent]:
            return F.lit(None).cast("string")
        txt = F.transform(p[field], lambda x: F.concat(F.try_element_at(m[dom], x["kw"]), F.lit(tail)))
        return F.when(F.size(txt) > 0, F.array_join(txt, ","))

    boxed = lambda c, o="(", z=")": F.when(c.isNotNull(), F.concat(F.lit(o), c, F.lit(z)))
    mark = lambda p, parent, items: F.when((F.size(items) > 1) & popular(p, parent), "(P)")

    def left(p, parent, field, ordinal, items) -> Column:
        """Texts a deny list leaves; empty when nothing or everything is denied."""
        if field not in have[parent] or not have[ordinal]:
            return F.array().cast("array<string>")
        denied = F.transform(p[field], lambda x: x[ordinal])
        rest = F.transform(F.filter(items, lambda i: ~F.array_contains(denied, i[ordinal])), lambda i: i["txt"])
        return F.when(F.size(denied) > 0, rest).otherwise(F.array().cast("array<string>"))

    kt = F.array_join(F.transform(K, lambda k: F.concat_ws("", k["txt"], boxed(names(k, "kanj", "kinf", "kinf")), mark(k, "kanj", K))), ";")

    def reading(r):
        restr = left(r, "rdng", "restr", "kanj", K)
        restr = F.when(F.size(restr) > 0, F.array_join(restr, ";"))
        return F.concat_ws("", r["txt"], boxed(restr), boxed(names(r, "rdng", "rinf", "rinf")), mark(r, "rdng", R))

    rt = F.array_join(F.transform(R, reading), ";")
    S = F.col("sens")
    pos = F.transform(S, lambda s: boxed(names(s, "sens", "pos", "pos")))
    e = e.withColumn("_pos", pos)

    def sense(s, n):
        own = F.get("_pos", n)
        before = F.filter(F.slice("_pos", F.lit(1), n), lambda x: x.isNotNull())
        last = F.try_element_at(before, F.lit(-1))
        only = F.concat(left(s, "sens", "stagk", "kanj", K), left(s, "sens", "stagr", "rdng", R))
        note = s["notes"] if "notes" in have["sens"] else F.lit(None).cast("string")
        pre = F.concat_ws(
            " ", F.when(last.isNull() | (own != last), own), F.when(n > 0, F.concat(F.lit("("), (n + 1).cast("string"), F.lit(")"))),
            F.when(F.size(only) > 0, F.concat(F.lit("( "), F.array_join(only, ", "), F.lit(" only)"))),
            boxed(names(s, "sens", "misc", "misc")), boxed(names(s, "sens", "dial", "dial", ":")),
            boxed(names(s, "sens", "fld", "fld"), "{", "}"), boxed(F.nullif(note, empty)),
        )
        pre = F.when(pre == "", pre).otherwise(F.concat(pre, F.lit(" ")))
        kind = lambda g: F.concat(F.try_element_at(m["ginf"], g["ginf"]), F.lit(":"))
        first = F.transform(F.slice(s["gloss"], 1, 1), lambda g: F.concat(pre, F.when(g["ginf"] != 1, F.concat(kind(g), F.lit(" "))).otherwise(""), g["txt"]))

        def add(acc, g):
            last_ = F.concat(F.element_at(acc, -1), F.lit(" ("), kind(g), F.lit(" "), g["txt"], F.lit(")"))
            return F.when(g["ginf"] != 1, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(last_))).otherwise(F.concat(acc, F.array(g["txt"])))

        rest = F.slice(s["gloss"], F.lit(2), F.greatest(F.size(s["gloss"]) - 1, F.lit(0)))
        return F.when(F.size(s["gloss"]) > 0, F.aggregate(rest, first, add)).otherwise(F.array().cast("array<string>"))

    items = F.flatten(F.transform(S, sense)) if have["sens"] else F.array().cast("array<string>")
    is_p = F.exists(K, lambda k: popular(k, "kanj")) if have["kanj"] else F.lit(False)
    is_p = is_p | (F.exists(R, lambda r: popular(r, "rdng")) if have["rdng"] else F.lit(False))
    items = F.concat(items, F.when(is_p, F.array(F.lit("(P)"))).otherwise(F.array().cast("array<string>")))
    st = F.when(F.size(items) > 0, F.concat(F.lit("/"), F.array_join(items, "/"), F.lit("/")))
    rtext = F.when(kt != "", F.concat(F.lit("["), rt, F.lit("]"))).otherwise(F.nullif(rt, empty))
    return e.select("id", F.concat_ws(" ", F.nullif(kt, empty), rtext, st).alias("line"))


def write_edict_lines(tables: dict[str, DataFrame], kw: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """One line per entry, in (src, seq, id) order across the files."""
    keys = ["src", "seq", "id"]
    out = edict_lines(tables, kw).join(tables["entr"].select("id", "src", "seq"), "id")
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("line").alias("value")).write.mode(mode).text(path)
