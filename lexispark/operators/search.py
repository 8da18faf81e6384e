"""Entry search: filters on each table, combined as independent existence tests."""

from __future__ import annotations

import dataclasses
import json
import operator
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import (
    FREQ_IDS, KANA, KSYM, LATIN, like_substring, literal_script_class, wildcard_to_like,
)
from lexispark.operators.summary import entry_summary, headwords

STAT_ACTIVE, STAT_DELETED, STAT_REJECTED = 2, 4, 6


class UnknownTag(ValueError):
    pass


# F1, F2 --------------------------------------------------------------------------


def text_match(
    col: Column | str, text: str, mode: str = "is", invert: bool = False,
    lower: bool = False, wildcards: bool = False,
) -> Column:
    """`mode` is one of is, starts, contains, ends.

    With `wildcards` the text is a LIKE pattern (`%`, `_`); without it the comparison is
    literal and `starts` reaches the parquet scan as a StartsWith filter.
    """
    c = F.col(col) if isinstance(col, str) else col
    if lower:
        c, text = F.lower(c), text.lower()
    if mode == "is":
        out = c == text
    elif wildcards:
        out = c.like({"starts": "{}%", "contains": "%{}%", "ends": "%{}"}[mode].format(text))
    else:
        out = {"starts": c.startswith, "contains": c.contains, "ends": c.endswith}[mode](text)
    return ~out if invert else out


def auto_target(text: str) -> str:
    """table a search text belongs to, by its script."""
    cls = literal_script_class(text)
    if cls == 0 or (cls & KANA and not cls & ~(KANA | KSYM)):
        return "rdng"
    return "gloss" if not cls & ~LATIN else "kanj"


# F3, F4, F6 ----------------------------------------------------------------------


def tag_ids(kw: DataFrame | dict[str, int], tags: Iterable[str | int]) -> tuple[list[int], bool]:
    """Ids of tags given by name or id, and whether `NOT` was among them.

    A tag table is fixed vocabulary (hundreds of rows), read once for the lookup.
    """
    tags = list(tags)
    negate = "NOT" in tags
    wanted = [t for t in tags if t != "NOT"]
    if isinstance(kw, dict):
        by_name = kw
    else:
        names = [str(t) for t in wanted]
        hit = kw.where(F.col("kw").isin(names) | F.col("id").cast("string").isin(names))
        by_name = {r["kw"]: r["id"] for r in hit.select("id", "kw").collect()}
    ids = []
    for t in wanted:
        if t in by_name:
            ids.append(by_name[t])
        elif str(t).isdigit() and int(t) in by_name.values():
            ids.append(int(t))
        else:
            raise UnknownTag(f"unknown tag: {t}")
    return ids, negate


def tag_in(col: str, ids: Sequence[int], negate: bool = False) -> Column:
    """tag column in a list of ids."""
    out = F.col(col).isin(list(ids))
    return ~out if negate else out


def tri_state(col: str, values: Sequence[str], true_name: str) -> Column | None:
    """none or both values chosen means no filter."""
    if not values or len(values) == 2:
        return None
    return F.col(col) if values[0] == true_name else ~F.col(col)


def note_match(col: str, pattern: str, regex: bool = False) -> Column:
    """case-insensitive regular expression or substring."""
    return F.col(col).rlike(f"(?i){pattern}") if regex else F.col(col).ilike(like_substring(pattern))


# F5 ------------------------------------------------------------------------------


POPULAR_BANDS = ("gai1", "ichi1", "news1", "spec1")
NF_COMPARE = {"=": operator.eq, "<=": operator.le, "\u2264": operator.le, ">=": operator.ge, "\u2265": operator.ge}


def freq_filter(
    bands: Sequence[str], nf_op: str | None = None, nf_value: int | str | None = None,
    ids: dict[str, int] | None = None,
) -> Column | None:
    """condition on one frequency row; `NOT` negates the row condition."""
    ids = ids or FREQ_IDS
    asked = [b for band in bands if band != "NOT" for b in (POPULAR_BANDS if band == "P" else (band,))]
    split = [re.fullmatch(r"(\D+)(\d+)", b) for b in asked]
    if None in split:
        raise ValueError(f"bad frequency bands: {', '.join(asked)}")
    pairs = {(m[1], int(m[2])) for m in split if m[1] != "nf"}
    terms = []
    for scale in sorted({s for s, _ in pairs}):
        if scale not in ids:
            raise UnknownTag(f"unknown frequency scale: {scale}")
        terms.append((F.col("kw") == ids[scale]) & F.col("value").isin(sorted(v for s, v in pairs if s == scale)))
    if nf_op:
        if nf_op not in NF_COMPARE:
            raise ValueError(f"bad nf comparison: {nf_op}")
        terms.append((F.col("kw") == ids["nf"]) & NF_COMPARE[nf_op](F.col("value"), F.lit(int(nf_value or 0))))
    if not terms:
        return None
    return ~reduce(or_, terms) if "NOT" in bands else reduce(or_, terms)


# F7 ------------------------------------------------------------------------------


def history_filter(
    hist: DataFrame, ts_min=None, ts_max=None, submitter: tuple[str, bool] | None = None,
    comments: tuple[str, bool] | None = None, refs: tuple[str, bool] | None = None, which: int = 0,
) -> DataFrame:
    """entries with one history row meeting every condition.

    `submitter` is (name, wildcard?), `comments` and `refs` (pattern, regex?); `which` is
    1 for the first and -1 for the last row (the row whose number is the row count).
    """
    conds = []
    if ts_min is not None:
        conds.append(F.col("dt") >= F.lit(ts_min))
    if ts_max is not None:
        conds.append(F.col("dt") <= F.lit(ts_max))
    if submitter and submitter[0]:
        name, wild = submitter
        conds.append(F.col("name").ilike(wildcard_to_like(name)) if wild else F.lower("name") == name.lower())
    if comments and comments[0]:
        conds.append(note_match("notes", *comments))
    if refs and refs[0]:
        conds.append(note_match("refs", *refs))
    if which == 1:
        conds.append(F.col("hist") == 1)
    rows = hist.where(reduce(and_, conds)) if conds else hist
    if which == -1:
        last = hist.groupBy("entr").agg(F.count(F.lit(1)).alias("hist"))
        rows = rows.join(last, ["entr", "hist"], "left_semi")
    return rows.select(F.col("entr").alias("id")).distinct()


# F9, F10, F11 --------------------------------------------------------------------


def entries_by_id_or_seq(
    entr: DataFrame, ids: Sequence[int] = (), seqs: Sequence[str | int] = (),
    corpora: dict[str, int] | None = None, corpus: str | int | None = None, active: int = 0,
) -> DataFrame:
    """entries named by id, or by `seq` or `seq.corpus`; each entry once."""
    corpora = corpora or {}

    def corpus_id(c):
        if str(c).isdigit() and int(c) in corpora.values():
            return int(c)
        if c not in corpora:
            raise UnknownTag(f"unknown corpus: {c}")
        return corpora[c]

    conds = [F.col("id").isin([int(i) for i in ids])] if ids else []
    default = corpus_id(corpus) if corpus is not None else None
    for q in seqs:
        num, _, c = str(q).partition(".")
        if not num.isdigit() or int(num) <= 0:
            raise ValueError(f"bad sequence number: {q}")
        src = corpus_id(c) if c else default
        cond = F.col("seq") == int(num)
        conds.append(cond & (F.col("src") == src) if src is not None else cond)
    if not conds:
        raise ValueError("no entry or sequence numbers given")
    out = entr.where(reduce(or_, conds))
    if active == 1:
        out = out.where((F.col("stat") == STAT_ACTIVE) & (~F.col("unap") | F.col("dfrm").isNull()))
    return out


def corpus_selector(spec: str, corpora: dict[str, int], col: str = "src", null_passes: bool = False) -> Column:
    """condition from `a,b`, `!a`, `-a`, and id ranges `a:b`, `a:`, `:b`."""
    negate = spec[:1] in ("!", "-")
    by_id = {str(i): i for i in corpora.values()} | corpora
    c = F.col(col)

    def one(name):
        if name not in by_id:
            raise UnknownTag(f"unknown corpus: {name}")
        return by_id[name]

    terms = []
    for item in (spec[1:] if negate else spec).split(","):
        lo, colon, hi = item.strip().partition(":")
        if not colon:
            terms.append(c == one(lo))
        elif lo or hi:
            terms.append(
                reduce(and_, ([c >= one(lo)] if lo else []) + ([c <= one(hi)] if hi else []))
            )
        else:
            raise UnknownTag("empty corpus range")
    cond = reduce(or_, terms)
    cond = ~cond if negate else cond
    return cond | c.isNull() if null_passes else cond


def char_lookup(chr_: DataFrame, chars: str = "", code_points: Sequence[str] = ()) -> DataFrame:
    """character rows by character or hexadecimal code point."""
    wanted = list(chars) + [chr(int(h.removeprefix("U+").removeprefix("u+"), 16)) for h in code_points]
    return chr_.where(F.col("chr").isin(wanted))


# F12 -----------------------------------------------------------------------------


@dataclass
class Condition:
    """A condition on one child table.

    Conditions with the same `table` and `alias` hold on the same row.  `outer` keeps
    entries without rows in the table (their condition counts as not met).
    """

    table: str
    cond: Column
    alias: str = ""
    outer: bool = False


def search(
    entr: DataFrame, tables: dict[str, DataFrame], conditions: Sequence[Condition], any_of: bool = False
) -> DataFrame:
    """distinct ids of entries meeting all (or any) of the conditions.

    All: one semi join per table group.  Any: one flag per group and entry, combined
    before the shuffle; as the tables are inner-joined in the original query, an entry
    needs a row in every table that is not `outer`.
    """
    conditions = [c for c in conditions if c is not None]
    if not conditions:
        raise ValueError("no search conditions")
    combine = or_ if any_of else and_
    groups: dict[tuple[str, str], list[Condition]] = {}
    for c in conditions:
        groups.setdefault((c.table, c.alias if c.table != "entr" else ""), []).append(c)
    entr_conds = groups.pop(("entr", ""), [])
    own = reduce(combine, [c.cond for c in entr_conds]) if entr_conds else None
    if not any_of:
        out = (entr.where(own) if own is not None else entr).select("id").distinct()
        for (table, _), cs in groups.items():
            hit = tables[table].where(reduce(and_, [c.cond for c in cs]))
            out = out.join(hit.select(F.col("entr").alias("id")), "id", "left_semi")
        return out
    out = entr.select("id", (own if own is not None else F.lit(False)).alias("_f"))
    flags = ["_f"]
    for i, ((table, _), cs) in enumerate(groups.items()):
        name = f"_f{i}"
        cond = reduce(or_, [c.cond for c in cs])
        hit = tables[table].groupBy(F.col("entr").alias("id")).agg(F.max(cond).alias(name))
        out = out.join(hit, "id", "left" if any(c.outer for c in cs) else "inner")
        flags.append(name)
    met = reduce(or_, [F.coalesce(f, F.lit(False)) for f in flags])
    return out.where(met).select("id").distinct()


# F13 -----------------------------------------------------------------------------


class _Strict:
    def __setattr__(self, name, value):
        if name not in {f.name for f in dataclasses.fields(self)}:
            raise AttributeError(f"{type(self).__name__} has no attribute {name}")
        object.__setattr__(self, name, value)


@dataclass
class TextCriterion(_Strict):
    text: str = ""
    target: str = "auto"  # auto, kanj, rdng, gloss
    mode: str = "is"
    invert: bool | str = False  # False, "any_row" or "no_row"


@dataclass
class SearchCriteria(_Strict):
    """what to search for; unknown names are refused."""

    id: int | None = None
    seq: int | None = None
    src: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    pos: list = field(default_factory=list)
    misc: list = field(default_factory=list)
    fld: list = field(default_factory=list)
    dial: list = field(default_factory=list)
    kinf: list = field(default_factory=list)
    rinf: list = field(default_factory=list)
    grp: list = field(default_factory=list)
    stat: list = field(default_factory=list)
    unap: list = field(default_factory=list)
    freq: list = field(default_factory=list)
    nf_op: str | None = None
    nf_value: int | None = None
    note: str | None = None
    note_regex: bool = False
    ts_min: str | None = None
    ts_max: str | None = None
    submitter: list | None = None
    comments: list | None = None
    refs: list | None = None
    which: int = 0

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> SearchCriteria:
        raw = json.loads(text)
        raw["texts"] = [TextCriterion(**t) for t in raw.get("texts", [])]
        return cls(**raw)


def search_entries(tables: dict[str, DataFrame], criteria: SearchCriteria) -> DataFrame:
    """F12 + F13: ids of the entries a criteria object asks for."""
    entr = tables["entr"]
    ids = lambda dom, tags: tag_ids(tables[f"kw{dom}"], tags)
    if criteria.id:
        return entr.where(F.col("id") == int(criteria.id)).select("id")
    conds: list[Condition] = []
    exclude: list[DataFrame] = []
    if criteria.src:
        conds.append(Condition("entr", tag_in("src", *ids("src", criteria.src))))
    if criteria.seq:
        conds.append(Condition("entr", F.col("seq") == int(criteria.seq)))
        return search(entr, tables, conds)
    for n, t in enumerate(criteria.texts):
        target = auto_target(t.text) if t.target == "auto" else t.target
        match = text_match("txt", t.text, t.mode, lower=target == "gloss", wildcards=True)
        if t.invert == "no_row":
            exclude.append(tables[target].where(match).select(F.col("entr").alias("id")))
        else:
            conds.append(Condition(target, ~match if t.invert else match, alias=str(n)))
    for dom in ("pos", "misc", "fld", "dial", "kinf", "rinf", "grp"):
        if getattr(criteria, dom):
            conds.append(Condition(dom, tag_in("kw", *ids(dom, getattr(criteria, dom)))))
    if criteria.stat:
        stats = {"A": STAT_ACTIVE, "D": STAT_DELETED, "R": STAT_REJECTED}
        conds.append(Condition("entr", tag_in("stat", *tag_ids(stats, criteria.stat))))
    unap = tri_state("unap", criteria.unap, "unappr")
    if unap is not None:
        conds.append(Condition("entr", unap))
    freq = freq_filter(criteria.freq, criteria.nf_op, criteria.nf_value)
    if freq is not None:
        conds.append(Condition("freq", freq))
    if criteria.note:
        conds.append(Condition("sens", note_match("notes", criteria.note, criteria.note_regex)))
    asks_history = any((criteria.ts_min, criteria.ts_max, criteria.submitter, criteria.comments, criteria.refs, criteria.which))
    out = search(entr, tables, conds) if conds else None
    if out is None:
        if not (asks_history or exclude):
            raise ValueError("no search conditions")
        out = entr.select("id")
    if asks_history:
        hit = history_filter(
            tables["hist"], criteria.ts_min, criteria.ts_max, criteria.submitter,
            criteria.comments, criteria.refs, criteria.which,
        )
        out = out.join(hit, "id", "left_semi")
    for ex in exclude:
        out = out.join(ex, "id", "left_anti")
    return out


# T1, T2, T3 ----------------------------------------------------------------------

PAGE_ORDER = ("kanj", "rdng", "seq", "id")


def page_size(size: int | None, most: int = 1000) -> int:
    """Rows of a page: 100 if not given.  Larger pages than `most` are refused, not cut;
    whole results are for `ordered_export`."""
    rows = max(int(size or 100), 1)
    if rows > most:
        raise ValueError(f"a page has at most {most} rows")
    return rows


def search_page(
    tables: dict[str, DataFrame], ids: DataFrame, offset: int = 0, size: int | None = None
) -> DataFrame:
    """One page of summaries in display order.

    Only the sort columns of the hits go through the top-n; glosses are built for the
    rows of the page, which a page size bounds.
    """
    e, r, k = tables["entr"], tables["rdng"], tables["kanj"]
    hits = e.join(ids.select("id").distinct(), "id", "left_semi")
    only = lambda df, p: df.join(p.select(F.col("id").alias("entr")), "entr", "left_semi")
    heads = headwords(hits.select("id", "seq"), r, k)
    page = (
        heads.orderBy(*[F.asc_nulls_last(c) for c in ("ktxt", "rtxt", "seq", "id")])
        .offset(offset)
        .limit(page_size(size))
        .select("id")
    )
    sub = e.join(page, "id", "left_semi")
    kids = {t: only(tables[t], page) for t in ("rdng", "kanj", "sens", "gloss", "freq")}
    out = entry_summary(sub, kids["rdng"], kids["kanj"], kids["sens"], kids["gloss"], kids["freq"])
    return out.orderBy(*[F.asc_nulls_last(c) for c in PAGE_ORDER])


def page_total(ids: DataFrame, page_rows: int, size: int | None, known_total: int = -1) -> int:
    """Number of hits, counted only when a full page leaves it open."""
    if known_total >= 0:
        return known_total
    return ids.count() if page_rows >= page_size(size) else page_rows


def ordered_export(entr: DataFrame, after: tuple[int, int, int] | None = None, partitions: int | None = None) -> DataFrame:
    """Entries range-partitioned and sorted by (src, seq, id); resumes after a key."""
    if after is not None:
        s, q, i = after
        c = F.col
        entr = entr.where(
            (c("src") > s) | ((c("src") == s) & ((c("seq") > q) | ((c("seq") == q) & (c("id") > i))))
        )
    keys = ["src", "seq", "id"]
    parted = entr.repartitionByRange(partitions, *keys) if partitions else entr.repartitionByRange(*keys)
    return parted.sortWithinPartitions(*keys)
