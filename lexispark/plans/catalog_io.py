"""Registered queries for sources, sinks, change sets and streams.

Files are written to the shared folder from the bridge tables and read back through the
readers, so the amount of work follows the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.functions import text as X
from lexispark.functions.languages import language_code
from lexispark.operators import assemble, bulk, submissions
from lexispark.plans.bridge import Bridge
from lexispark.plans.catalog import _E4 as EDIT_POSITIONS
from lexispark.plans.catalog import query
from lexispark.session import scratch_path
from lexispark.sources import clipfiles, dictionary, dictionary_out, edict, edict_out, importer, json_entries, kanji, sentences, tables as store, tagtables
from lexispark.streaming import history as streams

# Alphabets that stand for Latin letters and digits in generated Japanese text.
LATIN = "abcdefghijklmnopqrstuvwxyz"
KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
DIGITS, NUMERALS = "0123456789", "一二三四五六七八九十"


def _vocab(b: Bridge) -> dict[str, DataFrame]:
    """Tag tables: the bridge's own, and fixed vocabulary where it has none."""
    lit = lambda *kv: b.spark.createDataFrame([(i, k, k, None) for i, k in kv], "id INT, kw STRING, descr STRING, ents STRING")
    own = lambda df: df.select(F.col("id").cast("int").alias("id"), "kw", F.col("kw").alias("descr"), F.lit(None).cast("string").alias("ents"))
    return {
        "pos": own(b.kwpos), "misc": own(b.kwmisc), "freq": b.kwfreq, "ginf": b.kwginf, "lang": lit((1, "eng"), (137, "fre")),
        "xref": lit((2, "ant"), (3, "see"), (6, "uses")), "stat": lit((2, "A"), (4, "D"), (6, "R")),
        "kinf": lit((1, "iK")), "rinf": lit((1, "ik"), (103, "name"), (106, "kun"), (128, "on")), "fld": lit((1, "comp")), "dial": lit((1, "ksb")),
        "src": b.kwsrc, "grp": b.kwgrp,
        "cinf": lit((25, "jis208"), (24, "strokes"), (1, "nelson_c"), (18, "skip"), (23, "pinyin")),
    }


def _tables(b: Bridge, *names: str, step: int = 0) -> dict[str, DataFrame]:
    t = {n: b.renumbered(n, step, ("id", "dfrm", "entr")) for n in names} if step else b.tables(*names)
    if "gloss" in t:
        t["gloss"] = t["gloss"].withColumn("lang", F.lit(1))
    if "entr" in t:
        t["entr"] = t["entr"].select("id", "src", "stat", "seq", "dfrm", "unap")
    if "sens" in t:
        t["sens"] = t["sens"].select("entr", "sens", "notes")
    return t


# --- S1, S9, S14 -------------------------------------------------------------------

_XML = """rx AS (SELECT r.entr, string_agg('<r_ele>' || chr(10) || '<reb>' || r.txt || '</reb>' || chr(10) || CASE WHEN NOT EXISTS (SELECT 1 FROM restr z WHERE z.entr = r.entr AND z.rdng = r.rdng) THEN ''
 ELSE coalesce((SELECT string_agg('<re_restr>' || k.txt || '</re_restr>' || chr(10), '' ORDER BY k.kanj) FROM kanj k WHERE k.entr = r.entr AND NOT EXISTS (SELECT 1 FROM restr z WHERE z.entr = r.entr AND z.rdng = r.rdng AND z.kanj = k.kanj)),
 '<re_nokanji/>' || chr(10)) END || '</r_ele>' || chr(10), '' ORDER BY r.rdng) AS x FROM rdng r GROUP BY r.entr),
 kx AS (SELECT entr, string_agg('<k_ele>' || chr(10) || '<keb>' || txt || '</keb>' || chr(10) || '</k_ele>' || chr(10), '' ORDER BY kanj) AS x FROM kanj GROUP BY entr),
 sx AS (SELECT s.entr, string_agg('<sense>' || chr(10) || coalesce((SELECT string_agg('<pos>&' || k.kw || ';</pos>' || chr(10), '' ORDER BY p.ord) FROM pos p JOIN kwpos k ON k.id = p.kw WHERE p.entr = s.entr AND p.sens = s.sens), '')
 || coalesce('<s_inf>' || s.notes || '</s_inf>' || chr(10), '') || coalesce((SELECT string_agg('<gloss' || CASE WHEN g.ginf <> 1 THEN ' g_type="' || k.kw || '"' ELSE '' END || '>' || g.txt || '</gloss>' || chr(10), '' ORDER BY g.gloss) FROM gloss g JOIN kwginf k
 ON k.id = g.ginf WHERE g.entr = s.entr AND g.sens = s.sens), '') || '</sense>' || chr(10), '' ORDER BY s.sens) AS x FROM sens s GROUP BY s.entr)"""
_JMD = "e.stat = 2 AND NOT e.unap AND e.src IN (SELECT id FROM kwsrc WHERE srct = 'jmdict')"


@query(
    "s9_entry_xml",
    f"""SELECT e.id, '<entry>' || chr(10) || '<ent_seq>' || CAST(e.seq AS VARCHAR) || '</ent_seq>' || chr(10) || coalesce(kx.x, '') || coalesce(rx.x, '') || coalesce(sx.x, '') || '</entry>' AS xml
 FROM entr e LEFT JOIN kx ON kx.entr = e.id LEFT JOIN rx ON rx.entr = e.id LEFT JOIN sx ON sx.entr = e.id WHERE {_JMD}""",
    ctes=_XML,
)
def s9(b):
    t, kw = _tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos", "restr"), _vocab(b)
    t["entr"] = dictionary_out.select_for_export(t["entr"], kw["src"], "jmdict")
    return dictionary_out.entry_xml(t, kw, "jmdict").select("id", "xml")


def _round_trip(b):
    """Everything out as the complete dialect and in again; `idx` keeps the old entry id.

    Ids start at 1 in a dictionary (0 stands for none in the file), so they are moved up.
    """
    kw = _vocab(b)
    path = scratch_path(b.spark, "xml")
    out = _tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos", "restr", "stagr", "freq", "grp", step=1)
    dictionary_out.write_dictionary_xml(out, kw, path, "jmex")
    return dictionary.read_dictionary_xml(b.spark, path, "jmex", {**kw, "grp": b.kwgrp})


@query("s1_read_gloss", "SELECT entr + 1 AS idx, sens, gloss, ginf, txt FROM gloss")
def s1(b):
    t = _round_trip(b)
    ids = t["entr"].select(F.col("id").alias("entr"), "idx")
    return t["gloss"].join(ids, "entr").select("idx", "sens", "gloss", "ginf", "txt")


@query("s1_read_entries", "SELECT e.id + 1 AS idx, e.stat, e.seq, e.dfrm + 1 AS dfrm, e.unap, k.kw AS corpus, (SELECT count(*) FROM restr z WHERE z.entr = e.id) AS n_restr, (SELECT count(*) FROM freq f WHERE f.entr = e.id AND (EXISTS (SELECT 1 FROM rdng r WHERE r.entr = f.entr AND r.rdng = f.rdng) OR EXISTS (SELECT 1 FROM kanj r WHERE r.entr = f.entr AND r.kanj = f.kanj))) AS n_freq, (SELECT count(*) FROM grp g WHERE g.entr = e.id) AS n_grp FROM entr e JOIN kwsrc k ON k.id = e.src")
def s1b(b):
    t = _round_trip(b)
    out = t["entr"].join(t["kwsrc"].select(F.col("id").alias("src"), F.col("kw").alias("corpus")), "src")
    for n in ("restr", "freq", "grp"):
        out = out.join(t[n].groupBy(F.col("entr").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{n}")), "id", "left")
    zero = [F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in ("restr", "freq", "grp")]
    return out.select("idx", "stat", "seq", "dfrm", "unap", "corpus", *zero)


@query(
    "s14_extract_by_seq",
    "SELECT id, seq FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM t) x WHERE EXISTS (SELECT 1 FROM (SELECT seq, row_number() OVER (ORDER BY id) AS m FROM t) w WHERE w.seq % 100 = 7 AND x.n BETWEEN w.m AND w.m + w.seq % 3)",
    ctes="t AS (SELECT p_partkey AS id, p_partkey * 3 + 1 AS seq FROM part)",
)
def s14(b):
    path = scratch_path(b.spark, "extract")
    p = b.part.select((F.col("p_partkey") * 3 + 1).alias("seq"), "p_partkey", "p_name").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey")
    xml = F.concat(F.lit('<entry id="'), "p_partkey", F.lit('"><ent_seq>'), "seq", F.lit("</ent_seq><r_ele><reb>"), "p_name", F.lit("</reb></r_ele></entry>"))
    p.select(xml.alias("value")).write.text(path)
    wanted = b.part.select((F.col("p_partkey") * 3 + 1).alias("seq")).where("seq % 100 = 7").withColumn("cnt", (F.col("seq") % 3 + 1).cast("int"))
    hit, _ = dictionary.extract_by_seq(b.spark, path, wanted)
    return hit.select(F.regexp_extract("xml", r'id="(\d+)"', 1).cast("bigint").alias("id"), "seq")


# --- S10, S5 -----------------------------------------------------------------------

_LINE = """km AS (SELECT k.entr, string_agg(k.txt || CASE WHEN n.n > 1 AND EXISTS (SELECT 1 FROM freq f WHERE f.entr = k.entr AND f.kanj = k.kanj AND ((f.kw IN (1,2,7) AND f.value = 1) OR f.kw = 4)) THEN '(P)' ELSE '' END, ';' ORDER BY k.kanj) AS x
 FROM kanj k JOIN (SELECT entr, count(*) AS n FROM kanj GROUP BY entr) n ON n.entr = k.entr GROUP BY k.entr),
 rm AS (SELECT k.entr, string_agg(k.txt || CASE WHEN n.n > 1 AND EXISTS (SELECT 1 FROM freq f WHERE f.entr = k.entr AND f.rdng = k.rdng AND ((f.kw IN (1,2,7) AND f.value = 1) OR f.kw = 4)) THEN '(P)' ELSE '' END, ';' ORDER BY k.rdng) AS x
 FROM rdng k JOIN (SELECT entr, count(*) AS n FROM rdng GROUP BY entr) n ON n.entr = k.entr GROUP BY k.entr),
 pp AS (SELECT p.entr, p.sens, '(' || string_agg(k.kw, ',' ORDER BY p.ord) || ')' AS x FROM pos p JOIN kwpos k ON k.id = p.kw GROUP BY ALL),
 pv AS (SELECT s.entr, s.sens, p.x, last_value(p.x IGNORE NULLS) OVER (PARTITION BY s.entr ORDER BY s.sens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sens s LEFT JOIN pp p ON p.entr = s.entr AND p.sens = s.sens),
 sm AS (SELECT v.entr, string_agg(CASE WHEN v.x IS NOT NULL AND v.x IS DISTINCT FROM v.prev THEN v.x || ' ' ELSE '' END || CASE WHEN v.sens > 1 THEN '(' || CAST(v.sens AS VARCHAR) || ') ' ELSE '' END || g.x, '/' ORDER BY v.sens) AS x FROM pv v
 JOIN (SELECT entr, sens, string_agg(txt, '/' ORDER BY gloss) AS x FROM gloss GROUP BY entr, sens) g ON g.entr = v.entr AND g.sens = v.sens GROUP BY v.entr)"""


@query(
    "s10_edict_lines",
    """SELECT e.id, concat_ws(' ', km.x, CASE WHEN km.x IS NOT NULL THEN '[' || coalesce(rm.x, '') || ']' ELSE rm.x END, CASE WHEN sm.x IS NOT NULL OR p.p THEN '/' || concat_ws('/', sm.x, CASE WHEN p.p THEN '(P)' END) || '/' END) AS line FROM entr e LEFT JOIN km ON km.entr = e.id
 LEFT JOIN rm ON rm.entr = e.id LEFT JOIN sm ON sm.entr = e.id JOIN (SELECT id, EXISTS (SELECT 1 FROM freq f WHERE f.entr = entr.id AND ((f.rdng IS NOT NULL AND EXISTS (SELECT 1 FROM rdng r WHERE r.entr = f.entr AND r.rdng = f.rdng)) OR
 (f.kanj IS NOT NULL AND EXISTS (SELECT 1 FROM kanj r WHERE r.entr = f.entr AND r.kanj = f.kanj))) AND ((f.kw IN (1,2,7) AND f.value = 1) OR f.kw = 4)) AS p FROM entr) p ON p.id = e.id""",
    ctes=_LINE,
)
def s10(b):
    t = _tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos", "freq")
    t["gloss"] = t["gloss"].withColumn("ginf", F.lit(1))
    t["sens"] = t["sens"].select("entr", "sens")
    return edict_out.edict_lines(t, _vocab(b))


def _kana(c):
    return F.translate(F.lower(c), LATIN + " ", KANA)


def _kanji(c):
    return F.concat(F.lit("漢"), F.translate(c, DIGITS + "#SUPLIERsuplier", NUMERALS))


_KANA_SQL = f"translate(lower(txt), '{LATIN} ', '{KANA}')"


@query(
    "s5_edict_read",
    f"""SELECT CAST(e.id + 1 AS BIGINT) AS seq, (SELECT string_agg({_KANA_SQL}, ';' ORDER BY rdng) FROM rdng WHERE entr = e.id) AS readings,
 (SELECT string_agg(g.gs, '|' ORDER BY s.sens) FROM sens s JOIN (SELECT entr, sens, string_agg(txt, '/' ORDER BY gloss) AS gs FROM gloss GROUP BY ALL) g ON g.entr = s.entr AND g.sens = s.sens WHERE s.entr = e.id) AS glosses,
 (SELECT string_agg(coalesce(CAST(lp AS VARCHAR), ''), '|' ORDER BY sens) FROM (SELECT s.entr, s.sens, last_value(p.x IGNORE NULLS) OVER (PARTITION BY s.entr ORDER BY s.sens) AS lp FROM sens s LEFT JOIN (SELECT entr, sens, string_agg(CAST(kw AS VARCHAR), ',' ORDER BY ord) AS x FROM pos GROUP BY ALL) p
 ON p.entr = s.entr AND p.sens = s.sens) q WHERE q.entr = e.id) AS pos FROM entr e WHERE EXISTS (SELECT 1 FROM rdng r WHERE r.entr = e.id) AND EXISTS (SELECT 1 FROM sens r WHERE r.entr = e.id)""",
)
def s5(b):
    """Lines of every entry with readings and senses, written as text and read again."""
    kw = _vocab(b)
    t = _tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos")
    t["gloss"], t["sens"] = t["gloss"].withColumn("ginf", F.lit(1)), t["sens"].select("entr", "sens")
    t["rdng"] = t["rdng"].withColumn("txt", _kana("txt"))
    t["kanj"] = t["kanj"].withColumn("txt", _kanji("txt"))
    # Merged by entry: broadcast, the numbers of all readings and senses would lie in the driver.
    for name in ("rdng", "sens"):
        t["entr"] = t["entr"].join(t[name].select(F.col("entr").alias("id")).hint("merge"), "id", "left_semi")
    path = scratch_path(b.spark, "edict")
    lines = edict_out.edict_lines(t, kw).select(F.concat("line", F.lit("EntL"), (F.col("id") + 1).cast("string"), F.lit("/")).alias("value"))
    lines.write.text(path)
    r = edict.read_edict_lines(b.spark, path, kw)
    e = assemble.assemble_entries({k: r[k] for k in ("entr", "rdng", "sens", "gloss", "pos")}, reverse=False)
    join = lambda s, k, c, sep: F.array_join(F.transform(s[k], lambda g: g[c].cast("string")), sep)
    return e.select(
        "seq", F.array_join(F.transform("rdng", lambda x: x["txt"]), ";").alias("readings"),
        F.array_join(F.transform("sens", lambda s: join(s, "gloss", "txt", "/")), "|").alias("glosses"),
        F.array_join(F.transform("sens", lambda s: join(s, "pos", "kw", ",")), "|").alias("pos"),
    )


# --- S3, S4 ------------------------------------------------------------------------


@query("s3_kanji_chr", "SELECT CASE WHEN p_partkey < 20000 THEN 19968 ELSE 111072 END + p_partkey AS seq, p_size AS strokes, CASE WHEN p_size % 3 = 0 THEN p_size END AS grade, CAST(1 AS BIGINT) AS n_rdng, CAST(2 AS BIGINT) AS n_cinf FROM part")
def s3(b):
    cp = F.col("p_partkey") + F.when(F.col("p_partkey") < 20000, 19968).otherwise(111072)  # then on from U+20000
    # Unicode ends at U+10FFFF: a part beyond it is a code point without a character.
    ch = F.when(cp > 0x10FFFF, kanji.NO_CHARACTER).otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
    size = F.col("p_size").cast("string")
    el = lambda tag, c, attr="": F.concat(F.lit(f"<{tag}{attr}>"), c, F.lit(f"</{tag}>"))
    grade = F.when(F.col("p_size") % 3 == 0, el("grade", size)).otherwise("")
    xml = F.concat(
        F.lit("<character><literal>"), ch, F.lit("</literal><codepoint>"), el("cp_value", F.lower(F.hex(cp)), ' cp_type="ucs"'), F.lit("</codepoint><misc>"), grade, el("stroke_count", size),
        F.lit("</misc><dic_number>"), el("dic_ref", size, ' dr_type="nelson_c"'), el("dic_ref", size, ' dr_type="nelson_c"'), F.lit("</dic_number><query_code>"), el("q_code", F.concat(size, F.lit("-1")), ' qc_type="skip"'),
        F.lit("</query_code><reading_meaning><rmgroup>"), el("reading", F.lit("カ"), ' r_type="ja_on"'), el("meaning", F.col("p_name")), F.lit("</rmgroup><nanori>カ</nanori></reading_meaning></character>"),
    )
    path = scratch_path(b.spark, "kanji")
    b.part.select(xml.alias("value")).write.text(path)
    t = kanji.read_kanji_xml(b.spark, path, _vocab(b))
    n = lambda name: t[name].groupBy(F.col("entr").alias("id")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    out = t["entr"].join(t["chr"].withColumnRenamed("entr", "id"), "id").join(n("rdng"), "id").join(n("cinf"), "id")
    return out.select("seq", "strokes", "grade", "n_rdng", "n_cinf")


@query(
    "s4_sentence_refs",
    """SELECT CASE WHEN x > y THEN x * x + 2 * (x - y) - 1 ELSE y * y + 2 * (y - x) END + 1 AS seq, g AS gloss, n AS ord, CASE WHEN n = 1 THEN 'か' ELSE NULL END AS rtxt, CASE WHEN n = 2 THEN '漢' END AS ktxt, CASE WHEN n = 2 THEN CAST(p_size AS INT) END AS tsens,
 n = 2 AS prio FROM (SELECT c_custkey + 1 - 1 AS x, c_nationkey + 1 - 1 AS y, c_name AS g, 1 + c_custkey % 50 AS p_size FROM customer) c JOIN (SELECT 1 AS n UNION ALL SELECT 2) k ON 1 = 1""",
)
def s4(b):
    c = b.customer
    a = F.concat(F.lit("A: 漢かな\t"), "c_name", F.lit("#ID="), (F.col("c_custkey") + 1).cast("string"), F.lit("_"), (F.col("c_nationkey") + 1).cast("string"))
    items = F.concat(F.lit("B: か{かな} 漢["), (F.col("c_custkey") % 50 + 1).cast("string"), F.lit("]~ ？(x) 漢{ない}"))
    path = scratch_path(b.spark, "sentences")
    c.select(F.concat_ws("\n", a, items).alias("value")).write.text(path)
    t = sentences.read_sentence_pairs(b.spark, path)
    e = t["entr"].select(F.col("id").alias("entr"), "seq").join(t["gloss"].select("entr", F.col("txt").alias("gloss")), "entr")
    return e.join(t["xresolv"], "entr").select("seq", "gloss", "ord", "rtxt", "ktxt", "tsens", "prio")


# --- S6, S7, S8, S11, S12, S13 -------------------------------------------------------


@query("s6_tag_tables", "SELECT CAST(c_custkey AS INT) AS id, c_name AS kw, '\"' || c_mktsegment AS descr FROM customer")
def s6(b):
    path = scratch_path(b.spark, "tags")
    rows = b.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("kw"), F.concat(F.lit('"'), "c_mktsegment").alias("descr"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(f"{path}/kwpos.csv")
    return tagtables.read_tag_tables(b.spark, path)[0]["pos"].select("id", "kw", "descr")


@query(
    "s7_import",
    """SELECT id, src, entr_dfrm AS dfrm FROM (SELECT id, src, dfrm AS entr_dfrm FROM entr UNION ALL SELECT e.id + (SELECT max(id) FROM entr), e.src + 5, CASE WHEN e.id % 5 = 1 THEN e.id - 1 + (SELECT max(id) FROM entr) END FROM t_entr e) x""",
)
def s7(b):
    base = {"entr": b.entr.select("id", "src", "stat", "seq", "unap", "dfrm", F.lit(None).cast("bigint").alias("idx")), "kwsrc": b.kwsrc, "rdng": b.rdng}
    e = b.t_entr.select("id", "src", "stat", F.col("id").alias("seq"), "unap", F.when(F.col("id") % 5 == 1, 7000 + F.col("id") - 1).alias("dfrm"), (F.col("id") + 7000).alias("idx"))
    stage = {"entr": e, "rdng": b.t_rdng, "kwsrc": b.kwsrc.withColumn("kw", F.concat(F.lit("new "), "kw"))}
    return importer.import_corpus(stage, base)["entr"].select("id", "src", "dfrm")


@query("s8_store", "SELECT id, src, seq FROM entr")
def s8(b):
    path = scratch_path(b.spark, "store")
    store.write_tables(b.tables("entr", "rdng"), path)
    return store.read_tables(b.spark, path, ["entr"])["entr"].select("id", "src", "seq")


@query("s8_copy_rows", "SELECT doc_id, md5(replace(text, chr(13), '')) AS h, lang FROM documents")
def s8b(b):
    path = scratch_path(b.spark, "copy")
    store.copy_rows(b.documents.select("doc_id", "text", "lang")).write.text(path)
    back = store.read_copy_rows(b.spark.read.text(path), "doc_id BIGINT, text STRING, lang STRING")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "lang")


@query("s11_json", "SELECT s.entr AS id, s.sens, (SELECT string_agg(g.txt, '|' ORDER BY g.gloss) FROM gloss g WHERE g.entr = s.entr AND g.sens = s.sens) AS txt FROM sens s JOIN entr e ON e.id = s.entr")
def s11(b):
    e = assemble.assemble_entries(_tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos", "freq"), reverse=False)
    back = json_entries.entries_from_json(json_entries.entries_to_json(e), e.schema)
    s = back.select("id", F.explode("sens").alias("s"))
    return s.select("id", "s.sens", F.array_join(F.transform("s.gloss", lambda g: g["txt"]), "|").alias("txt"))


@query("s12_clips", "SELECT id, file, nullif(strt, 0) AS strt, nullif(leng, 0) AS leng, trns FROM snd")
def s12(b):
    path = scratch_path(b.spark, "clips")
    clipfiles.write_clips_xml(b.tables("sndvol", "sndfile", "snd"), path)
    return clipfiles.read_clips_xml(b.spark, path)["snd"].select("id", "file", "strt", "leng", "trns")


@query("s13_labels", "SELECT CAST(floor(CAST(printf('%.6f', strt / 100.0) AS DOUBLE) * 100) AS BIGINT) AS strt, CAST(floor(CAST(printf('%.6f', (strt + leng) / 100.0) AS DOUBLE) * 100) - floor(CAST(printf('%.6f', strt / 100.0) AS DOUBLE) * 100) AS BIGINT) AS leng, trns FROM snd")
def s13(b):
    path = scratch_path(b.spark, "labels")
    clipfiles.write_labels(b.snd, path)
    return clipfiles.read_labels(b.spark, path)


# --- X12, X13, X17 -------------------------------------------------------------------


@query(
    "x12_tag_entity",
    """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN p_brand WHEN 2 THEN NULL ELSE p_brand || 'x' END AS jn, CASE p_size % 4 WHEN 2 THEN NULL ELSE p_brand END AS jm FROM part""",
)
def x12(b):
    m = F.col("p_size") % 4
    ents = F.when(m == 0, None).when(m == 1, '{"jmnedict":1}').when(m == 2, '{"jmdict":0}').otherwise(F.concat(F.lit('{"jmnedict":{"e":"'), "p_brand", F.lit('x"}}')))
    p = b.part.withColumn("ents", ents)
    e = lambda d: X.tag_entity("ents", "p_brand", "p_type", d)["name"]
    return p.select(F.col("p_partkey").alias("id"), e("jmnedict").alias("jn"), e("jmdict").alias("jm"))


@query("x13_language_code", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' WHEN 'de' THEN 'ger' WHEN 'es' THEN 'spa' WHEN 'it' THEN 'ita' WHEN 'nl' THEN 'dut' WHEN 'pt' THEN 'por' WHEN 'zh' THEN 'chi' WHEN 'ja' THEN 'jpn' END AS code FROM documents")
def x13(b):
    return b.documents.select("doc_id", language_code(b.spark, "lang").alias("code"))


@query(
    "x17_lookup_tag",
    """SELECT t.entr, t.tag, h.domain, h.id, h.value FROM (SELECT o_orderkey AS entr, c_mktsegment AS tag FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT l_orderkey, 'nf' || CAST(l_linenumber AS VARCHAR) FROM lineitem) t LEFT JOIN
 (SELECT kw AS tag, 'MISC' AS domain, id, NULL AS value FROM kwmisc UNION ALL SELECT kw, 'GRP', id, NULL FROM kwgrp UNION ALL SELECT DISTINCT 'nf' || CAST(l_linenumber AS VARCHAR), 'FREQ', 5, l_linenumber FROM lineitem) h ON h.tag = t.tag""",
)
def x17(b):
    seg = b.orders.join(b.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("entr"), F.col("c_mktsegment").alias("tag"))
    nf = b.lineitem.select(F.col("l_orderkey").alias("entr"), F.concat(F.lit("nf"), F.col("l_linenumber").cast("string")).alias("tag"))
    out = tagtables.lookup_tags(seg.unionByName(nf), {"misc": b.kwmisc, "grp": b.kwgrp, "freq": b.kwfreq})
    return out.select("entr", "tag", "domain", "id", "value")


# --- E5, E9 --------------------------------------------------------------------------


@query(
    "e5_submissions",
    """SELECT id AS sid, CASE WHEN id <> first THEN 'deferred' WHEN stat = 6 THEN 'parent_rejected' WHEN id % 3 = 0 AND n_paths > 1 THEN 'branches' WHEN id % 3 = 0 AND EXISTS (SELECT 1 FROM entr x WHERE x.stat = 2 AND NOT x.unap
 AND x.src = f.src AND x.seq = f.seq AND x.id <> f.root) THEN 'seq_vio' WHEN id % 3 = 1 AND id = root AND NOT unap THEN 'approved' ELSE 'added' END AS outcome FROM (SELECT *, min(id) OVER (PARTITION BY root) AS first FROM (SELECT l.*, coalesce(p.root, l.id) AS root,
 coalesce(n.n, 1) AS n_paths FROM entr l LEFT JOIN per p ON p.id = l.id LEFT JOIN npr n ON n.root = p.root WHERE NOT EXISTS (SELECT 1 FROM entr c WHERE c.dfrm = l.id)) r) f""",
    ctes=EDIT_POSITIONS,
    recursive=True,
)
def e5(b):
    """One submission per leaf of the edit trees: edits, approvals and rejections."""
    e = _tables(b, "entr")["entr"]
    leaf = e.join(e.where("dfrm IS NOT NULL").select(F.col("dfrm").alias("id")), "id", "left_anti")
    disp = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "r").otherwise("")
    subs = leaf.select(
        F.col("id").alias("sid"), F.col("id").alias("parent"), disp.alias("disp"), F.lit(2).alias("stat"), "src", "seq", (F.col("id") % 2 == 0).alias("editor"),
        F.lit("x").alias("name"), F.lit("y").alias("notes"),
    )
    content = b.tables("rdng", "kanj")
    t = {**_tables(b, "entr", "rdng", "kanj"), "kwsrc": b.kwsrc, "freq": b.freq}
    return submissions.apply_submissions(t, subs, content)[1].select("sid", "outcome")


@query(
    "e9_bulk_edit",
    """SELECT g.entr, g.sens, row_number() OVER (PARTITION BY g.entr, g.sens ORDER BY g.gloss) AS gloss, g.txt FROM (SELECT entr, sens, gloss, txt FROM gloss UNION ALL SELECT entr, 1, 1000, 'added in bulk' FROM sens WHERE sens = 1) g
 WHERE g.entr IN (SELECT id FROM entr WHERE id % 5 = 0) AND EXISTS (SELECT 1 FROM sens s WHERE s.entr = g.entr)""",
)
def e9(b):
    cmds = b.spark.createDataFrame(
        [(0, 1, "add", "gloss", "1", None, "added in bulk"), (0, 2, "add", "comment", None, None, "why")],
        "batch INT, n INT, cmd STRING, operand STRING, place STRING, old STRING, new STRING",
    )
    targets = b.entr.where("id % 5 = 0").select(F.lit(0).alias("batch"), F.lit("id").alias("kind"), F.col("id").alias("num"), "src")
    _, content, _ = bulk.bulk_edit(_tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos"), cmds, targets, _vocab(b))
    return content["gloss"].select("entr", "sens", "gloss", "txt")


@query("e5_rounds", "SELECT 2 * e.id + n AS sid, 'added' AS outcome FROM entr e, (VALUES (0), (1), (2)) t(n) WHERE e.stat = 2 AND e.dfrm IS NULL AND NOT EXISTS (SELECT 1 FROM entr c WHERE c.dfrm = e.id) AND n < 2")
def e5_rounds(b):
    """Two edits of each single entry: the second is settled in a second round."""
    e = _tables(b, "entr")["entr"]
    lone = e.where("stat = 2 AND dfrm IS NULL").join(e.where("dfrm IS NOT NULL").select(F.col("dfrm").alias("id")), "id", "left_anti")
    subs = lone.select(
        F.explode(F.array(2 * F.col("id"), 2 * F.col("id") + 1)).alias("sid"), F.col("id").alias("parent"), F.lit("").alias("disp"), F.lit(2).alias("stat"), "src", "seq",
        F.lit(True).alias("editor"), F.lit("x").alias("name"), F.lit("y").alias("notes"),
    )
    t = {**_tables(b, "entr", "rdng", "kanj"), "kwsrc": b.kwsrc, "freq": b.freq}
    return submissions.apply_in_rounds(t, subs, {})[1].select("sid", "outcome")


@query(
    "e9_two_batches",
    """SELECT g.entr AS sid, g.sens, row_number() OVER (PARTITION BY g.entr, g.sens ORDER BY g.gloss) AS gloss, g.txt, true AS editor, '' AS disp FROM (SELECT entr, sens, gloss, txt FROM gloss
 UNION ALL SELECT entr, 1, 1000, 'of the first' FROM sens WHERE sens = 1 AND entr % 3 = 0 UNION ALL SELECT entr, 1, 1001, 'of the second' FROM sens WHERE sens = 1 AND entr % 2 = 0) g
 WHERE g.entr IN (SELECT id FROM entr WHERE id % 3 = 0 OR id % 2 = 0) AND EXISTS (SELECT 1 FROM sens s WHERE s.entr = g.entr)""",
)
def e9_two(b):
    """Entries named by one batch or by both: one submission each, edits in order."""
    cmds = b.spark.createDataFrame(
        [(0, 1, "add", "gloss", "1", None, "of the first"), (7, 9, "add", "gloss", "1", None, "of the second")],
        "batch INT, n INT, cmd STRING, operand STRING, place STRING, old STRING, new STRING",
    )
    target = lambda batch, step: b.entr.where(f"id % {step} = 0").select(F.lit(batch).alias("batch"), F.lit("id").alias("kind"), F.col("id").alias("num"), "src")
    subs, content, _ = bulk.bulk_edit(_tables(b, "entr", "rdng", "kanj", "sens", "gloss", "pos"), cmds, target(0, 3).unionByName(target(7, 2)), _vocab(b))
    return subs.join(content["gloss"].withColumnRenamed("entr", "sid"), "sid").select("sid", "sens", "gloss", "txt", "editor", "disp")


# --- G1, G2 --------------------------------------------------------------------------

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _stream(b):
    return b.spark.readStream.schema(T._parse_datatype_string(_EVENTS)).option("pathGlobFilter", "events.parquet").parquet(b.sf_dir)


@query("g1_history_calendar_stream", "SELECT year(ts) AS y, month(ts) AS m, day(ts) AS d, count(*) AS cnt FROM events GROUP BY ALL")
def g1(b):
    s = streams.history_calendar_stream(_stream(b), ts="ts")
    return streams.run_to_end(s, scratch_path(b.spark, "g1"), scratch_path(b.spark, "g1-state"), "complete")


@query(
    "g2_idle_sessions_stream",
    """SELECT user_id AS "user", min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 240 MINUTE
 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, sid""",
)
def g2(b):
    ends, out, state = (scratch_path(b.spark, n) for n in ("g2-closing", "g2", "g2-state"))
    s = streams.idle_sessions_stream(_stream(b), closing=streams.closing_rows(b.spark, ends))
    streams.run_to_end(s, out, state)
    out = streams.close_stream(s, ends, out, state)
    return out.withColumns({"first": F.col("first").cast("timestamp_ntz"), "last": F.col("last").cast("timestamp_ntz")})
