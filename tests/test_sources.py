"""Readers and writers on small files."""

import pytest
from compared_rows import tuples

from lexispark.plans import catalog_io  # noqa: F401  (registers its queries)
from lexispark.plans.bridge import Bridge
from lexispark.plans.catalog import QUERIES
from lexispark.sources import clipfiles, edict, edict_out, importer, json_entries, kanji, sentences, tables as store, tagtables
from lexispark.sources.dictionary import read_dictionary_xml, read_wanted, extract_by_seq, sniff_xml_type, xml_created
from lexispark.sources.dictionary_out import entry_xml, ignored_tags, write_dictionary_xml
from lexispark.operators.assemble import assemble_entries

JM = """<?xml version="1.0"?>
<!DOCTYPE JMdict [ <!ENTITY n "noun"> ]>
<!-- JMdict created: 2014-01-02 -->
<JMdict>
<entry><ent_seq>10</ent_seq><k_ele><keb>食べる</keb><ke_inf>&ateji;</ke_inf><ke_pri>ichi1</ke_pri><ke_pri>nf02</ke_pri></k_ele><k_ele><keb>喰べる</keb></k_ele><k_ele><keb>喰べる</keb></k_ele>
<r_ele><reb>たべる</reb><re_restr>食べる</re_restr><re_pri>spec1</re_pri></r_ele><r_ele><reb>タベル</reb><re_nokanji/></r_ele>
<sense><stagk>食べる</stagk><pos>&v1;</pos><pos>&bogus;</pos><xref>飲む・のむ・2</xref><ant>吐く</ant><field>&comp;</field><misc>&uk;</misc><s_inf>a &amp; b</s_inf>
<lsource xml:lang="fre" ls_wasei="y">manger</lsource><gloss>to eat</gloss><gloss>to eat</gloss><gloss xml:lang="ger">essen</gloss><gloss g_type="lit">lit one</gloss></sense>
<sense><pos>&v1;</pos><gloss>to live on &lt;x&gt;</gloss></sense></entry>
<entry><ent_seq>x</ent_seq></entry>
<entry><r_ele><reb>あ</reb></r_ele><sense><gloss>ah</gloss></sense></entry>
</JMdict>"""


@pytest.fixture(scope="module")
def jm(spark, kw, tmp_path_factory):
    p = tmp_path_factory.mktemp("jm") / "in.xml"
    p.write_text(JM, encoding="utf-8")
    assert sniff_xml_type(spark, str(p)) == "jmdict"
    assert [(r.name, str(r.created)) for r in xml_created(spark, str(p)).collect()] == [("JMdict", "2014-01-02")]
    return read_dictionary_xml(spark, str(p), "jmdict", kw, seq_init=1000, seq_incr=10)


def test_dictionary_tables(jm):
    assert tuples(jm["entr"], "id", "seq", "stat", "unap") == [(1, 10, 2, False), (3, 1020, 2, False)]
    assert tuples(jm["kanj"]) == [(1, 1, "食べる"), (1, 2, "喰べる")]
    assert tuples(jm["restr"]) == [(1, 1, 2), (1, 2, 1), (1, 2, 2)]
    assert tuples(jm["stagk"]) == [(1, 1, 2)]
    assert tuples(jm["gloss"], "entr", "sens", "gloss", "lang", "ginf", "txt") == [
        (1, 1, 1, 1, 1, "to eat"), (1, 1, 2, 150, 1, "essen"), (1, 1, 3, 1, 2, "lit one"), (1, 2, 1, 1, 1, "to live on <x>"), (3, 1, 1, 1, 1, "ah")]
    assert tuples(jm["lsrc"], "lang", "txt", "part", "wasei") == [(137, "manger", False, True)]
    assert tuples(jm["freq"]) == [(1, 1, None, 4, 1), (1, None, 1, 1, 1), (1, None, 1, 5, 2)]
    assert tuples(jm["xresolv"], "ord", "typ", "rtxt", "ktxt", "tsens") == [(1, 3, "のむ", "飲む", 2), (2, 2, None, "吐く", None)]
    codes = {r.code for r in jm["warnings"].collect()}
    assert {"duplicate_keb", "duplicate_gloss", "unknown_pos", "bad_sequence"} <= codes


def test_dictionary_xml_out(spark, jm, kw, tmp_path):
    kws = dict(kw, src=jm["kwsrc"], grp=jm["kwgrp"])
    xml = {r.id: r.xml for r in entry_xml(jm, kws, "jmdict").collect()}
    assert xml[3] == "<entry>\n<ent_seq>1020</ent_seq>\n<r_ele>\n<reb>あ</reb>\n</r_ele>\n<sense>\n<gloss>ah</gloss>\n</sense>\n</entry>"
    for part in ("<re_nokanji/>", "<re_restr>食べる</re_restr>", "<pos>&v1;</pos>\n<xref>飲む・のむ・2</xref>\n<ant>吐く</ant>\n<field>&comp;</field>",
                 "<s_inf>a &amp; b</s_inf>", '<lsource xml:lang="fre" ls_wasei="y">manger</lsource>', '<gloss xml:lang="ger">essen</gloss>', "to live on &lt;x&gt;"):
        assert part in xml[1]
    assert tuples(ignored_tags(jm, kw, "jmnedict"), "domain", "tag") == [("FLD", "comp"), ("KINF", "ateji"), ("MISC", "uk"), ("POS", "v1")]
    write_dictionary_xml(jm, kws, str(tmp_path / "out"), "jmdict")
    again = read_dictionary_xml(spark, str(tmp_path / "out"), "jmdict", kw)
    for name in ("kanj", "rdng", "gloss", "pos", "restr", "xresolv"):
        plain = lambda t: sorted(str(tuple(r)[1:]) for r in t[name].collect())
        assert plain(jm) == plain(again), name


def test_lines(spark, jm, kw, rows):
    got = {r.id: r.line for r in edict_out.edict_lines(jm, kw).collect()}
    assert got == {
        1: "食べる(ateji)(P);喰べる [たべる(食べる)(P);タベル] /(v1) ( 食べる only) (uk) {comp} (a & b) to eat/essen (lit: lit one)/(2) to live on <x>/(P)/", 3: "あ /ah/"}
    lines = [
        ("明かん [あかん] /(int,n) (uk) (ksb:) useless/no good/EntL1000230/",), ("ギャロップ;ガロップ /(n) (1) (ギャロップ only) gallop/(2) galop (dance)/EntL1043140X/",),
        ("うな丼;鰻丼 [うなどん(うな丼);うなぎ(ik)] /(n) (See エアロ・2,願わ) (dead) bowl (lit: a (b) c)/(P)/",), ("駆(P) [かけ] /(n) ice (eng: ice, ger: Eis)/lit: rush/(P)/",), ("abc [か] /x/",), ("か",),
        ("漢 [か] /(n) (2) x/",), ("夕べ [ゆうべ] /(1) one1/(2) two2/two3/(3) three (to go)/",),
    ]
    r = edict.parse_lines(rows("value STRING", *lines), kw).select("value", "seq", "K", "R", "S", "errors").collect()
    errors = [list(x.errors) for x in r]
    assert errors == [[], [], ["p_only_in_sense"], [], ["kanji_not_kanji"], ["no_separator"], ["sense_number_out_of_order"], []]
    a = r[0].S[0]
    assert r[0].seq == 1000230 and (a.pos, a.misc, a.dial) == ([14, 17], [22], [2])
    assert [(s.pos, s.stagr, [g.txt for g in s.gloss]) for s in r[1].S] == [([17], [2], ["gallop"]), ([17], [], ["galop (dance)"])]
    c = r[2].S[0]
    assert [(g.ginf, g.txt) for g in c.gloss] == [(1, "(dead) bowl"), (2, "a (b) c")]
    assert [(x.typ, x.p.ktxt, x.p.rtxt, x.p.tsens) for x in c.xresolv] == [(3, None, "エアロ", 2), (3, "願わ", None, None)]
    assert r[2].R[0].restr == [2] and r[2].R[1].inf == [3]
    d = r[3]
    assert [(f.kw, f.value) for f in d.K[0].freq] == [(4, 1)] and d.R[0].freq == []
    assert [(x.lang, x.txt) for x in d.S[0].lsrc] == [(1, "ice"), (150, "Eis")] and [(g.ginf, g.txt) for g in d.S[0].gloss] == [(1, "ice"), (2, "rush")]
    assert [[g.txt for g in s.gloss] for s in r[7].S] == [["one1"], ["two2", "two3"], ["three (to go)"]]


def test_sentences(spark, tmp_path):
    f = tmp_path / "ex.txt"
    f.write_text(
        "junk\nA: 彼は食べる。\tHe eats.#ID=1_2\nB: 彼(かれ)[01]{彼} は 食べる{たべた} 食べる[1][2]~\nA: すし\tsushi#ID=4_3\nA: skipped\nB: すし\nB: extra\n"
        "A: すし2\tagain#ID=4_3\nB: すし\nA: no id\tx\nB: すし\nA: last\tone#ID=9_9\n", encoding="utf-8")
    t = sentences.read_sentence_pairs(spark, str(f))
    assert tuples(t["entr"], "id", "seq", "srcnote") == [(1, 4, "2"), (2, 11, "4")]
    assert tuples(t["rdng"]) == [(2, 1, "すし")] and tuples(t["gloss"], "txt") == [("He eats.",), ("sushi",)]
    assert tuples(t["xresolv"], "entr", "ord", "rtxt", "ktxt", "tsens", "notes", "prio") == [
        (1, 1, "かれ", "彼", 1, "彼", False), (1, 2, "は", None, None, None, False), (1, 3, None, "食べる", 2, None, True), (2, 1, "すし", None, None, None, False)]
    assert [r.code for r in t["warnings"].orderBy("a_n", "code").collect()] == ["form_not_in_sentence", "duplicate", "no_id"]


def test_characters(spark, kw, tmp_path):
    f = tmp_path / "k.xml"
    f.write_text(
        '<kanjidic2><character><literal>亜</literal><codepoint><cp_value cp_type="ucs">4e9c</cp_value><cp_value cp_type="jis208">16-01</cp_value></codepoint>'
        '<radical><rad_value rad_type="classical">7</rad_value><rad_value rad_type="nelson_c">1</rad_value></radical><misc><grade>8</grade><stroke_count>7</stroke_count>'
        '<stroke_count>8</stroke_count><variant var_type="jis208">48-19</variant><variant var_type="ucs">4e9e</variant><freq>1509</freq><rad_name>x</rad_name><rad_name>y</rad_name></misc>'
        '<dic_number><dic_ref dr_type="nelson_c">43</dic_ref><dic_ref dr_type="moro" m_vol="1" m_page="0525">272</dic_ref><dic_ref dr_type="nelson_c">43</dic_ref></dic_number>'
        '<query_code><q_code qc_type="skip">4-7-1</q_code><q_code qc_type="skip" skip_misclass="posn">4-7-2</q_code></query_code><reading_meaning><rmgroup><reading r_type="pinyin">ya4</reading>'
        '<reading r_type="ja_on">ア</reading><reading r_type="ja_kun">つ.ぐ</reading><meaning>Asia</meaning><meaning m_lang="fr">Asie</meaning><meaning>Asia</meaning></rmgroup>'
        "<nanori>や</nanori><nanori>ア</nanori></reading_meaning></character></kanjidic2>", encoding="utf-8")
    t = kanji.read_kanji_xml(spark, str(f), kw)
    assert tuples(t["entr"], "seq") == [(20124,)]
    assert tuples(t["chr"], "bushu", "strokes", "freq", "grade", "jlpt", "radname") == [(7, 7, 1509, 8, None, "x、y")]
    assert tuples(t["rinf"], "rdng", "ord", "kw") == [(1, 1, 128), (1, 2, 103), (2, 1, 106), (3, 1, 103)]
    assert tuples(t["gloss"], "lang", "txt") == [(1, "Asia"), (137, "Asie")]
    assert tuples(t["cinf"], "kw", "value", "mctype") == [
        (1, "43", None), (18, "4-7-1", ""), (18, "4-7-2", "posn"), (23, "ya4", None), (24, "8", None), (25, "16-01", None), (32, "1", None), (9, "1.0525.272", None)]
    assert tuples(t["krslv"], "kw", "value") == [(0, "4e9e"), (25, "48-19")]


def test_code_points_without_character(spark, kw, tmp_path):
    one = lambda ch, ucs: f'<character><literal>{ch}</literal><codepoint><cp_value cp_type="ucs">{ucs}</cp_value></codepoint></character>'
    f = tmp_path / "k.xml"
    f.write_text("<kanjidic2>" + one("\ufffd", "112345") + one("\ufffd", "x") + one("亜", "1") + "</kanjidic2>", encoding="utf-8")
    assert tuples(kanji.read_kanji_xml(spark, str(f), kw)["entr"], "seq") == sorted([(0x4E9C,), (0xFFFD,), (0x112345,)], key=str)


def test_parts_beyond_unicode(spark, tmp_path):
    bridge = Bridge(spark, str(tmp_path))
    keys = [1, 19999, 20000, 1003039, 1003040, 1200000]  # the fourth is the last of Unicode
    spark.createDataFrame([(k, "n", "B#1", "T", 6) for k in keys], "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT").write.parquet(f"{tmp_path}/part.parquet")
    for name, schema in {"customer": "c_mktsegment STRING", "region": "r_regionkey INT, r_name STRING", "nation": "n_nationkey INT, n_name STRING"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = tuples(QUERIES["s3_kanji_chr"][0](bridge), "seq", "strokes", "grade", "n_rdng", "n_cinf")
    assert got == sorted([(k + (19968 if k < 20000 else 111072), 6, 6, 1, 2) for k in keys], key=str)


def test_extract_and_tags(spark, tmp_path, kw, rows):
    f = tmp_path / "d.xml"
    f.write_text("<JMdict>\n" + "".join(f"<entry>\n<ent_seq>{i}</ent_seq>\n</entry>\n" for i in (5, 7, 9, 11)) + "</JMdict>\n")
    w = tmp_path / "w.txt"
    w.write_text("# wanted\n5,2\n7 1 # dup\n99\n")
    hit, missing = extract_by_seq(spark, str(f), read_wanted(spark, str(w)))
    assert tuples(hit, "seq") == [(5,), (7,)] and tuples(missing) == [(99,)]
    d = tmp_path / "kw"
    d.mkdir()
    (d / "kwpos.csv").write_text('id\tkw\tdescr\tents\n1\tadj-i\t"adj (keiyoushi)\t\n2\tn\tnoun\t{"jmnedict":1}\n')
    (d / "kwstat.csv").write_text("id\tkw\tdescr\n2\tA\tActive\n")
    t, missing = tagtables.read_tag_tables(spark, str(d))
    assert tuples(t["pos"]) == [(1, "adj-i", '"adj (keiyoushi)', None), (2, "n", "noun", '{"jmnedict":1}')] and "dial" in missing and "stat" not in missing
    look = tagtables.lookup_tags(rows("tag STRING", ("n",), ("nf12",), ("zz",)), {"pos": t["pos"], "misc": rows("id INT, kw STRING", (4, "n")), "freq": kw["freq"]})
    assert tuples(look, "tag", "domain", "id", "value", "ambiguous") == [("n", "MISC", 4, None, True), ("n", "POS", 2, None, True), ("nf12", "FREQ", 5, 12, False), ("zz", None, None, None, None)]


def test_import(rows):
    e = "id BIGINT, src INT, stat INT, seq BIGINT, dfrm BIGINT, unap BOOLEAN, idx BIGINT"
    base = {"kwsrc": rows("id INT, kw STRING", (98, "a"), (99, "test")), "entr": rows(e, (40, 98, 2, 1, None, False, None)), "rdng": rows("entr BIGINT, rdng INT, txt STRING")}
    stage = {"kwsrc": rows("id INT, kw STRING", (1, "b"), (2, "a")), "entr": rows(e, (1, 1, 2, 1, None, False, 71), (2, 2, 2, 1, 71, True, 72)), "rdng": rows("entr BIGINT, rdng INT, txt STRING", (2, 1, "x"))}
    with pytest.raises(importer.ImportRefused):
        importer.import_corpus(stage, base)
    out = importer.import_corpus(stage, base, {"a": "c"})
    assert tuples(out["entr"], "id", "src", "dfrm") == [(40, 98, None), (41, 100, None), (42, 101, 41)]
    assert tuples(out["kwsrc"]) == [(100, "b"), (101, "c"), (98, "a"), (99, "test")] and tuples(out["rdng"]) == [(42, 1, "x")]
    stage["entr"] = rows(e, (1, 1, 2, 1, 5, True, 71))
    with pytest.raises(importer.ImportRefused):
        importer.import_corpus(stage, base, {"a": "c"})


def test_copy_json_clips(spark, rows, tmp_path):
    df = rows("id BIGINT, ok BOOLEAN, txt STRING", (1, True, "a\tb\\n\nc\r"), (2, None, None))
    store.copy_rows(df).write.text(str(tmp_path / "copy"))
    back = store.read_copy_rows(spark.read.text(str(tmp_path / "copy")), "id BIGINT, ok BOOLEAN, txt STRING")
    assert tuples(back) == [(1, True, "a\tb\\n\nc"), (2, None, None)]
    t = {"entr": rows("id BIGINT, seq BIGINT", (1, 9)), "rdng": rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "a"), (1, 2, "b")),
         "rinf": rows("entr BIGINT, rdng INT, ord INT, kw INT", (1, 2, 1, 7), (1, 2, 2, 3), (1, 9, 1, 1)), "sens": rows("entr BIGINT, sens INT, notes STRING", (1, 1, None))}
    e = assemble_entries(t)
    assert [(r.rdng, [(i.ord, i.kw) for i in r.rinf]) for r in e.first().rdng] == [(1, []), (2, [(1, 7), (2, 3)])]
    assert json_entries.entries_from_json(json_entries.entries_to_json(e), e.schema).collect() == e.collect()
    clip = {"sndvol": rows("id BIGINT, loc STRING, type INT", (3, "v&1", 2)), "sndfile": rows("id BIGINT, vol BIGINT, loc STRING", (4, 3, "f")),
            "snd": rows("id BIGINT, file BIGINT, strt BIGINT, leng BIGINT, trns STRING", (5, 4, 29, 100, "か"))}
    clipfiles.write_clips_xml(clip, str(tmp_path / "clips"))
    again = clipfiles.read_clips_xml(spark, str(tmp_path / "clips"))
    assert tuples(again["snd"], "id", "file", "strt", "leng", "trns") == [(5, 4, 29, 100, "か")] and tuples(again["sndvol"], "id", "loc", "type") == [(3, "v&1", 2)]
    (tmp_path / "lab.txt").write_text("0.29\t1.5\tone \n", encoding="utf-8")
    assert tuples(clipfiles.read_labels(spark, str(tmp_path / "lab.txt"))) == [(28, 122, "one")]
