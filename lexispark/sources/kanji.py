"""Character dictionary XML to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.languages import language_codes
from lexispark.session import cut
from lexispark.sources.dictionary import _arr, _first_by
from lexispark.sources.records import read_xml_records
from lexispark.sources.tagtables import id_map, tag_ids

_A = lambda *attrs: "ARRAY<STRUCT<_VALUE: STRING, " + ", ".join(f"_{a}: STRING" for a in attrs) + ">>"
CHARACTER_SCHEMA = (
    "literal STRING, "
    f"codepoint STRUCT<cp_value: {_A('cp_type')}>, radical STRUCT<rad_value: {_A('rad_type')}>, "
    f"misc STRUCT<grade: ARRAY<STRING>, stroke_count: ARRAY<STRING>, variant: {_A('var_type')}, freq: ARRAY<STRING>, rad_name: ARRAY<STRING>, jlpt: ARRAY<STRING>>, "
    f"dic_number STRUCT<dic_ref: {_A('dr_type', 'm_vol', 'm_page')}>, query_code STRUCT<q_code: {_A('qc_type', 'skip_misclass')}>, "
    f"reading_meaning ARRAY<STRUCT<rmgroup: ARRAY<STRUCT<reading: {_A('r_type', 'on_type', 'r_status')}, meaning: {_A('m_lang')}>>, nanori: ARRAY<STRING>>>"
)
# Names in the file that differ from the tag names.
NAMES = {
    "rinf": {"nanori": "name", "jy": "jouyou", "ja_kun": "kun", "ja_on": "on", "kan'you": "kanyou"},
    "cinf": {"kanji_in_context": "kanji_in_ctx", "kodansha_compact": "kodansha_comp", "skip_misclass": "skip_mis", "stroke_count": "strokes"},
}
NO_CHARACTER = "\ufffd"  # in the file: what no character of its own stands for
VARIANT_NAMES = {"njecd": "halpern_njecd", "oneill": "oneill_names"}


def read_kanji_xml(
    spark: SparkSession, path: str, kw: dict[str, DataFrame], langs: Sequence[int] | None = None, src: int = 1,
    rename: dict[str, dict[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """S3: tables of a character dictionary.

    `rename` maps, per domain (cinf, rinf, lang), names in the file to tag names; two-letter
    languages are known.  The sequence number is the code point: that of the character, or the
    one given as `ucs` for `NO_CHARACTER`.  Duplicates are dropped; a name reading equal to an earlier reading
    only adds its tag there.
    """
    rename = {**NAMES, "lang": language_codes(spark), **(rename or {})}

    def names(dom: str, extra: dict[str, str] | None = None) -> Column:
        ids = tag_ids(kw[dom])
        alias = {**rename.get(dom, {}), **(extra or {})}
        return id_map({**ids, **{k: ids[v] for k, v in alias.items() if v in ids}})

    cinf_ids, rinf_ids, lang_ids = names("cinf"), names("rinf"), names("lang")
    var_ids = names("cinf", VARIANT_NAMES)
    rec = read_xml_records(spark, path, "character", CHARACTER_SCHEMA)
    e = rec.select("n", "e.*").where("_corrupt IS NULL AND literal IS NOT NULL").withColumn("entr", F.col("n"))
    num = lambda c: F.get(c, F.lit(0)).try_cast("int")
    val = lambda k, v: F.struct(k.cast("int").alias("kw"), v.alias("value"), F.lit(None).cast("string").alias("mctype"))
    cp = F.filter(_arr(F.col("codepoint.cp_value")), lambda x: x["_cp_type"] != "ucs")
    rad = _arr(F.col("radical.rad_value"))
    of = lambda arr, attr, v: F.filter(arr, lambda x: x[attr] == v)
    strokes = _arr(F.col("misc.stroke_count"))
    groups = F.flatten(F.transform(_arr(F.col("reading_meaning")), lambda m: _arr(m["rmgroup"])))
    nanori = F.array_distinct(F.flatten(F.transform(_arr(F.col("reading_meaning")), lambda m: _arr(m["nanori"]))))
    kind = lambda x: F.coalesce(x["_on_type"], x["_r_type"])
    read = lambda g: _arr(g["reading"])
    other = lambda g: _first_by(
        F.filter(read(g), lambda x: kind(x).isin("pinyin", "korean_r", "korean_h", "vietnam")), lambda x: F.struct(kind(x).alias("k"), x["_VALUE"])
    )
    # The tag of an on/kun reading is its last attribute in the file: status, else type.
    tags = lambda x: F.filter(
        F.array(F.try_element_at(rinf_ids, F.coalesce(x["_on_type"], x["_r_type"])), F.try_element_at(rinf_ids, x["_r_status"])), lambda t: t.isNotNull()
    )
    native = lambda g: _first_by(F.filter(read(g), lambda x: F.coalesce(x["_r_type"].isin("ja_on", "ja_kun"), F.lit(False))), lambda x: x["_VALUE"])
    onkun = F.flatten(F.transform(groups, lambda g: F.transform(native(g), lambda x: F.struct(x["_VALUE"].alias("txt"), tags(x).alias("inf")))))
    nan_id = F.try_element_at(rinf_ids, F.lit("nanori"))
    known = F.transform(F.col("_onkun"), lambda r: r["txt"])
    rdng = F.concat(
        F.transform("_onkun", lambda r: F.struct(r["txt"].alias("txt"), F.when(
            F.array_contains(F.col("_nanori"), r["txt"]), F.concat(r["inf"], F.array(nan_id))).otherwise(r["inf"]).alias("inf"))),
        F.transform(F.array_except("_nanori", known), lambda t: F.struct(t.alias("txt"), F.array(nan_id).alias("inf"))),
    )
    lang = lambda x: F.coalesce(x["_m_lang"], F.lit("en"))
    gl = lambda g: F.transform(
        _first_by(_arr(g["meaning"]), lambda x: F.struct(lang(x).alias("l"), x["_VALUE"])),
        lambda x: F.struct(F.try_element_at(lang_ids, lang(x)).alias("lang"), x["_VALUE"].alias("txt")),
    )
    keep = lambda a: F.filter(a, lambda x: x["lang"].isin(list(langs))) if langs else F.filter(a, lambda x: x["lang"].isNotNull())
    volume = lambda x: F.when(x["_m_vol"].isNotNull() & (x["_m_vol"] != ""), F.concat(x["_m_vol"], F.lit("."), x["_m_page"], F.lit("."), x["_VALUE"])).otherwise(x["_VALUE"])
    dic = F.transform(_arr(F.col("dic_number.dic_ref")), lambda x: val(F.try_element_at(cinf_ids, x["_dr_type"]), volume(x)))
    q = F.transform(
        _arr(F.col("query_code.q_code")),
        lambda x: F.struct(F.try_element_at(cinf_ids, x["_qc_type"]).cast("int").alias("kw"), x["_VALUE"].alias("value"), F.coalesce(x["_skip_misclass"], F.lit("")).alias("mctype")),
    )
    once = lambda a: _first_by(F.filter(a, lambda x: x["kw"].isNotNull()), lambda x: F.struct(x["kw"], x["value"]))
    cinf = F.concat(
        F.transform(cp, lambda x: val(F.try_element_at(cinf_ids, x["_cp_type"]), x["_VALUE"])),
        F.transform(of(rad, "_rad_type", "nelson_c"), lambda x: val(F.try_element_at(cinf_ids, F.lit("nelson_rad")), x["_VALUE"])),
        F.transform(F.slice(strokes, F.lit(2), F.greatest(F.size(strokes) - 1, F.lit(0))), lambda x: val(F.try_element_at(cinf_ids, F.lit("strokes")), x)),
        F.flatten(F.transform(groups, lambda g: F.transform(other(g), lambda x: val(F.try_element_at(cinf_ids, kind(x)), x["_VALUE"])))),
        once(dic), once(q),
    )
    krslv = F.transform(_arr(F.col("misc.variant")), lambda x: F.struct(
        F.when(x["_var_type"] == "ucs", F.lit(0)).otherwise(F.try_element_at(var_ids, x["_var_type"])).alias("kw"), x["_VALUE"].alias("value")))
    e = e.withColumns({"_onkun": onkun, "_nanori": nanori, "_cinf": cinf, "_krslv": krslv})
    ucs = F.get(F.transform(of(_arr(F.col("codepoint.cp_value")), "_cp_type", "ucs"), lambda x: x["_VALUE"]), F.lit(0))
    given = F.when((F.col("literal") == NO_CHARACTER) & ucs.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(ucs, 16, 10).cast("bigint"))
    bushu = F.get(F.transform(of(rad, "_rad_type", "classical"), lambda x: x["_VALUE"]), F.lit(0)).try_cast("int")
    e = e.select(
        "entr", "literal", F.coalesce(given, F.ascii("literal").cast("bigint")).alias("seq"), rdng.alias("R"), F.transform(groups, lambda g: keep(gl(g))).alias("S"), F.filter("_cinf", lambda x: x["kw"].isNotNull()).alias("cinf"), "_krslv",
        bushu.alias("bushu"), num(strokes).alias("strokes"), num(F.col("misc.freq")).alias("freq"), num(F.col("misc.grade")).alias("grade"), num(F.col("misc.jlpt")).alias("jlpt"),
        F.nullif(F.array_join(_arr(F.col("misc.rad_name")), "、"), F.lit("")).alias("radname"),
    )
    e = cut(e)
    null = lambda t: F.lit(None).cast(t)
    at = lambda df, arr, key: df.select(*key, F.posexplode(arr).alias("_i", "x")).withColumn("o", (F.col("_i") + 1).cast("int"))
    R = at(e, "R", ["entr"])
    S = at(e, "S", ["entr"])
    return {
        "entr": e.select(
            F.col("entr").alias("id"), F.lit(src).alias("src"), F.lit(2).alias("stat"), "seq", null("bigint").alias("dfrm"),
            F.lit(False).alias("unap"), null("string").alias("srcnote"), null("string").alias("notes"), null("bigint").alias("idx"),
        ),
        "kanj": e.select("entr", F.lit(1).alias("kanj"), F.col("literal").alias("txt")),
        "rdng": R.select("entr", F.col("o").alias("rdng"), "x.txt"),
        "rinf": at(R.select("entr", F.col("o").alias("rdng"), "x.inf"), "inf", ["entr", "rdng"]).select("entr", "rdng", F.col("o").alias("ord"), F.col("x").alias("kw")),
        "sens": S.select("entr", F.col("o").alias("sens"), null("string").alias("notes")),
        "gloss": at(S.select("entr", F.col("o").alias("sens"), F.col("x").alias("g")), "g", ["entr", "sens"]).select(
            "entr", "sens", F.col("o").alias("gloss"), "x.lang", F.lit(1).alias("ginf"), "x.txt"
        ),
        "chr": e.select("entr", F.col("literal").alias("chr"), "bushu", "strokes", "freq", "grade", "jlpt", "radname"),
        "cinf": e.select("entr", F.explode("cinf").alias("x")).select("entr", "x.kw", "x.value", "x.mctype"),
        "krslv": e.select("entr", F.explode("_krslv").alias("x")).select("entr", "x.kw", "x.value"),
    }
