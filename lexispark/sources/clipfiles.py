"""Audio clip XML and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.dictionary_out import esc
from lexispark.sources.records import read_xml_records

# Element, its id prefixes, and (column, element) in file order.
CLIP_ELEMENTS = {
    "sndvol": ("avol", {"id": ("_id", "v")}, [("loc", "av_loc"), ("type", "av_type"), ("title", "av_title"), ("idstr", "av_idstr"), ("corp", "av_corpus"), ("notes", "av_notes")]),
    "sndfile": ("asel", {"id": ("_id", "s"), "vol": ("_vol", "v")}, [("loc", "as_loc"), ("type", "as_type"), ("title", "as_title"), ("notes", "as_notes")]),
    "snd": ("aclip", {"id": ("_id", "c"), "file": ("_sel", "s")}, [("strt", "ac_strt"), ("leng", "ac_leng"), ("trns", "ac_trns"), ("notes", "ac_notes")]),
}
NUMBERS = {"strt", "leng", "type"}


def read_clips_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sndvol, sndfile and snd rows of a clip file."""
    out = {}
    for table, (tag, keys, cells) in CLIP_ELEMENTS.items():
        schema = ", ".join([f"{a} STRING" for a, _ in keys.values()] + [f"{el} STRING" for _, el in cells])
        e = read_xml_records(spark, path, tag, schema).select("e.*")
        key = lambda a: F.substring(a, 2, 20).cast("bigint")
        out[table] = e.select(
            *[key(a).alias(c) for c, (a, _) in keys.items()],
            *[(F.col(el).try_cast("bigint") if c in NUMBERS else F.col(el)).alias(c) for c, el in cells],
        )
    return out


def write_clips_xml(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """S12 back: volumes, files, clips in id order; empty and zero cells are left out."""
    out = None
    for i, (table, (tag, keys, cells)) in enumerate(CLIP_ELEMENTS.items()):
        df = tables[table]
        attrs = [F.concat(F.lit(f' {a[1:]}="{p}'), F.col(c).cast("string"), F.lit('"')) for c, (a, p) in keys.items()]
        text = lambda c: F.col(c).cast("string")
        body = [
            F.when(F.coalesce(text(c), F.lit("")).isin("", "0"), None).otherwise(F.concat(F.lit(f"<{el}>"), esc(text(c)), F.lit(f"</{el}>")))
            for c, el in cells if c in df.columns
        ]
        xml = F.concat_ws("\n", F.concat(F.lit(f"<{tag}"), *attrs, F.lit(">")), *body, F.lit(f"</{tag}>"))
        part = df.select(F.lit(i).alias("_k"), F.col("id").cast("bigint").alias("id"), xml.alias("value"))
        out = part if out is None else out.unionByName(part)
    out.repartitionByRange("_k", "id").sortWithinPartitions("_k", "id").select("value").write.mode(mode).text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(strt, leng, trns) in hundredths of a second, cut off and not rounded."""
    units = lambda c: F.floor(F.col(c).cast("double") * 100).cast("bigint")
    raw = spark.read.option("sep", "\t").option("quote", "").schema("a STRING, b STRING, trns STRING").csv(path)
    raw = raw.withColumn("a", F.regexp_replace("a", "^﻿", ""))
    return raw.select(units("a").alias("strt"), (units("b") - units("a")).alias("leng"), F.trim("trns").alias("trns"))


def write_labels(clips: DataFrame, path: str, mode: str = "error") -> None:
    """S13 back: start, end in seconds and text, in time order."""
    sec = lambda c: F.format_string("%.6f", c / 100)
    rows = clips.repartitionByRange("strt", "leng").sortWithinPartitions("strt", "leng")
    rows.select(F.concat_ws("\t", sec(F.col("strt")), sec(F.col("strt") + F.col("leng")), F.coalesce("trns", F.lit(""))).alias("value")).write.mode(mode).text(path)
