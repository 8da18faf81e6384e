"""Tag vocabularies."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import tag_entity
from lexispark.session import path_exists

# Tag domains and whether their files carry entity rules.
DOMAINS = (
    "cinf dial fld freq ginf grp kinf lang misc pos rinf stat srct xref src"
).split()
BASE = "id INT, kw STRING, descr STRING"
SCHEMAS = {
    "src": BASE + ", dt STRING, notes STRING, seq STRING, sinc INT, smin BIGINT, smax BIGINT, srct INT",
    "dial": BASE + ", ents STRING", "fld": BASE + ", ents STRING", "kinf": BASE + ", ents STRING",
    "misc": BASE + ", ents STRING", "pos": BASE + ", ents STRING", "rinf": BASE + ", ents STRING",
}
MAX_TAGS = 20000


def read_tag_tables(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables by domain, domains without a file) from tab-separated, unquoted files.

    Columns are taken by header name, so a file may lack the optional ones.
    """
    out, missing = {}, []
    for dom in DOMAINS:
        path = os.path.join(folder, f"kw{dom}.csv")
        if not path_exists(spark, path):
            missing.append(dom)
            continue
        raw = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
        want = [f.strip().split(" ") for f in SCHEMAS.get(dom, BASE).split(",")]
        cols = [
            F.col(c).cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in want
        ]
        out[dom] = raw.select(*cols)
    return out, missing


def read_conjugation_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The quoted, multi-line conjugation files that are present."""
    schemas = {
        "conj": "id INT, name STRING",
        "conjo": "pos INT, conj INT, neg BOOLEAN, fml BOOLEAN, onum INT, stem INT, okuri STRING, euphr STRING, euphk STRING, pos2 INT",
        "conjo_notes": "pos INT, conj INT, neg BOOLEAN, fml BOOLEAN, onum INT, note INT",
        "conotes": "id INT, txt STRING",
    }
    out = {}
    for name, schema in schemas.items():
        path = os.path.join(folder, f"{name}.csv")
        if path_exists(spark, path):
            reader = spark.read.option("sep", "\t").option("multiLine", True).option("header", True).option("quote", '"')
            out[name] = reader.option("escape", '"').schema(schema).csv(path)
    return out


def tag_ids(kw: DataFrame, dialect: str | None = None) -> dict[str, int]:
    """Name to id of a tag table; with a dialect, by the names its XML uses.

    Tables are fixed vocabularies; one that is not is refused rather than collected.
    """
    if dialect in ("jmdict", "jmnedict") and "ents" in kw.columns:
        ent = tag_entity("ents", "kw", "descr", dialect)
        kw = kw.select("id", ent["name"].alias("kw")).where("kw IS NOT NULL")
    elif dialect == "jmnedict":
        kw = kw.where("false") if "ents" in kw.columns else kw
    rows = kw.select("id", "kw").limit(MAX_TAGS + 1).collect()
    if len(rows) > MAX_TAGS:
        raise ValueError("not a tag vocabulary: too many rows")
    return {r["kw"]: r["id"] for r in rows}


def id_map(ids: dict) -> Column:
    """A literal map column; an empty one for no tags."""
    if not ids:
        return F.create_map().cast("map<string,int>")
    return F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])


def lookup_tags(tags: DataFrame, domains: dict[str, DataFrame], col: str = "tag") -> DataFrame:
    """Every (domain, id, value) a tag text may mean; `ambiguous` when more than one.

    Frequency tags are split into scale and number.  Unknown tags keep nulls.
    """
    alls = None
    for dom, kw in domains.items():
        part = kw.select(F.lit(dom.upper()).alias("domain"), F.col("id").cast("int").alias("id"), F.col("kw").alias("_name"))
        alls = part if alls is None else alls.unionByName(part)
    scale = F.regexp_extract(col, r"^([a-z]+)(\d+)$", 1)
    number = F.regexp_extract(col, r"^([a-z]+)(\d+)$", 2).try_cast("int")
    plain = alls.where("domain <> 'FREQ'")
    distinct = tags.select(col).distinct()
    a = distinct.join(plain, F.col(col) == F.col("_name")).select(col, "domain", "id", F.lit(None).cast("int").alias("value"))
    b = distinct.withColumns({"_s": scale, "value": number}).join(
        alls.where("domain = 'FREQ'"), F.col("_s") == F.col("_name")
    ).select(col, "domain", "id", "value")
    hits = a.unionByName(b)
    n = hits.groupBy(col).agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return tags.join(hits.join(n, col), col, "left")
