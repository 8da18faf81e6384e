"""Merging a staged corpus into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.edits import CHILD_TABLES
from lexispark.operators.skew import spread_row_number

TEST_CORPUS = 99  # Fixed value: id reserved for test data.


class ImportRefused(ValueError):
    pass


def import_corpus(
    stage: dict[str, DataFrame], base: dict[str, DataFrame], rename: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Base tables with the staged ones added under new ids.

    Corpora get ids after the largest one (99 is passed over); entry ids move up by the
    largest entry id; `dfrm`, which names staged entries by `idx`, is turned into ids.
    Refused when a corpus name exists already or a parent is not among the staged rows.
    Ids are shifted by a constant, so no staged table is shuffled except for `dfrm`.
    """
    names = stage["kwsrc"]
    if rename:
        new = names["kw"]
        for old, to in rename.items():
            new = F.when(names["kw"] == old, to).otherwise(new)
        names = names.withColumn("kw", new)
    clash = names.join(base["kwsrc"].select("kw"), "kw", "left_semi").select("kw")
    if found := clash.count():
        raise ImportRefused(f"{found} corpus names exist already, the first of them {clash.agg(F.min('kw')).first()[0]}")
    top_src = base["kwsrc"].where(F.col("id") != TEST_CORPUS).agg(F.max("id").alias("m")).first()["m"] or 0
    raw = F.col("_n") + top_src
    past = F.when(raw >= TEST_CORPUS, 1).otherwise(0) if top_src < TEST_CORPUS else F.lit(0)
    m = spread_row_number(names.select(F.col("id").cast("int").alias("src")), [], [F.col("src")], "_n").select("src", (raw + past).cast("int").alias("newid"))
    top = base["entr"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    e = stage["entr"]
    lost = e.where("dfrm IS NOT NULL").join(e.select(F.col("idx").alias("dfrm")), "dfrm", "left_anti").select("dfrm")
    if found := lost.count():
        raise ImportRefused(f"{found} parents are missing from the file, the first of them {lost.agg(F.min('dfrm')).first()[0]}")
    parent = e.where("idx IS NOT NULL").select(F.col("idx").alias("dfrm"), F.col("id").alias("_p"))
    # Most entries have no parent; they stay out of the join, where they would be one key.
    edited = e.where("dfrm IS NOT NULL").join(parent, "dfrm")
    moved = edited.unionByName(e.where("dfrm IS NULL").withColumn("_p", F.lit(None).cast("bigint")))
    moved = moved.withColumn("src", F.col("src").cast("int")).join(m, "src")
    moved = moved.withColumns({"id": F.col("id") + top, "src": F.col("newid"), "dfrm": F.col("_p") + top})
    out = dict(base)

    def add(name: str, df: DataFrame) -> None:
        out[name] = base[name].unionByName(df, allowMissingColumns=True) if name in base else df

    add("entr", moved.select(*e.columns))
    srcs = names.withColumnRenamed("id", "src").join(m, "src").withColumn("id", F.col("newid")).drop("src", "newid")
    add("kwsrc", srcs.select(*[c for c in names.columns]))
    for name in CHILD_TABLES:
        if name in stage:
            df = stage[name].withColumn("entr", F.col("entr") + top)
            if name == "xref":
                df = df.withColumn("xentr", F.col("xentr") + top)
            if name == "hist" and "eid" in df.columns:
                df = df.withColumn("eid", F.col("eid") + top)
            add(name, df)
    return out
