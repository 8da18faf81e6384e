"""Lexical tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables in the order their foreign keys need.
TABLE_ORDER = (
    "kwsrc kwgrp entr kanj kinf rdng rinf sens gloss misc pos fld dial lsrc restr stagr stagk freq hist xref xresolv "
    "grp chr cinf krslv sndvol sndfile snd entrsnd rdngsnd"
).split()


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "error") -> list[str]:
    """One parquet folder per table; entries are partitioned by corpus.

    Returns the tables written, parents before children.
    """
    done = []
    for name in [t for t in TABLE_ORDER if t in tables] + [t for t in tables if t not in TABLE_ORDER]:
        writer = tables[name].write.mode(mode)
        if name == "entr":
            writer = writer.partitionBy("src")
        writer.parquet(f"{path}/{name}")
        done.append(name)
    return done


def read_tables(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def copy_rows(df: DataFrame) -> DataFrame:
    """Rows as text of the bulk-load form: tabs between cells, `\\N` for null, escapes for
    backslash, tab and newline; carriage returns are dropped."""
    def cell(field):
        c = F.col(field.name)
        if field.dataType.simpleString() == "boolean":
            c = F.when(c, "t").otherwise(F.when(c.isNotNull(), "f"))
        c = c.cast("string")
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.coalesce(c, F.lit("\\N"))

    return df.select(F.concat_ws("\t", *[cell(f) for f in df.schema.fields]).alias("value"))


def write_copy_files(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """The text form of `copy_rows`, one folder per table."""
    for name in [t for t in TABLE_ORDER if t in tables]:
        copy_rows(tables[name]).write.mode(mode).text(f"{path}/{name}")


def read_copy_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of `schema` from text in the bulk-load form."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    cells = F.split("value", "\t", -1)
    cols = []
    for i, (name, typ) in enumerate(fields):
        c = F.nullif(F.get(cells, F.lit(i)), F.lit("\\N"))
        # Between doubled backslashes only the other escapes are left to undo.
        plain = lambda x: F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
        c = F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")
        if typ.lower() == "boolean":
            c = F.when(c.isin("t", "true", "True"), True).otherwise(F.when(c.isNotNull(), False))
        cols.append(c.cast(typ).alias(name))
    return lines.select(*cols)
