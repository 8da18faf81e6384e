"""Entries as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_VERSION = "1"
# Keys and ordinals that are dropped and derived again from positions.
ORDINALS = {"rdng": "rdng", "kanj": "kanj", "sens": "sens", "gloss": "gloss", "hist": "hist"}


def _without(dtype: T.StructType, drop: set[str]) -> list[str]:
    return [f.name for f in dtype.fields if f.name not in drop]


def entries_to_json(entries: DataFrame) -> DataFrame:
    """(id, json) of assembled entries; names are kept, keys and ordinals are not.

    Array order carries the ordinals, so they cost nothing in the text.
    """
    def strip(c, dtype, own):
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            drop = {own, "ord"} if own in ORDINALS else {"ord"}
            keep = _without(dtype.elementType, drop)
            return F.transform(c, lambda x: F.struct(*[strip(x[k], dtype.elementType[k].dataType, k).alias(k) for k in keep]))
        return c

    body = [strip(F.col(f.name), f.dataType, f.name).alias(f.name) for f in entries.schema.fields if f.name != "id"]
    return entries.select("id", F.to_json(F.struct(F.lit(JSON_VERSION).alias("ver"), *body)).alias("json"))


def json_schema(entries_schema: T.StructType) -> T.StructType:
    """Schema of the JSON of entries with a given assembled schema."""
    def strip(dtype, own):
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            drop = {own, "ord"} if own in ORDINALS else {"ord"}
            return T.ArrayType(T.StructType([T.StructField(f.name, strip(f.dataType, f.name)) for f in dtype.elementType.fields if f.name not in drop]))
        return dtype

    return T.StructType([T.StructField("ver", T.StringType())] + [T.StructField(f.name, strip(f.dataType, f.name)) for f in entries_schema.fields if f.name != "id"])


def entries_from_json(rows: DataFrame, entries_schema: T.StructType, col: str = "json") -> DataFrame:
    """S11 back: assembled entries; ordinals are positions again (W4 inside the row)."""
    parsed = rows.select("id", F.from_json(col, json_schema(entries_schema)).alias("j"))

    def restore(c, dtype, own):
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            el = dtype.elementType

            def one(x, i):
                cols = []
                for f in el.fields:
                    if f.name == "ord" or (own in ORDINALS and f.name == own):
                        cols.append((i + 1).cast(f.dataType).alias(f.name))
                    else:
                        cols.append(restore(x[f.name], f.dataType, f.name).alias(f.name))
                return F.struct(*cols)

            return F.transform(c, one)
        return c

    return parsed.select("id", *[restore(F.col(f"j.{f.name}"), f.dataType, f.name).alias(f.name) for f in entries_schema.fields if f.name != "id"])
