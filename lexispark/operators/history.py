"""Questions to the history log, and per-sequence choices that depend on it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BULK_TAG = "-*- bulk -*-"


def history_calendar(hist: DataFrame, year: int) -> DataFrame:
    """History rows per day of a year; the year is a range, so it prunes the scan."""
    lo, hi = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    rows = hist.where((F.col("dt") >= F.lit(lo)) & (F.col("dt") < F.lit(hi)))
    return rows.groupBy(F.year("dt").alias("y"), F.month("dt").alias("m"), F.day("dt").alias("d")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def history_years(hist: DataFrame) -> DataFrame:
    """History rows per year, newest first."""
    return hist.groupBy(F.year("dt").alias("y")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("y"))


def day_updates(
    entr: DataFrame, hist: DataFrame, day: dt.date, back: int = 0, bulk_tag: str = BULK_TAG, half_open: bool = False
) -> DataFrame:
    """Ids of entries changed on a day, other than by bulk edits.

    Both midnights count unless `half_open`; rows without notes do not count.
    """
    start = dt.datetime.combine(day, dt.time()) - dt.timedelta(days=back)
    stop = start + dt.timedelta(days=1)
    t = F.col("dt")
    upper = t < F.lit(stop) if half_open else t <= F.lit(stop)
    hit = hist.where((t >= F.lit(start)) & upper & ~F.col("notes").endswith(bulk_tag))
    return entr.select("id").join(hit.select(F.col("entr").alias("id")), "id", "left_semi")


def _newest(hist: DataFrame) -> DataFrame:
    return hist.groupBy(F.col("entr").alias("id")).agg(F.max("dt").alias("_dt"))


def latest_per_seq(entr: DataFrame, hist: DataFrame) -> DataFrame:
    """The active entry with the newest history per sequence number (all corpora
    together); entries without history come last, ties go to the lower id."""
    e = entr.where("stat = 2").select("id", "seq").join(_newest(hist), "id", "left")
    return e.groupBy("seq").agg(F.max_by("id", F.struct("_dt", -F.col("id"))).alias("id")).select("id", "seq")


def newest_headword_per_seq(
    entr: DataFrame, hist: DataFrame, rdng: DataFrame, kanj: DataFrame
) -> DataFrame:
    """Each entry with first kanji and reading of the newest entry of its (src, seq).

    Newest is the latest last-history time (none counts as oldest), then the larger id.
    """
    last = hist.groupBy(F.col("entr").alias("id")).agg(F.max_by("dt", "hist").alias("_dt"))
    e = entr.select("id", "src", "seq").join(last, "id", "left")
    top = e.groupBy("src", "seq").agg(F.max_by("id", F.struct("_dt", "id")).alias("_top"))
    first = lambda df, o, name: df.groupBy(F.col("entr").alias("_top")).agg(F.min_by("txt", o).alias(name))
    top = top.join(first(kanj, "kanj", "skanj"), "_top", "left").join(first(rdng, "rdng", "srdng"), "_top", "left")
    out = e.join(top, ["src", "seq"])
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("id", "src", "seq", F.col("_dt").alias("last_dt"), empty("skanj"), empty("srdng"))


def display_order(entr: DataFrame, hist: DataFrame, rdng: DataFrame, kanj: DataFrame) -> DataFrame:
    """W2 in display order: headword, corpus, number, newest change first."""
    return newest_headword_per_seq(entr, hist, rdng, kanj).orderBy(
        "skanj", "srdng", "src", "seq", F.desc_nulls_last("last_dt"), F.desc("id")
    )
