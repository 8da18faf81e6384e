"""Audio clips: details and alignment of label intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clip_details(snd: DataFrame, sndfile: DataFrame, sndvol: DataFrame) -> DataFrame:
    """Clips with file, volume and whether the volume is a disc."""
    f = sndfile.select(F.col("id").alias("file"), F.col("loc").alias("sfile"), F.col("vol").alias("sdid"))
    v = sndvol.select(F.col("id").alias("sdid"), F.col("loc").alias("sdir"), (F.col("type") == 2).alias("iscd"))
    return snd.join(f, "file").join(v, "sdid").select("id", "strt", "leng", "sfile", "sdir", "iscd", "sdid", "trns")


def attach_clips(links: DataFrame, details: DataFrame) -> DataFrame:
    """Entry or reading links with their clip as struct `clip`."""
    d = details.select(F.col("id").alias("snd"), F.struct(*details.columns).alias("clip"))
    return links.join(d, "snd", "left").select(*links.columns, "clip")


def align_clips(labels: DataFrame, clips: DataFrame, bin_width: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(labels with their best clip and action, clips no label took).

    `labels`: file, lab, strt, leng, trns; `clips`: file, id, strt, leng, trns.  Score is
    the smaller share of the overlap in either interval; the earliest clip (start, length,
    id) wins ties.  Action is Skip (same interval and text), Update or Add.

    The time axis is cut into bins and intervals meet by an equi-join on (file, bin), so a
    file with many clips is spread; a pair is kept in the bin where the later one starts.
    """
    def binned(df, p):
        stop = F.col("strt") + F.greatest(F.col("leng") - 1, F.lit(0))
        first = F.floor(F.col("strt") / bin_width)
        cols = [F.col(c).alias(f"{p}{c}") for c in df.columns if c != "file"]
        return df.select(
            "file", *cols, first.alias(f"{p}first"),
            F.explode(F.sequence(first, F.floor(stop / bin_width))).alias("_bin"),
        )

    a, b = binned(labels, "a_"), binned(clips, "b_")
    end = lambda p: F.col(f"{p}_strt") + F.col(f"{p}_leng")
    pairs = a.join(b, ["file", "_bin"]).where(F.col("_bin") == F.greatest("a_first", "b_first"))
    over = F.least(end("a"), end("b")) - F.greatest("a_strt", "b_strt")
    pairs = pairs.withColumn("_ov", over).where("_ov > 0")
    score = F.least(F.col("_ov") / F.col("a_leng"), F.col("_ov") / F.col("b_leng"))
    clip = F.struct(*[F.col(f"b_{c}").alias(c) for c in ("id", "strt", "leng", "trns")], score.alias("score"))
    rank = F.struct(score, -F.col("b_strt"), -F.col("b_leng"), -F.col("b_id"))
    best = pairs.groupBy("file", F.col("a_lab").alias("lab")).agg(F.max_by(clip, rank).alias("_c"))
    out = labels.join(best, ["file", "lab"], "left")
    same = (
        (F.col("strt") == F.col("_c.strt")) & (F.col("leng") == F.col("_c.leng"))
        & F.col("trns").eqNullSafe(F.col("_c.trns"))
    )
    action = F.when(F.col("_c").isNull(), "Add").when(same, "Skip").otherwise("Update")
    done = out.select(*labels.columns, F.col("_c.id").alias("clip"), F.col("_c.score").alias("score"), action.alias("action"))
    rest = clips.join(best.select("file", F.col("_c.id").alias("id")), ["file", "id"], "left_anti")
    return done, rest
