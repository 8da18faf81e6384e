"""Which readings, written forms and senses go together (deny lists)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def valid_pairs(
    left: DataFrame, right: DataFrame, deny: DataFrame, left_ord: str, right_ord: str, key: str = "entr"
) -> DataFrame:
    """Pairs of two child tables within an entry, minus denied ordinals.

    Text columns `txt` come out as `ltxt` / `rtxt`; senses have none.
    """
    keep = lambda df, o, t: df.select(key, o, *([F.col("txt").alias(t)] if "txt" in df.columns else []))
    pairs = keep(left, left_ord, "ltxt").join(keep(right, right_ord, "rtxt"), key)
    return pairs.join(deny.select(key, left_ord, right_ord), [key, left_ord, right_ord], "left_anti")


def pair_validity(entr: DataFrame, rdng: DataFrame, kanj: DataFrame, restr: DataFrame) -> DataFrame:
    """Every reading/kanji combination (missing sides kept), 'X' when denied."""
    r = rdng.select(F.col("entr").alias("id"), "rdng", F.col("txt").alias("rtxt"))
    k = kanj.select(F.col("entr").alias("id"), "kanj", F.col("txt").alias("ktxt"))
    z = restr.select(F.col("entr").alias("id"), "rdng", "kanj", F.lit("X").alias("valid"))
    return (
        entr.select("id", "seq").join(r, "id", "left").join(k, "id", "left").join(z, ["id", "rdng", "kanj"], "left")
    ).select("id", "seq", "rdng", "rtxt", "kanj", "ktxt", "valid")


def lowest_allowed(items: DataFrame, sens: DataFrame, deny: DataFrame, ordinal: str) -> DataFrame:
    """Lowest ordinal per sense that its deny rows leave, without forming the pairs.

    Items and deny rows are ranked separately; as long as the n-th deny row names the
    n-th item, the first n items are denied, so the answer is item n + 1.
    """
    ranked = items.select(
        "entr", ordinal, F.row_number().over(W.partitionBy("entr").orderBy(ordinal)).alias("_rank")
    )
    hits = deny.select("entr", "sens", ordinal).distinct().join(ranked, ["entr", ordinal])
    nth = F.row_number().over(W.partitionBy("entr", "sens").orderBy(ordinal))
    prefix = (
        hits.withColumn("_n", nth)
        .groupBy("entr", "sens")
        .agg((F.sum(F.when(F.col("_n") == F.col("_rank"), 1).otherwise(0)) + 1).cast("int").alias("_rank"))
    )
    want = sens.select("entr", "sens").join(prefix, ["entr", "sens"], "left")
    want = want.withColumn("_rank", F.coalesce("_rank", F.lit(1)))
    return want.join(ranked, ["entr", "_rank"]).select("entr", "sens", ordinal)


def xref_headwords(
    sens: DataFrame, rdng: DataFrame, kanj: DataFrame, stagr: DataFrame, stagk: DataFrame
) -> DataFrame:
    """Per sense its lowest allowed reading and, when there is one, kanji."""
    rm = lowest_allowed(rdng, sens, stagr, "rdng")
    km = lowest_allowed(kanj, sens, stagk, "kanj")
    return (
        rm.join(km, ["entr", "sens"], "left")
        .join(rdng.select("entr", "rdng", F.col("txt").alias("rtxt")), ["entr", "rdng"])
        .join(kanj.select("entr", "kanj", F.col("txt").alias("ktxt")), ["entr", "kanj"], "left")
        .select("entr", "sens", "rtxt", "kanj", "ktxt")
    )


def reading_kanji_allowed(
    entr: DataFrame, rdng: DataFrame, kanj: DataFrame, restr: DataFrame, sens: DataFrame
) -> DataFrame:
    """Each reading with each allowed kanji, or a null kanji when none; sense count.

    A reading whose kanji are all denied has no pair in the view this mirrors, so it
    gets the null kanji too.
    """
    rk = valid_pairs(rdng, kanj, restr, "rdng", "kanj").select(
        "entr", "rdng", "kanj", F.col("rtxt").alias("ktxt")
    )
    ns = sens.groupBy("entr").agg(F.count(F.lit(1)).alias("nsens"))
    r = rdng.select("entr", "rdng", F.col("txt").alias("rtxt"))
    head = entr.select(F.col("id").alias("entr"), "src", "stat", "unap")
    return (
        head.join(r, "entr")
        .join(rk, ["entr", "rdng"], "left")
        .join(ns, "entr", "left")
        .select(
            F.col("entr").alias("id"), "src", "stat", "unap", "rdng", "rtxt", "kanj", "ktxt",
            F.coalesce("nsens", F.lit(0)).cast("bigint").alias("nsens"),
        )
    )


def no_kanji_readings(entr: DataFrame, rdng: DataFrame, kanj: DataFrame, restr: DataFrame) -> DataFrame:
    """A4: readings with as many deny rows as the entry has kanji."""
    nk = kanj.groupBy("entr").agg(F.count(F.lit(1)).alias("_nk"))
    nd = restr.groupBy("entr", "rdng").agg(F.count("kanj").alias("_nd"))
    hit = nd.join(nk, "entr").where("_nd = _nk").select("entr", "rdng")
    return (
        rdng.select("entr", "rdng", "txt")
        .join(hit, ["entr", "rdng"])
        .join(entr.select(F.col("id").alias("entr"), "seq"), "entr")
        .select(F.col("entr").alias("id"), "seq", "rdng", "txt")
    )


def choose_headword(
    entr: DataFrame, rdng: DataFrame, kanj: DataFrame, restr: DataFrame,
    misc: DataFrame, stagr: DataFrame, uk: int,
) -> DataFrame:
    """(id, rdng, kanj) ordinals that represent an entry.

    No kanji: first reading.  No reading: first kanji.  First reading denied for every
    kanji: that reading.  First sense tagged `uk`: first reading its deny rows leave.
    Otherwise the lowest (kanji, reading) allowed pair.  Null/null when an entry has neither.
    """
    r = rdng.groupBy("entr").agg(F.min("rdng").alias("r1"))
    k = kanj.groupBy("entr").agg(F.min("kanj").alias("k1"), F.count(F.lit(1)).alias("nk"))
    d1 = restr.join(r.withColumnRenamed("r1", "rdng"), ["entr", "rdng"], "left_semi")
    d1 = d1.groupBy("entr").agg(F.count(F.lit(1)).alias("nd"))
    first = F.col("sens") == 1
    uk1 = misc.where(first & (F.col("kw") == uk)).select("entr").distinct()
    ukr = lowest_allowed(
        rdng, uk1.select("entr", F.lit(1).alias("sens")), stagr.where(first), "rdng"
    ).select("entr", F.col("rdng").alias("ur"))
    pair = (
        valid_pairs(rdng, kanj, restr, "rdng", "kanj")
        .groupBy("entr")
        .agg(F.min(F.struct("kanj", "rdng")).alias("p"))
    )
    all_ = entr.select(F.col("id").alias("entr"))
    for part in (r, k, d1, ukr, pair):
        all_ = all_.join(part, "entr", "left")
    denied = F.coalesce("nd", F.lit(0)) == F.col("nk")
    pick = (
        F.when(F.col("k1").isNull(), F.struct(F.col("r1").alias("rdng"), F.lit(None).cast("int").alias("kanj")))
        .when(F.col("r1").isNull(), F.struct(F.lit(None).cast("int").alias("rdng"), F.col("k1").alias("kanj")))
        .when(denied, F.struct(F.col("r1").alias("rdng"), F.lit(None).cast("int").alias("kanj")))
        .when(F.col("ur").isNotNull(), F.struct(F.col("ur").alias("rdng"), F.lit(None).cast("int").alias("kanj")))
        .otherwise(F.struct(F.col("p.rdng").alias("rdng"), F.col("p.kanj").alias("kanj")))
    )
    return all_.select(F.col("entr").alias("id"), pick.alias("h")).select("id", "h.rdng", "h.kanj")


def deny_lists_to_allow(items: DataFrame, targets: DataFrame, deny: DataFrame, item: str, target: str) -> DataFrame:
    """X8 on tables: items that have deny rows, with the allowed target texts left.

    (entr, item, allowed): one row per allowed target; one row with a null text when all
    targets are denied.  Items without deny rows give no row (everything is allowed).
    """
    has = deny.select("entr", item).distinct()
    rest = has.join(targets.select("entr", target, "txt"), "entr").join(
        deny.select("entr", item, target), ["entr", item, target], "left_anti"
    )
    return has.join(items.select("entr", item), ["entr", item], "left_semi").join(
        rest, ["entr", item], "left"
    ).select("entr", item, target, F.col("txt").alias("allowed"))


def allow_lists_to_deny(
    items: DataFrame, targets: DataFrame, allow: DataFrame, item: str, target: str
) -> tuple[DataFrame, DataFrame]:
    """X8 inverse: (deny rows, unknown texts) from (entr, item, allowed) rows.

    An item listed only with a null text is denied every target; an item that is not
    listed is denied none.
    """
    t = targets.select("entr", target, F.col("txt").alias("allowed"))
    has = allow.select("entr", item).distinct()
    deny = (
        has.join(t, "entr")
        .join(allow.where("allowed IS NOT NULL").select("entr", item, "allowed"), ["entr", item, "allowed"], "left_anti")
        .select("entr", item, target)
    )
    unknown = allow.where("allowed IS NOT NULL").join(t, ["entr", "allowed"], "left_anti")
    return deny, unknown.select("entr", item, "allowed")
