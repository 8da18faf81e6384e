"""Merkle manifest of a dataset by checkpoint and recompute.

A row is a leaf, the rows of a source are a tree with 16 children a node, the roots of the
sources (subroots) are the leaves of one more tree. Only every second level of a tree is
stored: a node of it stands for an aligned subtree of up to 256 nodes of the stored level
below. A proof needs the siblings on every level, so the subtree's missing level is made
anew from the stored one inside the row of the subtree, its siblings go to the proofs of
what lies below, and it is dropped. Paths go down from the root, stored level by stored
level; one row of them serves the 256 children of a subtree.

A tree needs log(rows) / log(256) rounds up and as many down. No group holds more than 256
nodes, whatever source the rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.shared import if_small, stored

#: Children of a node, and levels from one stored level to the next.
FAN, STEP = 16, 2

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_hash(**changed: Column) -> Column:
    """sha256 of the fields in their order; ``changed`` gives columns in place of fields."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def is_tampered(doc_id: Column) -> Column:
    """Whether 5 divides the checksum of the decimal id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, leaf, tampered); _key orders sources bytewise, null first."""
    lowered = F.translate("text", _UPPER, _LOWER)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key"), "doc_id", leaf_hash().alias("leaf"),
        F.when(is_tampered(F.col("doc_id")), leaf_hash(text=lowered)).otherwise(leaf_hash()).alias("tampered"),
    )


def in_order(rows: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """Stored rows with ``_pos``, the place among the rows of their key in the order of ``by``.

    The rows are sorted over all parts; a part numbers its rows from the first one of each
    key in it, and gets what the parts before it hold of that key.
    """
    ordered = rows.repartitionByRange(key, *by).sortWithinPartitions(key, *by)
    kept = stored(ordered.withColumn("_rid", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_rid", 33))
    part = kept.groupBy(key, "_part").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = stored(part.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}_parts")
    return kept.join(if_small(part), [key, "_part"]).withColumn("_pos", F.col("_rid") + F.col("_shift")).drop("_rid", "_part", "_shift")


def _runs(nodes: Column) -> Column:
    """The level above: the hash of every 16 consecutive nodes."""
    last = F.floor((F.size(nodes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def _stored_levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels, lowest first, and (_key, _hash) of the roots. ``nodes`` has _key,
    _pos (gapless from 0 in a key), _hash and _count, the number of rows of its key."""
    levels = [nodes]
    most = nodes.agg(F.max("_count")).first()[0] or 0
    while most > 1:
        groups = _subtrees(levels[-1]).withColumn("_level", _runs(F.col("_children")))
        node = F.when(F.col("_count") == 1, F.col("_children")[0]).when(F.col("_count") <= FAN, F.col("_level")[0]).otherwise(F.sha2(F.array_join("_level", ""), 256))
        above = groups.select("_key", F.col("_group").alias("_pos"), node.alias("_hash"), F.expr(f"(_count + {FAN**STEP - 1}) div {FAN**STEP}").alias("_count"))
        levels.append(stored(above, f"{name}_level"))
        most = -(-most // FAN**STEP)
    # a tree that has ended keeps its root on the levels above it, by no further hash
    return levels, levels[-1].select("_key", "_hash")


def _subtrees(level: DataFrame, *extra: str) -> DataFrame:
    """(_key, _group, _count, _children, one array for each of ``extra``) of a stored level."""
    held = F.sort_array(F.collect_list(F.struct("_pos", "_hash", *extra)))
    groups = level.groupBy("_key", F.expr(f"_pos div {FAN**STEP}").alias("_group"), "_count").agg(held.alias("_held"))
    return groups.select("_key", "_group", "_count", F.col("_held._hash").alias("_children"), *[F.col(f"_held.{c}").alias(f"_all_{c}") for c in extra])


def _paths_down(level: DataFrame, above: DataFrame, *extra: str) -> DataFrame:
    """(_key, _pos, _hash, ``extra``, _path) of a level; ``above`` has (_key, _pos, _path) of
    the next stored level. The level between them is made anew here and not kept."""
    groups = _subtrees(level, *extra).join(above.select("_key", F.col("_pos").alias("_group"), F.col("_path").alias("_upper")), ["_key", "_group"])
    groups = groups.withColumn("_level", _runs(F.col("_children")))
    runs = groups.select("*", F.posexplode("_level").alias("_run", "_node"))
    own = lambda c: F.slice(F.col(c), F.col("_run") * FAN + 1, FAN)
    beside = F.when((F.col("_count") > FAN), F.array(_beside(F.col("_level"), F.col("_run")))).otherwise(F.array().cast(_PATH))
    runs = runs.select("_key", "_group", "_count", "_run", own("_children").alias("_children"), *[own(f"_all_{c}").alias(f"_all_{c}") for c in extra], F.concat(beside, F.col("_upper")).alias("_upper"))
    rows = runs.select("*", F.posexplode("_children").alias("_place", "_hash"))
    path = F.when(F.col("_count") > 1, F.concat(F.array(_beside(F.col("_children"), F.col("_place"))), F.col("_upper"))).otherwise(F.col("_upper"))
    pos = F.col("_group") * FAN**STEP + F.col("_run") * FAN + F.col("_place")
    return rows.select("_key", pos.alias("_pos"), "_hash", *[F.col(f"_all_{c}")[F.col("_place")].alias(c) for c in extra], path.alias("_path"))


def _beside(nodes: Column, place: Column) -> Column:
    """What stands before and after a node in its run, each as one text."""
    return F.struct(F.array_join(F.slice(nodes, 1, place), "").alias("before"), F.array_join(F.slice(nodes, place + 2, FAN), "").alias("after"))


def _down(levels: list[DataFrame], top: DataFrame, name: str, *extra: str) -> DataFrame:
    """Paths of the lowest of ``levels``; ``top`` has (_key, _path) of the roots."""
    paths = top.select("_key", F.lit(0).cast("long").alias("_pos"), "_path")
    for k in reversed(range(len(levels) - 1)):
        paths = _paths_down(levels[k], paths, *(extra if k == 0 else ()))
        if k:
            paths = stored(paths.select("_key", "_pos", "_path"), f"{name}_paths")
    if len(levels) == 1:
        paths = levels[0].join(top, "_key").select("_key", "_pos", "_hash", *extra, "_path")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source_key, position, leaf, subroot, root, proof_sha256, siblings (number of
    levels of the proof), folded_root, verified: a row for every row of ``docs``.

    Leaves of a source ascend by doc_id, null first; rows that share a doc_id by their leaf,
    so the tree doesn't depend on the order of files. Null fields count as ``-``; an empty
    text is a text of 0 bytes. Equal rows have equal leaves at places of their own. No rows
    give no rows. Only the five fields are read, other columns may have any name.
    """
    placed = in_order(stored(leaves(docs), "leaves"), "_key", ["doc_id", "leaf", "tampered"], "ordered_leaves")
    counts = stored(placed.groupBy("_key").agg(F.count(F.lit(1)).alias("_count")), "sources")
    nodes = stored(placed.join(if_small(counts), "_key").select("_key", "_pos", F.col("leaf").alias("_hash"), "_count", "doc_id", "tampered"), "nodes")
    levels, subroots = _stored_levels(nodes, "source")
    sources = subroots.select(F.lit("").alias("_all"), F.col("_key").alias("_source"), "_hash")
    sources = in_order(sources, "_all", ["_source"], "ordered_sources")
    tops = stored(sources.select(F.col("_all").alias("_key"), "_pos", "_hash", F.lit(counts.count()).cast("long").alias("_count"), "_source"), "subroots")
    top_levels, roots = _stored_levels(tops, "top")
    start = roots.select("_key", F.array().cast(_PATH).alias("_path"))
    of_source = _down(top_levels, start, "top", "_source").join(if_small(roots.select("_key", F.col("_hash").alias("root"))), "_key")
    of_source = stored(of_source.select(F.col("_source").alias("_key"), F.col("_hash").alias("subroot"), "root", "_path"), "source_paths")
    rows = _down(levels, of_source, "source", "doc_id", "tampered").join(if_small(of_source.select("_key", "subroot", "root")), "_key")
    proof = F.sha2(F.array_join(F.flatten(F.transform("_path", lambda p: F.array(p["before"], p["after"]))), ""), 256)
    folded = F.aggregate("_path", F.col("tampered"), lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))
    rows = rows.select(
        "doc_id", F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 30)).alias("source_key"), F.col("_pos").alias("position"), F.col("_hash").alias("leaf"),
        "subroot", "root", proof.alias("proof_sha256"), F.size("_path").alias("siblings"), folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
