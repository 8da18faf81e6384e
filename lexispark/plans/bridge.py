"""Driver tables presented as lexical tables.

One SQL text per table, used both by Spark (to build the stored tables below) and by
the oracle strings (as CTEs).  ``AS STRING`` becomes ``AS VARCHAR`` for DuckDB.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.session import ENTRY_PARTITIONS, path_exists, scratch_path

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

BRIDGE_SQL: dict[str, str] = {
    "kwsrc": """SELECT r_regionkey AS id, r_name AS kw, CASE r_regionkey WHEN 4 THEN 'kanjidic' WHEN 3 THEN 'examples' WHEN 2 THEN 'jmnedict' ELSE 'jmdict' END AS srct FROM region""",
    "entr": """SELECT o_orderkey AS id, CAST(o_custkey % 7 % 5 AS INT) AS src, CASE WHEN o_orderstatus <> 'F' THEN 2 WHEN o_orderkey % 2 = 0 THEN 4 ELSE 6 END AS stat, o_custkey + 1 AS seq, (o_orderkey % 4 <> 0) AS unap, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey >= 4 THEN CAST(floor(o_orderkey / 4) AS BIGINT) END AS dfrm, o_orderdate AS dt FROM orders""",
    "rdng": """SELECT entr, CAST(row_number() OVER (PARTITION BY entr ORDER BY txt) AS INT) AS rdng, txt FROM (SELECT DISTINCT l_orderkey AS entr, p_name AS txt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 4) x""",
    "kanj": """SELECT entr, CAST(row_number() OVER (PARTITION BY entr ORDER BY txt) AS INT) AS kanj, txt FROM (SELECT DISTINCT l_orderkey AS entr, s_name AS txt FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber >= 5) x""",
    "sens": """SELECT entr, CAST(row_number() OVER (PARTITION BY entr ORDER BY l_linenumber) AS INT) AS sens, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'note ' || CAST(entr AS STRING) END AS notes FROM (SELECT DISTINCT l_orderkey AS entr, l_linenumber FROM lineitem) x""",
    "gloss": """SELECT s.entr, s.sens, CAST(row_number() OVER (PARTITION BY s.entr, s.sens ORDER BY g.txt) AS INT) AS gloss, CAST(1 + length(g.txt) % 3 AS INT) AS ginf, g.txt FROM (SELECT DISTINCT l_orderkey AS entr, l_linenumber, p_type || ' ' || p_brand AS txt FROM lineitem JOIN part ON p_partkey = l_partkey) g JOIN sens s ON s.entr = g.entr AND s.l_linenumber = g.l_linenumber""",
    "freq": """SELECT DISTINCT r.entr, CASE WHEN l.l_linestatus = 'O' THEN r.rdng END AS rdng, CASE WHEN l.l_linestatus = 'F' THEN r.rdng END AS kanj, CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 5 ELSE 7 END AS kw, CAST(1 + l.l_linenumber % 2 AS INT) AS value FROM rdng r JOIN lineitem l ON l.l_orderkey = r.entr AND l.l_linenumber = r.rdng""",
    "restr": """SELECT r.entr, r.rdng, k.kanj FROM rdng r JOIN kanj k ON k.entr = r.entr WHERE (r.entr + r.rdng + k.kanj) % 3 = 0""",
    "stagr": """SELECT s.entr, s.sens, r.rdng FROM sens s JOIN rdng r ON r.entr = s.entr WHERE (s.entr + s.sens + r.rdng) % 4 = 0""",
    "hist": """SELECT user_id AS entr, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS hist, ts AS dt, event_type AS name, CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN props || '-*- bulk -*-' ELSE props END AS notes FROM events""",
    "t_entr": """SELECT p_partkey AS id, CAST(p_size % 2 AS INT) AS src, CASE WHEN p_size % 10 = 9 THEN 4 ELSE 2 END AS stat, (p_size % 7 = 0) AS unap FROM part""",
    "t_rdng": """SELECT p_partkey AS entr, 1 AS rdng, p_name || ' ' || p_brand AS txt FROM part UNION ALL SELECT p_partkey, 2, p_name || ' ' || p_type FROM part WHERE p_size % 3 = 0""",
    "t_kanj": """SELECT p_partkey AS entr, 1 AS kanj, p_name || ' ' || p_brand || ' ' || p_type AS txt FROM part WHERE p_size % 4 <> 0""",
    "t_sens": """SELECT p_partkey AS entr, n AS sens FROM part JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k ON n <= 1 + p_partkey % 3""",
    "xresolv": """SELECT DISTINCT l_orderkey AS entr, l_linenumber AS sens, 3 AS typ, l_partkey AS ord, CASE WHEN l_orderkey % 3 <> 2 THEN CASE WHEN l_partkey % 11 = 0 THEN 'nosuch' ELSE p_name || ' ' || p_brand END END AS rtxt, CASE WHEN l_orderkey % 3 <> 1 THEN p_name || ' ' || p_brand || ' ' || p_type END AS ktxt, CASE WHEN l_linenumber = 2 THEN 3 END AS tsens, CASE WHEN l_linenumber = 3 THEN true WHEN l_linenumber = 4 THEN false END AS prio FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "kwpos": """SELECT CAST(row_number() OVER (ORDER BY p_type) AS INT) AS id, p_type AS kw FROM (SELECT DISTINCT p_type FROM part) x""",
    "pos": """SELECT entr, sens, CAST(row_number() OVER (PARTITION BY entr, sens ORDER BY kw) AS INT) AS ord, kw FROM (SELECT DISTINCT s.entr, s.sens, k.id AS kw FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN kwpos k ON k.kw = p.p_type JOIN sens s ON s.entr = l.l_orderkey AND s.l_linenumber = l.l_linenumber WHERE p.p_size % 5 <> 0) x""",
    "xref": """SELECT DISTINCT s.entr, s.sens, CAST(2 + l.l_suppkey % 2 AS INT) AS typ, t.entr AS xentr, t.sens AS xsens, (l.l_returnflag = 'R') AS lowpri, (t.sens > 1 AND l.l_returnflag = 'A') AS nosens FROM lineitem l JOIN sens s ON s.entr = l.l_orderkey AND s.l_linenumber = l.l_linenumber JOIN sens t ON t.entr = l.l_partkey AND t.sens <= 2 WHERE l.l_orderkey <> l.l_partkey""",
    "kwgrp": """SELECT n_nationkey AS id, n_name AS kw FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region""",
    "grp": """SELECT o_orderkey AS entr, c_nationkey AS kw, CAST(1 + o_orderkey % 3 AS INT) AS ord FROM orders JOIN customer ON c_custkey = o_custkey""",
    # Further tables for operators the first twenty do not reach.
    "stagk": """SELECT s.entr, s.sens, k.kanj FROM sens s JOIN kanj k ON k.entr = s.entr WHERE (s.entr + s.sens + k.kanj) % 5 = 0""",
    "kwginf": """SELECT 1 AS id, 'equ' AS kw UNION ALL SELECT 2, 'lit' UNION ALL SELECT 3, 'fig' UNION ALL SELECT 4, 'expl' UNION ALL SELECT 5, 'tm'""",
    "kwfreq": """SELECT 1 AS id, 'ichi' AS kw UNION ALL SELECT 2, 'gai' UNION ALL SELECT 4, 'spec' UNION ALL SELECT 5, 'nf' UNION ALL SELECT 7, 'news'""",
    "kwmisc": """SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) AS INT) AS id, c_mktsegment AS kw FROM (SELECT DISTINCT c_mktsegment FROM customer) x""",
    "misc": """SELECT s.entr, s.sens, CAST(1 AS INT) AS ord, k.id AS kw FROM sens s JOIN orders o ON o.o_orderkey = s.entr JOIN customer c ON c.c_custkey = o.o_custkey JOIN kwmisc k ON k.kw = c.c_mktsegment WHERE (s.entr + s.sens) % 3 = 0""",
    "kwkinf": """SELECT CAST(row_number() OVER (ORDER BY o_orderpriority) AS INT) AS id, o_orderpriority AS kw FROM (SELECT DISTINCT o_orderpriority FROM orders) x""",
    "kinf": """SELECT j.entr, j.kanj, CAST(1 + (k.id + j.kanj) % 5 AS INT) AS ord, k.id AS kw FROM kanj j JOIN kwkinf k ON (j.entr + j.kanj + k.id) % 4 = 0""",
    "rinf": """SELECT j.entr, j.rdng, CAST(1 + (k.id + j.rdng) % 5 AS INT) AS ord, k.id AS kw FROM rdng j JOIN kwkinf k ON (j.entr + j.rdng + k.id) % 4 = 1""",
    "texts": """SELECT 'd' || CAST(doc_id AS STRING) AS tid, text AS txt FROM documents UNION ALL SELECT 'p' || CAST(page_id AS STRING), html FROM pages UNION ALL SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations
 UNION ALL SELECT 'k' || CAST(p_partkey AS STRING), translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'あいうえおかきくけこさしすせそたちつてとなにぬねのは・') FROM part
 UNION ALL SELECT 'h' || CAST(p_partkey AS STRING), translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', '日本語漢字食見行来学生先電車時間分半年月火水木金土曜・') || CAST(p_size % 4 AS STRING) FROM part
 UNION ALL SELECT 'w' || CAST(p_partkey AS STRING), translate(p_brand, 'Brand#', 'Ｂｒａｎｄ；') FROM part""",
    "label": """SELECT user_id AS file, event_id AS lab, CAST(event_id % 977 * 10 AS BIGINT) AS strt, CAST(event_id % 977 * 10 + 5 + event_id % 40 AS BIGINT) AS stop, props AS trns FROM events WHERE event_type = 'click'""",
    "clip": """SELECT user_id AS file, event_id AS id, CAST(event_id % 983 * 10 AS BIGINT) AS strt, CAST(5 + event_id % 60 AS BIGINT) AS leng, props AS trns FROM events WHERE event_type = 'view'""",
    "sndvol": """SELECT n_nationkey AS id, n_name AS loc, CAST(1 + n_nationkey % 2 AS INT) AS type FROM nation""",
    "sndfile": """SELECT s_suppkey AS id, s_nationkey AS vol, s_name AS loc FROM supplier""",
    "snd": """SELECT p_partkey AS id, CAST(p_partkey % 100 AS BIGINT) AS file, CAST(p_size * 100 AS BIGINT) AS strt, CAST(p_size AS BIGINT) AS leng, p_name AS trns FROM part""",
    "rdngsnd": """SELECT entr, rdng, CAST(1 AS INT) AS ord, CAST((entr + rdng) % 200 AS BIGINT) AS snd FROM rdng WHERE (entr + rdng) % 4 = 0""",
    "conj": """SELECT CAST(1 + r_regionkey AS INT) AS id, 'conj ' || r_name AS name FROM region""",
    "conjo": """SELECT k.id AS pos, c.id AS conj, (b.b % 2 = 1) AS neg, (b.b >= 2) AS fml, CAST(1 + (k.id + b.b) % 2 AS INT) AS onum, CAST(1 + (k.id + c.id) % 2 AS INT) AS stem, CASE WHEN (k.id + c.id + b.b) % 7 = 0 THEN NULL ELSE 'oku' || CAST(b.b AS STRING) END AS okuri, CASE WHEN c.id % 2 = 0 THEN 'r' END AS euphr, CASE WHEN k.id % 3 = 0 THEN 'k' END AS euphk FROM kwpos k JOIN conj c ON 1 = 1 JOIN (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) b ON 1 = 1 WHERE k.kw LIKE 'S%'""",
    "conotes": """SELECT 1 AS id, 'first note' AS txt UNION ALL SELECT 2, 'second note' UNION ALL SELECT 3, 'third note'""",
    "conjo_notes": """SELECT o.pos, o.conj, o.neg, o.fml, o.onum, n.id AS note FROM conjo o JOIN conotes n ON (o.pos + o.conj + n.id) % 4 = 0""",
}

#: Tables stored in buckets of an entry's number: what joins or groups them by entry needs no shuffle.
BUCKETED: dict[str, str] = {"entr": "id"} | dict.fromkeys(
    "rdng kanj sens gloss freq restr stagr stagk hist xresolv pos xref misc kinf rinf rdngsnd grp".split(), "entr"
)

_WORD = re.compile(r"[a-z_]+")
#: Rows of the largest input table, and compressed bytes, that one task of a table's making gets.
TASK_ROWS, TASK_BYTES = 1 << 18, 8 << 20
_buckets: dict[str, int] = {}


def _direct(sql: str) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", sql))
    return [name for name in BRIDGE_SQL if name in words]


def needed(sql: str) -> list[str]:
    """Bridge tables a statement reads, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in _direct(BRIDGE_SQL[name]):
            visit(dep)
        if name not in out:
            out.append(name)

    for name in _direct(sql):
        visit(name)
    return out


def oracle(sql: str, ctes: str = "", recursive: bool = False) -> str:
    """DuckDB text of a query over bridge tables; ``ctes`` are extra WITH members."""
    parts = [f"{n} AS MATERIALIZED ({BRIDGE_SQL[n]})" for n in needed(ctes + " " + sql)]
    if ctes:
        parts.append(ctes)
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " " if parts else ""
    return (head + sql).replace("AS STRING", "AS VARCHAR")


@contextmanager
def small_tasks(spark: SparkSession, rows: int, buckets: int = 0) -> Iterator[None]:
    """While a table is made, shuffles have partitions that grow in number with its input, so
    that the memory of one task does not grow with it. Those of a table in buckets have the
    buckets' number, and a join by entry and more keeps the buckets it reads."""
    confs = {
        "spark.sql.shuffle.partitions": str(buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES // 2),  # rows that are combined before a shuffle
    }
    if buckets:
        confs["spark.sql.requireAllClusterKeysForCoPartition"] = "false"
    before = {key: spark.conf.get(key, None) for key in confs}
    for key, value in confs.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Bridge:
    """Lexical tables of one data folder.

    Each table is written once per application as parquet in the shared folder and read
    back from there, so every operator starts from a column-pruned, filter-pushing file
    scan of a stored table, as it would in production, and not from the bridge joins.
    Tables of an entry's rows are stored in buckets by entry, all in the same number.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BRIDGE_SQL:
            return self.table(name)
        if name in DRIVER_TABLES:
            return self.driver(name)
        raise AttributeError(name)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in names}

    @cached_property
    def buckets(self) -> int:
        """Buckets of a table, by the rows of the largest driver table. Shuffles of the session
        get partitions in that number at least, so that no task grows with the input. A bucket is
        one sorted file; scans say so, and joins and groups by entry need neither sort nor hash it."""
        at = scratch_path(self.spark, "buckets", self.sf_dir)
        if at not in _buckets:
            given = [t for t in ("orders", "lineitem", "events") if path_exists(self.spark, f"{self.sf_dir}/{t}.parquet")]
            rows = max((self.driver(t).count() for t in given), default=0)
            _buckets[at] = max(self.spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        n = _buckets[at]
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) < n:
            self.spark.conf.set("spark.sql.shuffle.partitions", str(n))
        self.spark.conf.set(ENTRY_PARTITIONS, str(n))
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
        return n

    def table(self, name: str) -> DataFrame:
        if name in BUCKETED:
            return self._in_buckets(name, BUCKETED[name], lambda: self._define(name))
        path = scratch_path(self.spark, name, self.sf_dir)
        if not path_exists(self.spark, path + "/_SUCCESS"):
            made, rows = self._define(name)
            with small_tasks(self.spark, rows):
                made.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def renumbered(self, name: str, step: int, ids: Sequence[str], change: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """A table with `step` added to its ids and something changed, in buckets as the table is:
        numbers that are made in the query would have all tables dealt out and sorted anew. A step
        stands for one change."""
        own = lambda df: df.select(*[(F.col(c) + step).alias(c) if c in ids else F.col(c) for c in df.columns])
        return self._in_buckets(f"{name}_{step}", BUCKETED[name], lambda: (own(change(df := self.table(name))), df.count()))

    def _in_buckets(self, name: str, key: str, made: Callable[[], tuple[DataFrame, int]]) -> DataFrame:
        """A table stored in buckets of a key: made once, with the rows of its largest input."""
        path = scratch_path(self.spark, name, self.sf_dir)
        stored = f"lexispark_{hashlib.sha1(path.encode()).hexdigest()[:16]}_{name}"
        n = self.buckets
        if not self.spark.catalog.tableExists(stored):
            df, rows = made()
            with small_tasks(self.spark, rows, n):
                df.repartition(key).write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(stored)
        return self.spark.table(stored)

    def _define(self, name: str) -> tuple[DataFrame, int]:
        """The table, and the rows of the largest one it is made from."""
        sql = BRIDGE_SQL[name]
        words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", sql))
        frames = {w: self.driver(w) for w in words if w in DRIVER_TABLES}
        # Tables in buckets are merged: their files are small for the rows a broadcast would hold in the driver.
        frames.update({w: self.table(w).hint("merge") if w in BUCKETED else self.table(w) for w in words if w in BRIDGE_SQL})
        for w in frames:
            sql = re.sub(rf"(FROM|JOIN)\s+{w}\b", rf"\1 {{{w}}} {w}" if not re.search(
                rf"(FROM|JOIN)\s+{w}\s+(?!WHERE|JOIN|ON|GROUP|UNION)[a-z]\w*", sql) else rf"\1 {{{w}}}", sql)
        rows = max((df.count() for df in frames.values()), default=0)
        return self.spark.sql(sql, **frames) if frames else self.spark.sql(sql), rows
