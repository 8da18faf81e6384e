"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
#: Setting of the session: the number of parts by entry that stored tables have.
ENTRY_PARTITIONS = "lexispark.entry.partitions"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "lexispark", **conf: str):
    """A session for tests and local runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(map=conf)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder.  On a cluster the
    setting is required: a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lexispark-")
        sc.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str, *key: str) -> str:
    """A path in the shared folder: stable for a given key within one application."""
    app = spark.sparkContext.applicationId
    tail = hashlib.sha1("|".join(key).encode()).hexdigest()[:12] if key else uuid.uuid4().hex[:12]
    return f"{shared_dir(spark)}/lexispark/{app}/{tail}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder, so losing an
    executor re-reads files instead of replaying a long lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Like `cut`, as a table of the shared folder, in one job; and the number of rows that
    meet a condition (of all rows without one)."""
    spark, path, seen = df.sparkSession, scratch_path(df.sparkSession, "kept"), Observation()
    n = F.count_if(counted) if counted is not None else F.count(F.lit(1))
    df.observe(seen, n.alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def by_entry(df: DataFrame, key: str) -> DataFrame:
    """The rows in parts by `key`, as many as stored tables have buckets: those of a table
    in such buckets stay where they are."""
    spark = df.sparkSession
    return df.repartition(int(spark.conf.get(ENTRY_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")), key)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)
