"""A few registered queries against DuckDB at the smallest scale (tools/verify.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from compared_rows import tuples
from lexispark.operators.assemble import assemble_entries
from lexispark.operators.audit import gathered
from lexispark.plans.bridge import DRIVER_TABLES, TASK_BYTES, TASK_ROWS, Bridge, small_tasks

SF = "/root/testdata/sf0.001"
PICK = ["j1_headwords", "a2_entry_summary", "a6_group_counts", "w3_sequence_gaps", "q19_deleted_and_active", "e2_edit_paths", "j11_align_clips", "r2_drop_resolved", "g1_history_calendar_stream"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", PICK)
def test_parity(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(names) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_audits_make_only_the_tables_they_read(spark, tmp_path):
    """An audit of entries reads orders, and neither lines nor the references made from them."""
    spark.createDataFrame([(1, 8, "F"), (2, 8, "F"), (4, 8, "F"), (5, 8, "O")], "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING").selectExpr(
        "*", "DATE '2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    assert tuples(entry.queries()["q19_deleted_and_active"](spark, str(tmp_path))) == [(5, 1, 9, 1)]


def test_tables_are_made_in_small_tasks(spark):
    """The partitions follow the rows, and the session's settings come back."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    for rows, parts in ((0, before[0]), (TASK_ROWS * 50 + 1, "51")):
        with small_tasks(spark, rows):
            assert spark.conf.get(keys[0]) == parts and int(spark.conf.get(keys[1])) == TASK_BYTES
        assert [spark.conf.get(k) for k in keys] == before


def test_rows_of_entries_meet_without_a_shuffle(spark):
    """Tables in buckets by entry are gathered where they are, none of them shuffled."""
    b = Bridge(spark, SF)
    t = b.tables("entr", "rdng", "sens", "gloss")
    both = gathered({n: (df, "id" if n == "entr" else "entr", ["src"] if n == "entr" else [n]) for n, df in t.items()})
    assert both.count() == b.driver("orders").count()
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_joins_by_entry_hold_no_rows(spark):
    """Buckets are sorted files: many tables are grouped and joined by entry without sorts or hash maps."""
    t = Bridge(spark, SF).tables("entr", "rdng", "kanj", "sens", "gloss")
    e = assemble_entries(t)
    assert e.count() == t["entr"].count()
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Sort [" not in plan and "hashpartitioning" not in plan
