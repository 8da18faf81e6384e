"""Plans that must not gather or move what grows with the entries."""

import pytest
from pyspark.sql import functions as F

from lexispark.operators import inflect, refs
from lexispark.operators.assemble import assemble_entries
from lexispark.plans import catalog_io
from lexispark.plans.bridge import Bridge
from lexispark.sources import edict_out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def tables(rows):
    no = lambda a, b: rows(f"entr BIGINT, {a} INT, {b} INT")
    return {
        "entr": rows("id BIGINT, src INT, stat INT, seq BIGINT, dfrm BIGINT, unap BOOLEAN", (1, 1, 2, 1, None, False), (2, 1, 2, 2, None, False)),
        "sens": rows("entr BIGINT, sens INT", (1, 1), (1, 2), (2, 1)),
        # The second row's sense is missing.
        "pos": rows("entr BIGINT, sens INT, ord INT, kw INT", (1, 1, 1, 28), (2, 9, 1, 28), (2, 1, 1, 45)),
        "rdng": rows("entr BIGINT, rdng INT, txt STRING", (1, 1, "たべる"), (2, 1, "くる")),
        "kanj": rows("entr BIGINT, kanj INT, txt STRING", (1, 1, "食べる")),
        "gloss": rows("entr BIGINT, sens INT, gloss INT, lang INT, ginf INT, txt STRING", (1, 1, 1, 1, 1, "eat"), (2, 1, 1, 1, 1, "come")),
        "restr": no("rdng", "kanj"), "stagr": no("sens", "rdng"), "stagk": no("sens", "kanj"),
    }


@pytest.fixture(scope="module")
def words(rows, tables):
    """Tables as of paradigms; one kind of form has two variants, one rule no ending."""
    rule = "pos INT, conj INT, neg BOOLEAN, fml BOOLEAN, onum INT"
    conjo = rows(
        rule + ", stem INT, okuri STRING, euphr STRING, euphk STRING",
        (28, 2, True, False, 2, 1, "ず", None, None), (28, 2, True, False, 1, 1, "ない", None, None), (28, 2, False, False, 1, 1, "た", None, None),
        (28, 2, False, True, 1, 1, None, None, None), (45, 2, False, False, 1, 1, "た", "き", "来"),
    )
    notes = rows(rule + ", note INT", (28, 2, True, False, 2, 3), (28, 2, True, False, 2, 1))
    t = tables
    return (t["entr"], t["sens"], t["pos"], rows("id INT, kw STRING", (28, "v1"), (45, "vk")), t["rdng"], t["kanj"], rows("id INT, name STRING", (2, "Past")),
            conjo, notes, t["restr"], t["stagr"], t["stagk"])


@pytest.fixture(scope="module")
def bridge(spark, tmp_path_factory):
    """A data folder of a few rows."""
    at = str(tmp_path_factory.mktemp("few"))
    made = {
        "region": "SELECT 0 AS r_regionkey, 'A' AS r_name", "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name",
        "customer": "SELECT 1L AS c_custkey, 'c' AS c_name, 'BUILDING' AS c_mktsegment, 0 AS c_nationkey", "supplier": "SELECT 1L AS s_suppkey, 'Supplier#1' AS s_name, 0 AS s_nationkey",
        "part": "SELECT id AS p_partkey, concat('small ring ', id) AS p_name, 'STEEL' AS p_type, 'Brand#1' AS p_brand, 1 AS p_size FROM range(4)",
        "orders": "SELECT id AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, DATE '2020-01-01' AS o_orderdate, '1' AS o_orderpriority FROM range(5)",
        "lineitem": "SELECT id DIV 3 AS l_orderkey, id % 4 AS l_partkey, 1L AS l_suppkey, CAST(1 + id % 3 AS INT) AS l_linenumber, 'O' AS l_linestatus, 'A' AS l_returnflag FROM range(15)",
    }
    for name, sql in made.items():
        spark.sql(sql).write.parquet(f"{at}/{name}.parquet")
    return Bridge(spark, at)


def test_inflection_from_rules_equals_that_from_forms(words):
    forms, rules = inflect.inflect(*words), inflect.paradigms(*words)
    for make in (inflect.inflection_table, inflect.inflection_text):
        assert tuples(make(rules), "*") == tuples(make(forms), "*")
    assert tuples(inflect.inflection_table(rules), "id", "w0", "w1", "w2") == [
        (1, "食べた【たべた】", None, "食べない【たべない】,\n食べず【たべず】 [1,3]"), (2, "きた", None, None)]
    assert tuples(forms, "id", "t", "onum") == [(1, "aff-plain", 1), (1, "neg-plain", 1), (1, "neg-plain", 2), (2, "aff-plain", 1)]


def test_pairs_are_merged_by_entry(bridge):
    """No table of entries is broadcast, and senses are looked up without a shuffle of their own."""
    at = plan(inflect.allowed_pairs(*bridge.tables("entr", "sens", "pos", "rdng", "kanj", "restr", "stagr", "stagk").values()))
    assert "Broadcast" not in at and "LeftSemi" not in at and "Exchange" not in at


def test_rules_meet_pairs_without_a_shuffle(words):
    at = plan(inflect.inflection_text(inflect.paradigms(*words)))
    assert "array_sort" not in at and "hashpartitioning(pos" not in at


def test_assembly_broadcasts_no_children(bridge):
    assert "Broadcast" not in plan(assemble_entries(bridge.tables("entr", "rdng", "kanj", "sens", "gloss", "freq", "pos")))


def test_lines_broadcast_no_children(bridge, kw):
    assert "Broadcast" not in plan(edict_out.edict_lines(bridge.tables("entr", "rdng", "kanj", "sens", "gloss", "freq", "pos"), kw))


def test_reference_marks_take_few_shuffles(spark, rows, tables):
    x = rows("entr BIGINT, sens INT, typ INT, xentr BIGINT, xsens INT, xref INT", (1, 1, 3, 2, 1, 1), (2, 1, 3, 1, 2, 2), (2, 1, 3, 1, 1, 1), (2, 1, 3, None, 1, 3))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = refs.mark_seq_xrefs(refs.xref_sense_lists(x), tables["entr"])
        assert plan(out).count("Exchange hashpartitioning") <= 7
        got = tuples(out, "entr", "xref", F.array_join("xsenses", ","), "seq_xref")
    finally:
        spark.conf.set(key, before)
    assert got == [(1, 1, "1", True), (2, 1, "1,2", True), (2, 2, "", True), (2, 3, "1", None)]


def test_new_numbers_keep_their_buckets(bridge):
    up = lambda n: bridge.renumbered(n, 1, ("id", "entr", "dfrm"))
    t = {n: up(n) for n in ("entr", "rdng", "sens")}
    assert tuples(t["rdng"], "*") == tuples(bridge.rdng.withColumn("entr", F.col("entr") + 1), "*")
    assert tuples(t["entr"], "id", "seq", "dfrm") == tuples(bridge.entr.select(F.col("id") + 1, "seq", F.col("dfrm") + 1), "*")
    assert "Exchange" not in plan(assemble_entries(t))


def test_lines_to_read_are_chosen_without_broadcasts(bridge, monkeypatch):
    class Seen(Exception):
        pass

    def seen(tables, kw):
        raise Seen(plan(tables["entr"]), tables["entr"].count())

    monkeypatch.setattr(catalog_io.edict_out, "edict_lines", seen)
    with pytest.raises(Seen) as got:
        catalog_io.s5(bridge)
    at, n = got.value.args
    assert n == 5 and "Broadcast" not in at
