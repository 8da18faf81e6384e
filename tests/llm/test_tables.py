"""URL filter, tool calls, sharding, pipeline."""

import json
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from lexispark.llm import kd_shards, tool_calls, url_filter
from lexispark.llm.catalog import URL_RULES


def test_url_filter(spark):
    urls = [
        (1, "https://x.org/a?b#c", "org/", "allow"), (2, "HTTP://Www.Example.ORG/es/1", "example.org/es/", "block"), (3, "x://example.org/en/12", "example.org/en/1", "block"),
        (4, "x://sub.example.org/en/2", "org/", "allow"), (5, "x://org", None, "allow"), (6, "no url", None, "allow"), (7, None, None, "allow"), (8, "", None, "allow"),
        (9, "x://a.com/de/9", "com/de/", "block"), (10, "x://com/fr/", "com/fr/", "allow"), (11, "x://notcom/de/", None, "allow"), (12, "http://bad.net/p/", None, "block"),
        (13, "https://www.bad.net/p.html?x", None, "block"), (14, "https://bad.net/q", None, "allow"), (15, "x://bad.net?y://z", None, "allow"), (16, "x://org/" + "a" * 5000, "org/", "allow"), (12, "http://bad.net/p/", None, "block"),
    ]
    pages = spark.createDataFrame([(i, u, "own", 5) for i, u, *_ in urls], "page_id bigint, url string, rule string, _block int")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,), ("else.net/",)], "canonical_url string")
    got = url_filter.judge(pages, listed, URL_RULES).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, r, v) for i, _, r, v in urls), key=str)
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id = 12"), listed.limit(0), URL_RULES).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), listed, URL_RULES).collect() == []


def test_bloom_loses_no_listed_url(spark):
    pages = spark.range(0, 4000).selectExpr("concat('h', id, '.net/') as u")
    listed = pages.where("hash(u) % 3 = 0").withColumnRenamed("u", "l")
    assert url_filter.in_list(pages, listed, "u", "l").count() == listed.count()


CALLS = [
    (1, "a", 2, "f", '{"n": 1, "b": true}', None), (1, "b", 4, "f", '{"b": 1, "x": 2}', "a"), (1, "c", 6, "g", '{"z": "ü\\n\\"", "a": [1, {"d": 1, "c": null}], "n": 1.5}', "b"), (1, "d", 8, "f", "not json", "gone"),
    (1, "e", 10, "nope", "{}", "c"), (1, "p", 11, "f", '{"b": false, "n": 2}', "q"), (1, "q", 12, "f", "[1]", "p"), (1, "r", 13, "f", None, "q"), (2, "a", 1, "f", '{"b": true, "n": null}', "e"), (1, "a", 2, "f", '{"n": 1, "b": true}', None),
    (None, "a", 3, "f", '{"b": true}', None), (1, None, 3, None, '{"b": true}', None), (3, "s", 1, "f", '{"b": true}', "s"),
]
RESULTS = [(1, "a", 3, "yes"), (1, "a", 9, "late"), (1, "b", 5, None), (2, "b", 2, "lone"), (None, "a", 1, "none"), (2, "a", 3, "x\ty")]
SCHEMAS = [("f", "b", "boolean", True), ("f", "n", "integer", False), ("g", "z", "string", True), ("g", "a", "array", False), ("g", "n", "number", False), (None, "q", "string", True)]


def linked(spark, calls, results):
    return tool_calls.link(
        spark.createDataFrame([(*c, 1) for c in calls], "conv_id bigint, call_id string, turn bigint, name string, arguments string, after string, depth int"),
        spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string"),
        spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean"),
    )


def test_tool_calls(spark):
    rows = linked(spark, CALLS, RESULTS).collect()
    got = {(r["conv_id"], r["call_id"], r["status"]): r for r in rows}
    assert len(rows) == len(got) == 16
    assert got[1, "a", "duplicate_call"]["errors"] == ["duplicate:call_id"] and json.loads(got[1, "a", "duplicate_call"]["line"])["result"] is None
    assert got[1, "a", "duplicate_result"]["turn"] == 9 and json.loads(got[1, "a", "duplicate_result"]["line"])["result"] == "late"
    assert [(got[1, c, s]["depth"], got[1, c, s]["errors"]) for c, s in (("a", "linked"), ("b", "linked"), ("c", "no_result"), ("d", "no_result"), ("e", "no_result"), ("p", "no_result"), ("q", "no_result"), ("r", "no_result"))] == [
        (0, []), (1, ["type:b", "unknown:x"]), (2, []), (0, ["after:missing", "arguments:not an object"]), (3, ["name:unknown"]),
        (None, ["after:cycle"]), (None, ["after:cycle", "arguments:not an object"]), (None, ["after:cycle", "arguments:not an object"]),
    ]
    assert got[2, "a", "linked"]["errors"] == ["after:missing", "type:n"] and got[3, "s", "no_result"]["errors"] == ["after:cycle"]
    for r in rows:
        if r["status"] in ("orphan_result", "duplicate_result"):
            assert set(json.loads(r["line"])) == {"call_id", "conv_id", "result"}
            continue
        line = json.loads(r["line"])
        assert r["line"] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (line["conv_id"], line["call_id"], line["name"]) == (r["conv_id"], r["call_id"], r["name"])
    assert json.loads(got[1, "a", "linked"]["line"])["result"] == "yes" and json.loads(got[2, "a", "linked"]["line"])["result"] == "x\ty"
    assert {(r["conv_id"], r["call_id"]) for r in rows if r["status"] == "orphan_result"} == {(2, "b"), (None, "a")}


def test_tool_calls_with_a_very_long_argument_and_many_copies(spark):
    long = "ä\" " * 200_000
    calls = [(1, "a", 1, "g", json.dumps({"z": long}), None)] + [(1, "b", 2, "f", '{"b": true}', "a")] * 300
    rows = linked(spark, calls, [(1, "a", 2, long)] + [(1, "b", 5, "r")] * 40).collect()
    assert Counter(r["status"] for r in rows) == {"linked": 2, "duplicate_call": 299, "duplicate_result": 39}
    line = json.loads(next(r["line"] for r in rows if r["call_id"] == "a"))
    assert line["arguments"]["z"] == line["result"] == long


def test_tool_calls_of_a_long_chain_and_of_nothing(spark):
    calls = [(1, f"c{i}", i, "f", '{"b": true}', f"c{i - 1}" if i else None) for i in range(70)] + [(1, f"d{i}", i, "f", '{"b": true}', "c0") for i in range(50)]
    assert {r["call_id"]: r["depth"] for r in linked(spark, calls, []).collect()} == {**{f"c{i}": i for i in range(70)}, **{f"d{i}": 1 for i in range(50)}}
    assert linked(spark, [], []).collect() == []


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(documents, shards):
    rows = kd_shards.shard(documents, shards).collect()
    want = Counter()
    for r in documents.select("doc_id", "text").collect():
        b = (r["text"] or "").encode()
        want[(r["doc_id"], len(b) + 1, zlib.crc32(b))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert all(len({r["shard"] for r in rows if (r["size"], r["text_crc32"]) == k}) == 1 for k in {(r["size"], r["text_crc32"]) for r in rows})


def test_shards_are_near_equal(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 90)) for i in range(800)], "doc_id bigint, text string")
    bytes_ = Counter()
    for r in kd_shards.shard(docs, 8).collect():
        bytes_[r["shard"]] += r["size"]
    assert len(bytes_) == 8 and max(bytes_.values()) - min(bytes_.values()) < 0.05 * sum(bytes_.values()) / 8
    assert kd_shards.shard(docs.limit(0), 8).collect() == []


def sets_of(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_pipeline_stages(spark, documents, prose, tmp_path):
    """Rows with shared and missing ids, and columns named like those that stages add."""
    leak = prose(4321, 40)
    own = [c for c in documents.columns if c not in ("n", "size")] + ["n", "size"]
    docs = documents.select(own).withColumns({"score": documents.n * 0.5, "n_removed": documents.n, "_row": documents.tile, "lang_pred": documents.rejected, "held_out": documents.part, "_doc": documents.n, "_text": documents.n})
    more = [(70, prose(70, 80) + " " + leak), (3, prose(500, 60)), (3, prose(501, 60)), (None, prose(77, 50)), (None, prose(502, 60)), (None, prose(502, 60)), (80, prose(503, 60) + " " + prose(504, 50)), (81, prose(505, 60) + " " + prose(504, 50))]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert steps[-1].columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    at = docs.columns.index
    ids = lambda rs: {r[at("doc_id")] for r in rs}
    assert not Counter(rows[1]) - Counter(rows[0])  # language ID keeps rows as they are
    assert {22, 23, 27, 29} & ids(rows[1]) == set() and {0, 20, 28, 80} <= ids(rows[1])

    key = lambda r: (r[at("doc_id")] is None, r[at("doc_id")] or 0)
    sets = [sets_of(r[at("text")]) for r in rows[1]]
    root = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root = [min(root[a], root[b]) if c in (root[a], root[b]) else c for c in root]
    groups = {}
    for r, g in zip(rows[1], root):
        groups.setdefault(g, []).append(r)
    assert sorted(key(r) for r in rows[2]) == sorted(min(map(key, g)) for g in groups.values())
    assert not Counter(rows[2]) - Counter(rows[1]) and all(sum(r in g for r in rows[2]) == 1 for g in groups.values())

    before = {(r[at("doc_id")], r[at("lang")], r[at("n")]) for r in rows[2]}
    assert {(r[at("doc_id")], r[at("lang")], r[at("n")]) for r in rows[3]} <= before
    texts = {r[at("doc_id")]: r[at("text")] for r in rows[3]}
    assert prose(504, 50) in texts[80] and prose(504, 50) not in texts[81] and texts[81].startswith(prose(505, 60))
    for r in rows[3]:
        assert r[at("n_chars")] in (None, len(r[at("text")]))
    item = sets_of(leak.replace(".", ""))
    leaks = lambda r: 100 * len(item & sets_of(r[at("text")].replace(".", ""))) >= 80 * len(item)
    assert 70 in ids(rows[3]) and Counter(rows[4]) == Counter(r for r in rows[3] if not leaks(r))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows[5]) and ids(rows[4]) == {r["doc_id"] for r in steps[5].collect()}
