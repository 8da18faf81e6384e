"""Toxicity, Merkle manifest, collocations."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import collocations, merkle, toxicity


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def runs(nodes):
    return [nodes[i : i + 16] for i in range(0, len(nodes), 16)]


def climb(nodes, at):
    """Root, siblings before and after on every level, of a plain list of nodes."""
    path = []
    while len(nodes) > 1:
        run = runs(nodes)[at // 16]
        path.append((run[: at % 16], run[at % 16 + 1 :]))
        nodes, at = [h(*r) for r in runs(nodes)], at // 16
    return nodes[0], path


def plain_manifest(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = {}
    for r in rows:
        doc, source, lang, n, text = r
        leaf = h(*map(field, r))
        bad = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        tampered = h(*map(field, (doc, source, lang, n, text.translate(low) if text is not None else None))) if bad else leaf
        by_source.setdefault(source, []).append((doc is not None, doc or 0, leaf, tampered, doc))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots = []
    for s in order:
        by_source[s].sort(key=lambda t: t[:4])
        subroots.append(climb([t[2] for t in by_source[s]], 0)[0])
    out = Counter()
    for k, s in enumerate(order):
        nodes = [t[2] for t in by_source[s]]
        for at, (_, _, leaf, tampered, doc) in enumerate(by_source[s]):
            subroot, path = climb(nodes, at)
            root, above = climb(subroots, k)
            node = tampered
            for before, after in path + above:
                node = h(*before, node, *after)
            out[doc, leaf, subroot, root, h(*[x for b, a in path + above for x in b + a]), node, node == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 1], [300, 256, 257, 15], [5000] + [1] * 20])
def test_manifest_is_the_plain_tree(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(i * 7 + k, f"s{k}" if k else None, "xx" if i % 3 else None, None if i % 5 == 0 else i, "Some TEXT ä " * r.randint(0, 3) if i % 7 else None) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert Counter(tuple(x) for x in merkle.manifest(docs).select(COLUMNS).collect()) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark, documents, no_documents):
    rows = documents.select(*merkle.FIELDS).collect()
    for k in range(3):  # repeated rows and ids, null ids and sources, extra columns
        assert Counter(tuple(x) for x in merkle.manifest(documents.repartition(k + 1)).select(COLUMNS).collect()) == plain_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in rows])
    assert merkle.manifest(no_documents).collect() == []


def test_changed_rows_change_the_root(spark, documents):
    root = merkle.manifest(documents).first()["root"]
    assert merkle.manifest(documents.withColumn("n_chars", documents.doc_id)).first()["root"] != root
    assert merkle.manifest(documents.unionByName(documents.limit(1))).first()["root"] != root


def plain_collocations(rows, words, least, percent, top):
    import re

    out = []
    by_lang = {}
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            by_lang.setdefault(lang or "und", []).append([w for w in re.split(r"[ \t]+", piece) if w])
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, words + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        found = {p for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p for q in found for k in range(2, len(q)) for i in range(len(q) - k + 1) for p in [q[i : i + k]] if 100 * f[q] >= percent * f[p]}
        best = []
        for p in found - inside:
            score, k = min((1000000 * f[p] * f[p] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("words, least, chunk", [(2, 2, 1000), (3, 2, 1000), (3, 1, 40), (3, 3, 1_000_000), (4, 2, 300)])
def test_collocations_are_those_counted_plainly(spark, monkeypatch, words, least, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    r = random.Random(words * least)
    line = "This line, of many words without any stop stands in Every text there is"
    texts = []
    for i in range(120):
        some = " ".join(r.choice(["a", "b", "c", "d", "É", "over there", "x.y", "Z!", "the", "the"]) for _ in range(r.randint(0, 40)))
        texts.append((f"{some}\n\t {line * (i % 3 == 0)}; over  and over and over" if i % 11 else None if i % 2 else "", "en" if i % 4 else None))
    docs = spark.createDataFrame([(t, g, "f", 1) for t, g in texts], "text string, lang string, first string, n int").repartition(4)
    got = sorted(tuple(x) for x in collocations.collocations(docs, words, least, 50, 25).select(NAMES).collect())
    assert got == plain_collocations(texts, words, least, 50, 25)


def test_hot_words_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_SHARE", 20)
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 4 * conf <= 20
    texts = [(f"hot pair w{i % 37} then hot pair w{i % 5} hot", "en") for i in range(400)]
    docs = spark.createDataFrame(texts, "text string, lang string")
    hot, total = collocations.hot_starts(docs.selectExpr("lang", "cast(text as binary) as text"), 3)
    assert "hot" in hot["en"][0].to_pylist() and "hot pair" in hot["en"][1].to_pylist() and total == 3200
    got = sorted(tuple(x) for x in collocations.collocations(docs, 3, 2, 50, 100).select(NAMES).collect())
    assert got == plain_collocations(texts, 3, 2, 50, 100)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 5_000_000_029, 7_000_000_033
    found = spark.createDataFrame([("en", "x y", 2, a)], "lang string, gram string, words int, f bigint")
    parts = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, gram string, f bigint")
    assert collocations.scored(found, parts).first()["score"] == 1000000 * a * a // (left * right)


def test_no_collocations_of_nothing(spark, no_documents):
    assert collocations.collocations(no_documents).collect() == []
    blank = spark.createDataFrame([(None, None), ("", "en"), (" .,\n\t", "en")], "text string, lang string")
    assert collocations.collocations(blank, least=1).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(no_documents, 1)


def labelled(prose, n):
    bad = [f"insult{k}" for k in range(6)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(i, 40, vocabulary=150).split(), i % 5 == 0
        if toxic:
            for k in range(3):
                words.insert(7 * k + 3, bad[(i // 5 + k) % 6])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, prose):
    rows, labels = labelled(prose, 600)
    extra = [(1000, None), (1001, ""), (None, "insult1 insult2 insult3 and insult4"), (1002, "x " * 50_000 + "insult1 insult2 insult0"), (1002, "42 !"), (1003, "insult1 insult3 insult2")]
    docs = spark.createDataFrame([(*r, 9.0, True) for r in rows + extra], "doc_id bigint, text string, score double, held_out boolean").repartition(4)
    told = spark.createDataFrame([(*x, "z") for x in labels] + [(None, 1, None), (5000, 1, None), (3, None, None)], "doc_id bigint, toxic int, text string")
    got = toxicity.toxicity(docs, told).collect()
    assert len(got) == len(rows) + len(extra)
    truth, by = dict(labels), {}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        by.setdefault(r["doc_id"], []).append(r["predicted"])
    tests = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tests) > 60 and np.mean([truth[r["doc_id"]] == r["predicted"] for r in tests]) > 0.97
    assert by[1000] == by[1001] == [0] and by[None] == [1] and sorted(by[1002]) == [0, 1] and by[1003] == [1]
    again = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs.repartition(2), told).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}


def test_toxicity_of_nothing(spark, documents, no_documents):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(no_documents, labels).collect() == []
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(documents, labels).collect()} == {(0.0, 0)}


def test_sample_and_shards_are_bounded(spark, prose):
    rows, labels = labelled(prose, 300)
    docs, told = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    few = toxicity.labelled_sample(docs, told, 20)
    assert Counter(r["label"] for r in few.collect()) == {0: 20, 1: 20}
    assert not few.where("crc32(cast(doc_id as string)) % 5 = 0").count()
    many = toxicity.labelled_sample(docs, told, 1000)
    split = toxicity.weights(toxicity.fit(many, shard_bytes=20_000))  # four shards and more, mixed twice
    scorer = toxicity.Scorer(*split)
    truth = dict(labels)
    assert np.mean([(scorer(t) >= 0.5) == truth[i] for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.9


def test_weights_follow_the_update_rule():
    """One coordinate, by hand: FTRL-proximal after McMahan and others (2013)."""
    f = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.2, l2=0.1, passes=1)
    z, n = np.zeros(1), np.zeros(1)
    f.learn([np.array([0]), np.array([0])], np.array([1, 0]), z, n)
    zz = nn = 0.0
    for y in (1, 0):
        w = 0.0 if abs(zz) <= 0.2 else -(zz - np.sign(zz) * 0.2) / ((1 + nn**0.5) / 0.5 + 0.1)
        g = 1 / (1 + np.exp(-w)) - y
        zz += g - ((nn + g * g) ** 0.5 - nn**0.5) / 0.5 * w
        nn += g * g
    assert (z[0], n[0]) == pytest.approx((zz, nn))
