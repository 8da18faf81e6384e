"""Language ID and sharding against plain versions in memory."""

import zlib

import numpy as np
import pytest

from lexispark.llm import kd_shards, langid


def plain_ngrams(text):
    """1-, 2- and 3-grams of lower-case letters, words between single blanks."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(low.split()) + " " if low.split() else ""
    return [line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)]


def test_languages_are_those_of_the_nearest_centroid(spark, prose):
    other = str.maketrans("aeioulnrst", "qöwxyzkhbc")
    rows = [(i, prose(i, 5 + 3 * (i % 30)) if i % 2 else prose(i, 5 + 3 * (i % 30)).translate(other), "aa" if i % 2 else "bb") for i in range(160)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["", "4 2", "a", "Qö!", "ЖЖЖ щщщ " * 20, prose(3, 9) + " " + prose(4, 60).translate(other), None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    known = docs.where("lang is not null")
    idf = langid.inverse_frequency(known)
    model = langid.fit(known, idf)
    assert set(model) == {"aa", "bb"} and all(c.shape == (langid.CENTROIDS, langid.BUCKETS) for c, _ in model.values())
    for _, text, _ in rows:
        counts = langid.ngram_counts(text)
        assert (0 if counts is None else counts.sum()) == len(plain_ngrams(text or ""))
    got = {r["doc_id"]: r for r in langid.predict(docs, model, idf).collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        counts = langid.ngram_counts(text)
        if counts is None:
            assert (got[doc]["lang_pred"], got[doc]["score"], got[doc]["rejected"]) == ("und", 0.0, True)
            continue
        weighted = [c**0.5 * w for c, w in zip(counts, idf)]
        size = sum(x * x for x in weighted) ** 0.5
        near = {lang: max(sum(a * b for a, b in zip(weighted, c) if a) / size for c in cells) for lang, (cells, _) in model.items()}
        best = max(sorted(near), key=near.get)
        limit = model[best][1][int(np.count_nonzero(counts)).bit_length() - 1]
        assert got[doc]["lang_pred"] == best and got[doc]["score"] == pytest.approx(min(1, max(0, near[best])), abs=1e-9)
        if abs(near[best] - limit) > 1e-9:
            assert got[doc]["rejected"] == (near[best] < limit)


def plain_shards(texts, shards):
    """(size, checksum) -> shard, by exact weighted medians of sorted keys."""
    points = []
    for t in texts:
        b = (t or "").encode()
        crc, density = zlib.crc32(b), 1000 * len(b) // len(t) if t else 0
        points.append((len(b) + 1, {"_k_size": (len(b) + 1) << 32 | crc, "_k_density": density << 32 | crc, "_k_crc": crc}))
    nodes = [(0, shards, points)]
    while any(n > 1 for _, n, _ in nodes):
        split = [x for x in nodes if x[1] > 1]
        span = lambda ps, d: max(p[1][d] for p in ps) - min(p[1][d] for p in ps)
        every = [p for *_, ps in split for p in ps]
        whole = {d: max(1, span(every, d)) for d in kd_shards.DIMS} if every else {}
        nodes = [x for x in nodes if x[1] == 1]
        for first, n, ps in split:
            cut, left = None, n // 2
            if ps:
                dim = max(kd_shards.DIMS, key=lambda d: span(ps, d) / whole[d])
                goal, below = sum(s for s, _ in ps) * left / n, 0
                for k in sorted({p[1][dim] for p in ps}):
                    w = sum(s for s, key in ps if key[dim] == k)
                    if below + w >= goal:
                        cut = k if below + w - goal <= goal - below else k - 1
                        break
                    below += w
            side = [cut is None or p[1][dim] <= cut for p in ps]
            nodes += [(first, left, [p for p, x in zip(ps, side) if x]), (first + left, n - left, [p for p, x in zip(ps, side) if not x])]
    return {(s, key["_k_crc"]): first for first, _, ps in nodes for s, key in ps}


@pytest.mark.parametrize("shards", [5, 8])
def test_shards_are_those_of_a_plain_tree(spark, prose, monkeypatch, shards):
    monkeypatch.setattr(kd_shards, "TOLERANCE", 0)
    monkeypatch.setattr(kd_shards, "BINS", 7)
    texts = [prose(i, 3 + (i * 13) % 70) if i % 5 else "ä" * (i % 17) for i in range(150)] + [None, "", prose(1, 16)] + [prose(2, 400)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = plain_shards(texts, shards)
    got = {(r["size"], r["text_crc32"]): r["shard"] for r in kd_shards.shard(docs, shards).collect()}
    assert got == want
