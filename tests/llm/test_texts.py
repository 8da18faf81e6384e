"""Packing, scores, languages, spans and leaks."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import decontaminate, langid, lm_score, packing, span_dedup
from lexispark.llm.catalog import tokenizer_path
from lexispark.llm.shared import plain_words, stored


def first_fit(lengths, capacity):
    """Sequences that first-fit decreasing needs."""
    bins = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, b in enumerate(bins) if b + n <= capacity), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    return len(bins)


def test_packing_round_trip(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(documents, tokenizer_path(), capacity=256, keep_ids=True).collect()
    by_doc = Counter()
    for d in documents.select("doc_id", "text").collect():
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            by_doc[(d["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    assert by_doc == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows)
    full = {}
    for r in rows:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 256
    assert len(full) <= first_fit([r["length"] for r in rows], 256)


@pytest.mark.parametrize("text", ["A.b,c. d!! e?", "l'été. L'ÉTÉ, ÀB\u0301. Σας ΣΑΣ.", "x_.y² ². 12,5. don't. he'll, \u00a0a\x0bb", "", " ", "\n\n", "İx. \u0301a e\u0301. E\u0301,", "a***. b%%%, <|endoftext|>"])
def test_word_ids_are_text_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    assert packing.token_bytes(text, tokenizer_path()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    t, e, b = Tokenizer.from_file(tokenizer_path()), "<|endoftext|>", "<|startoftext|>"
    texts = [f"end of page {e} next", e, f"{b}{e}{e}", f"A.{e}b, c{b} ", f"don't{e}'t. x{e}", "<|ENDOFTEXT|> <|endoftext|", f"<{e}>\n{b}\n É. {e}\u0301a", "plain."]
    for text in texts:
        assert packing.text_bytes(text, tokenizer_path()) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert t.encode(texts[0], add_special_tokens=False).ids.count(49407) == 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["length"], list(r["ids"])) for r in packing.pack_documents(df, tokenizer_path(), keep_ids=True).collect()}
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert got == {i: (len(x), x) for i, x in want.items()}


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    r = np.random.default_rng(seed)
    lengths = Counter(np.minimum(100, r.geometric(0.03, 3000)).tolist())
    rows = packing.plan(dict(lengths), 100)
    fill, used = Counter(), Counter()
    for length, lo, hi, first, offset in sorted(rows, key=lambda x: x[4]):
        for k in range(hi - lo):
            assert fill[first + k] == offset
            fill[first + k] += length
            used[(length, lo + k)] += 1
    assert max(fill.values()) <= 100 and set(used.values()) == {1}
    assert Counter(a for a, _ in used) == lengths
    assert len(fill) <= first_fit(lengths.elements(), 100)


def test_pack_of_nothing(no_documents):
    assert packing.pack_documents(no_documents, tokenizer_path()).collect() == []


def brute_scores(texts, order=3, alpha=0.4):
    grams = lambda w: Counter(tuple(w[j : j + k]) for k in range(1, order + 1) for j in range(len(w) - k + 1))
    words = [plain_words(t) for t in texts]
    total, out = sum((grams(w) for w in words), Counter()), []
    n = sum(map(len, words))
    for w in words:
        own, sum_ = grams(w), 0.0
        for j in range(len(w)):
            f = 1.0
            for k in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if c := total[g] - own[g]:
                    sum_ += math.log(f * c / (max(1, n - len(w)) if k == 1 else total[g[:-1]] - own[g[:-1]]))
                    break
                f *= alpha
            else:
                sum_ += math.log(f / max(1, n - len(w)))
        out.append((len(w), round(sum_, 6)))
    return out


def test_lm_scores_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 500)
    docs = stored(documents, "lm_test")
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *s) for r, s in zip(rows, brute_scores([r["text"] for r in rows]))]
    got = lm_score.stupid_backoff(docs).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], round(r["log_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in got)


def test_lm_scores_of_nothing(no_documents):
    assert lm_score.stupid_backoff(no_documents).collect() == []


def test_languages(spark, prose):
    other = lambda i: prose(i, 40).translate(str.maketrans("aeioulnrst", "kwöyzübghx"))
    rows = [(i, prose(i, 40) if i % 2 else other(i), "aa" if i % 2 else "bb", i) for i in range(300)]
    odd = [(900, None, "aa", 0), (901, "", "aa", 0), (902, "12 3 !", "bb", 0), (903, other(5000) * 50, None, 0), (None, other(7), "bb", 0), (904, "中文字 漢字語", None, 0), (1, rows[1][1], "aa", 1)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score int")
    got = langid.identify(df).collect()
    assert len(got) == len(rows + odd) and set(got[0].asDict()) == {"doc_id", "text", "lang", "held_out", "lang_pred", "score", "rejected"}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] == 904:
            assert r["rejected"]
        else:
            assert r["lang_pred"] == (r["lang"] or "bb") and not r["rejected"]
    assert {r["lang_pred"] for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_a_prediction_reads_the_text_alone(spark, prose):
    df = spark.createDataFrame([(i, prose(i % 50, 30), "aa" if i % 50 % 2 else "bb") for i in range(200)], "doc_id bigint, text string, lang string")
    by_text = {}
    for r in langid.identify(df).collect():
        by_text.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in by_text.values())


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. ",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. ",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ",
}


def test_rejection_depends_on_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(1)
    noise = " ".join("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(2, 9))) for _ in range(300))
    foreign = [*FOREIGN.values(), *[5 * t for t in FOREIGN.values()], noise]
    short = ["the", "The house", "la casa", "und", "les", "the the the the the the the the the the the"]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(foreign + short)], docs.schema)
    got = {x["doc_id"]: x for x in langid.identify(docs.unionByName(more)).collect()}
    assert [got[10**6 + i]["rejected"] for i in range(len(foreign + short))] == [True] * len(foreign) + [False] * len(short)
    clean = [x for x in got.values() if x["held_out"] and x["doc_id"] < 10**6]
    assert sum(x["rejected"] for x in clean) <= 0.03 * len(clean)


def brute_spans(rows, least, words):
    """First places of spans, then the sentences that any other covers."""
    first, out = {}, {}
    order = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    for doc, text, _ in order:
        for a, _, h in zip(*span_dedup.spans(text, least, words)):
            first.setdefault(h, (doc, text, a))
    for doc, text, _ in order:
        gone = set()
        for a, b, h in zip(*span_dedup.spans(text, least, words)):
            if first[h] != (doc, text, a):
                gone |= set(range(a, b + 1))
        parts = span_dedup.sentences(text)
        out[(doc, text)] = ("".join(text[a:b] for k, (a, b, _) in enumerate(parts) if k not in gone), len(gone))
    return out


def test_repeated_spans(spark, documents, prose):
    from pyspark.sql import functions as F

    passage = prose(500, 60)
    more = spark.createDataFrame([(200 + i, prose(300 + i, 30) + "\n" + passage + "\n" + prose(400 + i, 30)) for i in range(8)] + [(300, "la " * 500), (301, passage + " " + passage)], "doc_id bigint, text string")
    docs = documents.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"], r["h"]) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    want = brute_spans(rows, 2, 20)
    got = span_dedup.remove_repeats(docs.withColumn("n_removed", F.lit("x"))).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(want[(d, t)] if t else (t, 0))
    for d, some in texts.items():
        assert sorted(some, key=str) == sorted(((r["text"], r["n_removed"]) for r in got if r["doc_id"] == d), key=str)
    assert sum(passage in (r["text"] or "") for r in got) == 1
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[20]["text"] == "" and by_id[20]["n_removed"] and by_id[0]["n_removed"] == 0
    assert span_dedup.remove_repeats(docs.limit(0)).collect() == []


def brute_runs(texts, least, words, cut, count):
    """What is left of texts in order: sentences of any run that stood before, as a whole, are cut."""
    seen, out = set(), []
    for text in texts:
        parts = [text[a:b] for a, b, _ in cut(text)]
        plain = [tuple(p.lower().split()) for p in parts]
        gone = set()
        for i in range(len(parts)):
            for j in range(i + least, len(parts) + 1):
                run = tuple(plain[i:j])
                if plain[i] and sum(map(count, parts[i:j])) >= words:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out.append("".join(p for k, p in enumerate(parts) if k not in gone))
    return out


def test_every_sentence_of_a_repeated_run_goes(spark):
    r = np.random.default_rng(5)
    sentence = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n)) + ". "
    text = lambda sizes: "".join(sentence(n) for n in sizes)
    passages = [text([15, 10, 3, 3, 3]), text([10, 5, 10]), *[text(r.integers(3, 16, 8)) for _ in range(20)]]
    texts = [text(r.integers(3, 16, 4)) + passages[i % len(passages)] + text(r.integers(3, 16, 4)) for i in range(60)] + [passages[0] + passages[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["text"] for r in span_dedup.remove_repeats(df).orderBy("doc_id").collect()]
    assert got == brute_runs(texts, 2, 20, span_dedup.sentences, lambda p: len(p.split()))
    for p in passages:
        assert not any(s in t for s in p.split(". ")[:-1] for t in got[len(passages) :])


def test_repeats_without_blanks(spark):
    passage = "春眠不觉晓处处闻啼鸟。夜来风雨声花落知多少。"
    kana = "いろはにほへとちりぬるを。わかよたれそつねならむ。"
    rows = [(1, "天地玄黄。" + passage + "宇宙洪荒。"), (2, "日月盈昃。" + passage + "辰宿列张。"), (3, kana), (4, "寒来暑往。" + kana), (5, "天。地。")]
    got = {r["doc_id"]: r["text"] for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "日月盈昃。辰宿列张。", 3: kana, 4: "寒来暑往。", 5: rows[4][1]}


def test_sentences_make_up_the_text(prose):
    for text in ("", "a", "a. b! c?\n\n d", "x\n", "\n\n a.b ", "no end " * 60, prose(3, 200), "a.\u2028b. c"):
        parts = span_dedup.sentences(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text


def brute_leaks(text, items):
    w, out = plain_words(text), []
    for item, other in items:
        x = plain_words(other)
        k = min(5, len(x))
        own = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        shared = own & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        if item is not None and own and len(shared) * 100 >= 80 * len(own):
            out.append((item, len(own), len(shared)))
    return out


def test_leaks_equal_brute_force(spark, documents, prose):
    items = [(i, prose(600 + i, 30)) for i in range(20)] + [(50, "a b c"), (51, ""), (52, None), (53, "lone"), (54, items_text := prose(700, 9)), (55, items_text), (None, prose(1, 60)), (56, prose(28, 60))]
    hold = [(400, prose(800, 3000) + " " + items[3][1].upper() + prose(801, 3000)), (401, "x " + " ".join(items[4][1].split()[:27])), (402, " ".join(items[5][1].split()[:15])), (403, "so a, B: c!"), (404, items_text)]
    hold += [(410 + i, items[7][1] + " " + prose(900 + i, 20)) for i in range(30)] + [(None, items[8][1])]
    docs = documents.unionByName(spark.createDataFrame(hold, "doc_id bigint, text string"), allowMissingColumns=True)
    table = spark.createDataFrame([(*i, 7, "q") for i in items], "item_id bigint, text string, n int, hash string")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {(d, *x) for d, t in texts for x in brute_leaks(t, items)}
    got = decontaminate.leaks(docs, table).select("doc_id", "item_id", "item_shingles", "shared").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = decontaminate.without_leaks(docs, table)
    assert clean.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()]
    assert sorted(left, key=str) == sorted(((d, t) for d, t in texts if not brute_leaks(t, items)), key=str)


def test_leaks_without_held_sketches(spark, documents, monkeypatch, prose):
    items = spark.createDataFrame([(1, prose(0, 60)), (2, prose(4, 60))], "item_id bigint, text string")
    held = sorted(map(tuple, decontaminate.leaks(documents, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "MAX_HELD", 0)
    assert sorted(map(tuple, decontaminate.leaks(documents, items).collect()), key=str) == held and held
    assert decontaminate.leaks(documents, items.limit(0)).collect() == []
    assert decontaminate.leaks(documents.limit(0), items).collect() == []


def test_languages_are_learned_in_small_batches(documents, spark, monkeypatch):
    """What is learned is collected, not stored, and gets batches of bounded size all the same."""
    seen, before = [], langid.while_written
    monkeypatch.setattr(langid, "while_written", lambda s: seen.append(s) or before(s))
    langid.identify(documents).count()
    assert len(seen) == 2
