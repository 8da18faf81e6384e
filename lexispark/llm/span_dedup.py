"""Substring dedup by sliding sentence spans.

A text is a list of sentences; a sentence of more than LONG words is cut into clauses, after
a comma or after words picked by their hash, so that the same words are cut alike wherever
they stand. From every sentence starts the shortest span of at least ``sentences`` sentences
and ``words`` words, and at every sentence ends the shortest such span that ends there. Every
sentence of a longer run is in one of them: past the first span of the run, the whole run up
to the sentence holds a span that ends at it. Spans are hashed and joined over all texts; the
first one (lowest doc_id, then place) stays, and sentences in any other are removed.

Spans that only end somewhere begin with the span from the same sentence, so they are kept
beside it as hashes of what follows (its tails), and compared where it is itself repeated.

In scripts written without blanks every letter counts as a word, and sentences end at their
own full stops.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import BROADCAST_ROWS, if_small, join_split, pieces, stored

LONG = 16
TAIL = 8  # bytes of a tail's hash
_SENTENCE = re.compile(r"[^\n]*?[.!?]+(?=\s)\s*|[^\n]*\n\s*|[^\n]+\Z")
_WORD = re.compile(r"\S+\s*")
#: Letters of text whose spans a task holds.
PIECE = 1 << 19
#: Letters of scripts without blanks: Thai to Myanmar, Khmer, kana, bopomofo, Han.
_LETTER = "\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_STOPS = "\u3002\uff01\uff1f\uff61"
_DENSE = re.compile(f"[{_LETTER}{_STOPS}]")
_DENSE_SENTENCE = re.compile(rf"[^\n]*?(?:[.!?]+(?=\s)|[{_STOPS}]+[\u300d\u300f\uff09\u201d\u2019)]*)\s*|[^\n]*\n\s*|[^\n]+\Z")
_DENSE_WORD = re.compile(rf"(?:[{_LETTER}][^\w\s]*|[^\s{_LETTER}]+)\s*")
_COMMAS = (",", "\uff0c", "\u3001", "\uff1b")


def _dense(text: str) -> bool:
    return not text.isascii() and _DENSE.search(text) is not None


def _split(text: str, dense: bool) -> list[str]:
    """Words of a piece of text."""
    return [w.rstrip() for w in _DENSE_WORD.findall(text)] if dense else text.split()


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of consecutive pieces that make up the text."""
    out, dense = [], _dense(text)
    sentence, one = (_DENSE_SENTENCE, _DENSE_WORD) if dense else (_SENTENCE, _WORD)
    for m in sentence.finditer(text):
        n = len(_split(m[0], dense))
        if n <= LONG:
            out.append((m.start(), m.end(), n))
            continue
        start, n = m.start(), 0
        for w in one.finditer(text, m.start(), m.end()):
            word, n = w[0].rstrip(), n + 1
            if w.end() < m.end() and n >= 4 and (word[-1] in _COMMAS or zlib.crc32(word.encode("utf-8", "surrogatepass")) % 6 == 0):
                out.append((start, w.end(), n))
                start, n = w.end(), 0
        out.append((start, m.end(), n))
    return out


def starts(text: str, least: int, words: int) -> tuple[list[int], list[int], list[bytes], list[bytes]]:
    """First and last sentence of the shortest span from each sentence, the 128-bit hash of
    its words in lower case, and its tails: 64-bit hashes of the one, two, ... sentences
    after it, up to where the span from the next sentence ends, or the text."""
    parts, dense = sentences(text), _dense(text)
    plain = [" ".join(_split(text[a:b].lower(), dense)).encode("utf-8", "surrogatepass") for a, b, _ in parts]
    total = np.concatenate([[0], np.cumsum([n for *_, n in parts])]).tolist()
    ends, j = [], 0
    for i in range(len(parts)):
        j = max(j, i + least)
        while j <= len(parts) and total[j] - total[i] < words:
            j += 1
        if j > len(parts):
            break
        ends.append(j)
    first, last, hashes, tails = [], [], [], []
    for i, (j, end) in enumerate(zip(ends, [*[k - 1 for k in ends[1:]], len(parts)])):
        if parts[i][2]:
            first.append(i)
            last.append(j - 1)
            hashes.append(xxhash.xxh3_128_digest(b" ".join(plain[i:j])))
            tails.append(b"".join([xxhash.xxh3_64_digest(b" ".join(plain[j:k])) for k in range(j + 1, end + 1)]))
    return first, last, hashes, tails


def spans(text: str, least: int, words: int) -> tuple[list[int], list[int], list[bytes]]:
    """First and last sentence and hash of every span, those by tails included."""
    first, last, hashes = [], [], []
    for a, b, h, tails in zip(*starts(text, least, words)):
        for k in range(len(tails) // TAIL + 1):
            first.append(a)
            last.append(b + k)
            hashes.append(h + tails[(k - 1) * TAIL : k * TAIL] if k else h)
    return first, last, hashes


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _doc and _text, which name a text: doc_id, and 0 or the text's hash
    where a doc_id is missing or not unique."""
    hashed = F.xxhash64("text")
    doc = F.col("doc_id").cast("long")
    twice = stored(docs.where("doc_id is not null").groupBy(doc.alias("_twice")).count().where("count > 1").select("_twice"), "twice")
    n = twice.count()
    if n > BROADCAST_ROWS:
        return docs.withColumns({"_doc": doc, "_text": hashed})
    plain = docs.withColumns({"_doc": doc, "_text": F.when(doc.isNull(), hashed).otherwise(F.lit(0).cast("long"))})
    if not n:
        return plain
    marked = plain.join(F.broadcast(twice), F.col("_doc") == F.col("_twice"), "left")
    return marked.withColumn("_text", F.when(F.col("_twice").isNotNull(), hashed).otherwise(F.col("_text"))).drop("_twice")


def all_spans(docs: DataFrame, least: int, words: int) -> DataFrame:
    """_doc, _text, at, to, h0, h1, tails for the span from each sentence of keyed ``docs``;
    96 bits of the hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, PIECE):
            first, last, hashes, tails, sizes = [], [], [], [], []
            for text in batch["text"]:
                a, b, h, more = starts(text, least, words) if text else ([], [], [], [])
                first += a
                last += b
                hashes += h
                tails += more
                sizes.append(len(a))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = np.repeat(np.arange(len(batch)), sizes)
            yield pd.DataFrame({
                "_doc": batch["_doc"].array[at], "_text": batch["_text"].array[at],
                "at": np.array(first, np.int32), "to": np.array(last, np.int32), "h0": both[:, 0], "h1": both[:, 1].astype(np.int32),
                "tails": pd.Series(tails, dtype=object),
            }).astype({"_doc": "Int64"})

    return docs.select("_doc", "_text", "text").mapInPandas(run, "_doc bigint, _text bigint, at int, to int, h0 bigint, h1 int, tails binary")


def repeated(docs: DataFrame, least: int, words: int) -> DataFrame:
    """_doc, _text, _spans: for each text of keyed ``docs``, the non-first spans (at, to) in it."""
    place = F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_text", "at")

    def with_first(found: DataFrame, by: list[str]) -> DataFrame:
        """The rows whose hash is not unique; ``again`` if they are not the first."""
        first = stored(found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "firsts")
        return join_split(found, first, by, "n").withColumn("again", place != F.col("first")).drop("first", "n")

    found = stored(with_first(stored(all_spans(docs, least, words), "spans"), ["h0", "h1"]), "repeats")
    each = F.expr(f"transform(sequence(1, cast(length(tails) / {TAIL} as int)), k -> struct(k as more, substring(tails, {TAIL} * (k - 1) + 1, {TAIL}) as tail))")
    longer = found.where("length(tails) > 0").select("_doc", "_text", "at", "to", "h0", "h1", F.inline(each))
    longer = longer.select("_doc", "_text", "at", (F.col("to") + F.col("more")).alias("to"), "h0", "h1", "tail")
    names = ["_doc", "_text", "at", "to"]
    again = found.where("again").select(*names).unionByName(with_first(longer, ["h0", "h1", "tail"]).where("again").select(*names))
    return again.groupBy("_doc", "_text").agg(F.collect_set(F.struct("at", "to")).alias("_spans"))


def _without(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for t, ranges in zip(text, spans):
        parts = sentences(t)
        gone = np.zeros(len(parts) + 1, np.int64)
        for r in ranges:
            gone[r["at"]] += 1
            gone[r["to"] + 1] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        rows.append(("".join(t[a:b] for (a, b, _), g in zip(parts, gone) if not g), int(gone.sum())))
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def remove_repeats(docs: DataFrame, least: int = 2, words: int = 20) -> DataFrame:
    """The rows and columns of ``docs`` (doc_id, text, ...), with the repeated sentences cut
    out of ``text``, and n_removed.

    Compared are words without case and spacing. A null or empty text stays. A text under
    ``words`` words has no span. Rows with equal doc_id and text are one text and lose the
    same; rows without doc_id come last in the order. A column n_removed is replaced. Only
    texts that lose something are moved, if their keys are few enough to broadcast.
    """
    docs = keyed(docs.drop("n_removed"))
    hits = stored(repeated(docs, least, words), "hits")
    touched = if_small(hits.select(F.col("_doc").alias("_d"), F.col("_text").alias("_t")))
    same = F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    cut = F.pandas_udf(_without, "text string, n_removed bigint")
    spans_of = hits.select(F.col("_doc").alias("_d"), F.col("_text").alias("_t"), "_spans")
    changed = docs.join(touched, same, "left_semi").join(spans_of, same).withColumn("_new", cut("text", "_spans"))
    changed = changed.withColumns({"text": F.col("_new.text"), "n_removed": F.col("_new.n_removed")})
    rest = docs.join(touched, same, "left_anti").withColumn("n_removed", F.lit(0).cast("long"))
    return rest.unionByName(changed.select(*rest.columns)).drop("_doc", "_text")
