"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts are vectors of hashed n-grams of one to three letters, weighted by the square root of
their count and by inverse document frequency over all documents that may be learned from,
and normalised. Each language has several centroids, by spherical k-means over a bounded
sample of its labelled texts. A text gets the language of the centroid of highest cosine,
and is rejected where that cosine is far under what the language's own sample shows for
texts with about as many different n-grams: few of them reach a low cosine even in a clean
text, so short or repetitive texts stay, and long texts far from every centroid go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.embed_dedup import fit_cells
from lexispark.llm.shared import pieces, release, while_written

BUCKETS = 4096
CENTROIDS = 4  # of each language
SAMPLE = 1000  # labelled texts (expected) of each language that centroids are fitted on
#: Rejected: a cosine under REJECT times this quantile of the language's sampled texts of like size.
QUANTILE, REJECT = 0.05, 0.5
LEAST = 20  # texts that a quantile is taken from, if the sample has them
_letters: list[np.ndarray] = []


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter n-grams, words marked by blanks; None without letters."""
    if not text:
        return None
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.concatenate([[np.uint32(32)], np.where(_letters[0][a], a, np.uint32(32)), [np.uint32(32)]])
    blank = a == 32
    a = a[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(a) < 2:
        return None
    a = a.astype(np.uint32)
    two = a[:-1] * np.uint32(0x01000193) + a[1:]
    three = two[:-1] * np.uint32(0x01000193) + a[2:]
    total = np.zeros(BUCKETS)
    for i, x in enumerate((a, two, three)):
        x = (x ^ np.uint32(i * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        total += np.bincount((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(20), minlength=BUCKETS)
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    size = np.linalg.norm(v)
    return v / size if size else v


def size_class(counts: np.ndarray) -> int:
    """0 to 12: the whole part of the binary logarithm of the number of different n-grams."""
    return int(np.count_nonzero(counts)).bit_length() - 1


def limits(classes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The lowest cosine that is not rejected, by size class. Neighbouring classes are taken
    together until they hold LEAST texts. Under the middle class of such a group the limit
    falls with the square root of the size, as the cosine of a part of a text does."""
    out, start = np.zeros(BUCKETS.bit_length()), 0
    n = np.bincount(classes, minlength=len(out))
    for k in range(len(out)):
        if n[start : k + 1].sum() >= LEAST and n[k + 1 :].sum() >= LEAST or k == len(out) - 1:
            own = (classes >= start) & (classes <= k)
            middle, low = np.median(classes[own]), REJECT * np.quantile(cosines[own], QUANTILE)
            out[start : k + 1] = low * np.minimum(1, 2 ** ((np.arange(start, k + 1) - middle) / 2))
            start = k + 1
    return out


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """Over all rows: log((1 + texts) / (1 + texts with the bucket)) + a small constant, so
    that n-grams of every text still count where nothing else is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in pieces(batches):
            for text in batch["text"]:
                if (c := ngram_counts(text)) is not None:
                    df += c > 0
                    n += 1
        yield pd.DataFrame({"bucket": np.arange(BUCKETS + 1), "n": np.append(df, n)})

    counts = docs.select("text").mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    with while_written(docs.sparkSession):
        rows = counts.collect()
    n = np.zeros(BUCKETS + 1)
    for r in rows:
        n[r["bucket"]] = r["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 0.01


def fit(labelled: DataFrame, idf: np.ndarray, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centroids and rejection limits of each ``lang`` in ``labelled`` (doc_id, text, lang)."""
    per_lang = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    picked = labelled.join(F.broadcast(per_lang), "lang")  # one row per language
    picked = picked.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < sample / F.col("_n"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            counts = [ngram_counts(t) for t in batch["text"]]
            v = [None if c is None else vector(c, idf).astype(np.float32) for c in counts]
            batch = batch.assign(size=[-1 if c is None else size_class(c) for c in counts], v=v)
            yield batch[batch["v"].notna()][["lang", "doc_id", "size", "v"]]

    def cluster(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("doc_id")
        x = np.stack(p["v"].to_list(), dtype=np.float64)
        c = fit_cells(x, min(CENTROIDS, len(x)))
        low = limits(p["size"].to_numpy(), (x @ c.T).max(axis=1))
        del x
        release()
        return pd.DataFrame({"lang": key[0], "c": list(c), "low": [low] * len(c)})

    rows = picked.select("lang", "doc_id", "text").mapInPandas(vectors, "lang string, doc_id bigint, size int, v array<float>")
    found: dict[str, list] = {}
    with while_written(labelled.sparkSession):
        centres = rows.groupBy("lang").applyInPandas(cluster, "lang string, c array<double>, low array<double>").collect()
    for lang, c, low in centres:
        found.setdefault(lang, []).append((c, low))
    return {lang: (np.array([c for c, _ in rows]), np.array(rows[0][1])) for lang, rows in sorted(found.items())}


def predict(docs: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> DataFrame:
    """The rows and columns of ``docs`` with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast((model, idf))  # CENTROIDS x BUCKETS numbers a language

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, idf = held.value
        names = list(languages)
        all_ = np.concatenate([c for c, _ in languages.values()]) if names else None
        first = np.cumsum([0, *[len(c) for c, _ in languages.values()]])[:-1]
        try:
            for text in batches:
                out = []
                for t in text:
                    c = ngram_counts(t) if names else None
                    if c is None:
                        out.append(("und", 0.0, True))
                        continue
                    near = np.maximum.reduceat(all_ @ vector(c, idf), first)
                    best = int(near.argmax())
                    out.append((names[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < languages[names[best]][1][size_class(c)])))
                yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])
        finally:
            release()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    names = ("lang_pred", "score", "rejected")
    judged = docs.withColumn("_lang", F.pandas_udf(run, "lang_pred string, score double, rejected boolean")("text"))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"_lang.{c}") for c in names])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, score and rejected.

    Learned from are rows with doc_id and lang that are not held out. A null text, or one
    without letters, is ``und``, scored 0 and rejected, and so is every text if nothing can
    be learned. Equal cosines go to the first language by name. Repeated rows get equal
    results; columns of the added names are replaced.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    idf = inverse_frequency(known)
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), fit(known, idf, sample), idf)
