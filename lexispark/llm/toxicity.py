"""Toxicity by logistic regression with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the 64-bit hashes of its words, word pairs, pairs with one or two
words between, and of the first four and five letters of its longer words, each once.
FTRL-proximal keeps two numbers for each feature, from which its weight follows: a learning
rate of its own, and weight 0 until the gradients add up to more than the L1 limit, so that
few features have a weight at all.

The labelled rows it learns from are a sample of at most ``SAMPLE`` rows of each label. They
are dealt to shards of some ``SHARD_BYTES`` of text; a shard goes through its rows in a task
of its own, starting from the state that the shards of the round before agreed on (the mean,
feature by feature, over the shards that have it). The state is a table with a row for each
feature that ``MIN_TEXTS`` texts of a shard share, joined to the shards by feature; only its
non-zero weights, which L1 keeps few and the sample bounds, go to the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import MEMO_WORDS, mix, plain_words, stored, to_long, word_hashes

#: Labelled rows of each label that are learned from.
SAMPLE = 20_000
#: Text a shard learns from, and in how many of its texts a feature has to be.
SHARD_BYTES, MIN_TEXTS = 4 << 20, 2
#: Words between the words of a skip-gram; letters of a word's beginning.
GAPS, BEGINNINGS = (1, 2), (4, 5)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner: rate, its slack, the two penalties, passes and rounds."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    passes: int = 3
    rounds: int = 2

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
        """Go through the texts (numbers of their features), changing ``z`` and ``n``.
        Feature 0 is in every text."""
        for _ in range(self.passes):
            for at, label in zip(texts, labels):
                zs, ns = z[at], n[at]
                w = self.weights(zs, ns)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
                z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / self.alpha * w
                n[at] = ns + g * g


BIAS = np.uint64(0)


class Beginnings(dict):
    """The hashes of the beginnings of a word, for the words of one task."""

    def __missing__(self, word: bytes) -> list[int]:
        letters = word.decode("utf-8", "surrogatepass")
        begun = [f"{n}:{letters[:n]}" for n in BEGINNINGS if len(letters) > n]
        self[word] = out = [xxhash.xxh3_64_intdigest(b.encode("utf-8", "surrogatepass")) for b in begun]
        return out


_beginnings = Beginnings()


def features(text: str | None) -> np.ndarray:
    """Hashes of the n-grams, skip-grams and beginnings of a whole text, in no order and
    some of them more than once; first that of the bias, which every text has."""
    words = plain_words(text)
    h = word_hashes(words)
    found = [np.zeros(1, np.uint64), mix(h)]
    for k, gap in enumerate((0, *GAPS), 2):
        if len(h) > gap + 1:
            found.append(mix(mix(h[: -gap - 1] + np.uint64(k)) + h[gap + 1 :]))
    if len(_beginnings) > MEMO_WORDS:
        _beginnings.clear()
    found.append(np.array(list(chain.from_iterable(map(_beginnings.__getitem__, set(words)))), np.uint64))
    return np.concatenate(found)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned: 5 divides the checksum of the id, or there is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from, stored: of each label the ``sample``
    first in hashed order of their ids. An id labelled twice is toxic if one label says so."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    of = lambda label: known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = of(1).unionByName(of(0))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # two samples at most
    return stored(texts.select("doc_id", "text", "label"), "labelled_sample")


def fit(rows: DataFrame, ftrl: Ftrl = Ftrl(), shard_bytes: int = SHARD_BYTES, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(feature, z, n) learned from (doc_id, text, label)."""
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    dealt = rows.withColumn("order", F.xxhash64("doc_id")).withColumn("shard", F.pmod(F.col("order"), F.lit(shards)))
    schema = "shard bigint, feature bigint, z double, n double"

    def learn(shard: pd.DataFrame, start: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(shard):
            return pd.DataFrame({"shard": [], "feature": [], "z": [], "n": []})
        shard = shard.sort_values(["order", "doc_id", "text"])
        out = shard_state(shard["text"], shard["label"].to_numpy(), _sorted(start), ftrl, min_texts)
        return out.assign(shard=shard["shard"].iloc[0])[["shard", "feature", "z", "n"]]

    told = stored(dealt.groupBy("shard").applyInPandas(lambda shard: learn(shard), schema), "ftrl")
    for _ in range(ftrl.rounds - 1):
        start = told.select("shard", "feature").join(agreed(told), "feature")
        told = stored(dealt.groupBy("shard").cogroup(start.groupBy("shard")).applyInPandas(learn, schema), "ftrl")
    return stored(agreed(told), "ftrl_state")


def agreed(told: DataFrame) -> DataFrame:
    return told.groupBy("feature").agg(F.avg("z").alias("z"), F.avg("n").alias("n"))


def _sorted(state: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if state is None or not len(state):
        return np.empty(0, np.uint64), np.empty(0), np.empty(0)
    f = state["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(f)
    return f[order], state["z"].to_numpy()[order], state["n"].to_numpy()[order]


def shard_state(texts, labels: np.ndarray, start: tuple, ftrl: Ftrl, min_texts: int) -> pd.DataFrame:
    """What one shard makes of the state it starts from, for the features it learns."""
    found = [np.unique(features(t)) for t in texts]
    all_, n_texts = np.unique(np.concatenate(found), return_counts=True)
    all_ = all_[(n_texts >= min_texts) | (all_ == BIAS)]
    z, n = np.zeros(len(all_)), np.zeros(len(all_))
    if len(start[0]):
        at = np.minimum(np.searchsorted(start[0], all_), len(start[0]) - 1)
        known = start[0][at] == all_
        z[known], n[known] = start[1][at[known]], start[2][at[known]]
    numbers = []
    for f in found:
        at = np.minimum(np.searchsorted(all_, f), len(all_) - 1)
        numbers.append(at[all_[at] == f])
    ftrl.learn(numbers, labels, z, n)
    return pd.DataFrame({"feature": to_long(all_), "z": z, "n": n})


def weights(state: DataFrame, ftrl: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) other than 0, sorted by feature. L1 leaves few."""
    rows = state.where(F.abs("z") > ftrl.l1).select("feature", "z", "n").collect()
    f, z, n = _sorted(pd.DataFrame([tuple(r) for r in rows], columns=["feature", "z", "n"]))
    return f, ftrl.weights(z, n)


class Scorer:
    """Scores of texts. A table of 2^22 marks passes over the features without a weight."""

    MASK = np.uint64((1 << 22) - 1)

    def __init__(self, features_: np.ndarray, weights_: np.ndarray):
        self.features, self.weights = features_, weights_
        self.marked = np.zeros(int(self.MASK) + 1, bool)
        self.marked[features_ & self.MASK] = True

    def __call__(self, text: str | None) -> float:
        if not len(self.features):
            return 0.0
        f = features(text)
        f = np.unique(f[self.marked[f & self.MASK]])
        total = 0.0
        if len(f):
            at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
            total = self.weights[at[self.features[at] == f]].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id``, held_out, score, predicted of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value)
        for batch in texts:
            yield batch.map(scorer, na_action=None).astype("float64")
        _beginnings.clear()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of_texts("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, ftrl: Ftrl = Ftrl(), sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on) of every row of ``docs``.

    Learns from ``labels`` (doc_id, toxic) of documents that aren't held out. A null or empty
    text has the score of the bias alone. Rows with null doc_id or without a label are
    scored like others; null labels are no labels. Without labels
    nothing is learned and every score is 0. Repeated rows are scored one by one, and learned
    as often as they occur. Other columns are not read.
    """
    rows = labelled_sample(docs, labels, sample)
    return score(docs, weights(fit(rows, ftrl), ftrl))
