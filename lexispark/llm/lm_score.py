"""Language-model scores by stupid backoff, with counts from the documents themselves.

Every document is scored against all others: its own n-grams are taken off the counts.
Documents are read in blocks. A block sends each distinct n-gram of its texts once, with its
count, to the part that holds the n-gram's hash; a part adds up what all blocks sent (this
is the count table, partitioned by hash) and answers each block with the totals of its
n-grams; the block's n-grams, joined with these, give the scores, summed per document.

N-grams travel as sorted 64-bit hashes, one row per block and part, so the rows follow the
n-grams in number at the worst, and the number of parts follows the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import plain_words, runs, to_long, word_hashes

BLOCK_TOKENS = 1 << 20
PART_BYTES = 8 << 20  # of text for each part of the count table
ALPHA = 0.4


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _expand(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def block_grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For each k up to ``order`` the hash of the k-gram that ends at each token, 0 where the
    document has no k tokens yet. Hash 0 stands for the number of tokens and is no n-gram."""
    ends = np.cumsum(lengths)
    place = np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)
    out = []
    for k in range(1, order + 1):
        h = np.zeros(len(tokens), np.uint64)
        h[k - 1 :] = np.maximum(runs(tokens, k), np.uint64(1))
        h[place < k - 1] = 0
        out.append(h)
    return out


def block_counts(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a block and their counts; first 0 with the tokens."""
    all_ = np.concatenate(grams)
    hashes, counts = np.unique(all_[all_ > 0], return_counts=True)
    return np.concatenate([[np.uint64(0)], hashes]), np.concatenate([[len(grams[0])], counts]).astype(np.uint32)


def _bounds(hashes: np.ndarray, parts: int) -> np.ndarray:
    starts = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64) if parts > 1 else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, starts), [len(hashes)]])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list, np.ndarray, np.ndarray]]:
    """(name, doc ids, tokens per document, tokens) of about BLOCK_TOKENS. The names are the
    same whenever the same rows are read again."""
    ids, sizes, held, n, serial = [], [], [], 0, 0
    for batch in batches:
        for doc, missing, text in zip(batch["doc_id"], batch["doc_id"].isna(), batch["text"]):
            words = word_hashes(plain_words(text))
            ids.append(None if missing else int(doc))
            sizes.append(len(words))
            held.append(words)
            n += len(words)
            if n >= BLOCK_TOKENS:
                yield f"{TaskContext.get().partitionId()}-{serial}", ids, np.array(sizes), np.concatenate(held)
                ids, sizes, held, n, serial = [], [], [], 0, serial + 1
    if ids:
        yield f"{TaskContext.get().partitionId()}-{serial}", ids, np.array(sizes), np.concatenate(held)


def _ask(order: int, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, _, sizes, tokens in _blocks(batches):
            hashes, counts = block_counts(block_grams(tokens, sizes, order))
            ends = _bounds(hashes, parts)
            rows = [(p, name, _squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))), _squeeze(counts[a:b])) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            yield pd.DataFrame(rows, columns=["part", "block", "hashes", "counts"])

    return run


def _answer(p: pd.DataFrame) -> pd.DataFrame:
    """The totals of one part of the count table, for each block that asked."""
    hashes = [np.cumsum(_expand(b, "<u8"), dtype=np.uint64) for b in p["hashes"]]
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate([_expand(b, "<u4") for b in p["counts"]]), len(known)).astype(np.uint64)
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    return pd.DataFrame({"part": p["part"], "block": p["block"], "totals": [_squeeze(t) for t in np.split(total[at], ends)]})


def score_block(tokens: np.ndarray, sizes: np.ndarray, order: int, totals: np.ndarray, alpha: float) -> np.ndarray:
    """Sum of log scores of each document; ``totals`` belong to block_counts' hashes."""
    grams = block_grams(tokens, sizes, order)
    hashes, _ = block_counts(grams)
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    others = []
    for h in grams:
        at = np.searchsorted(hashes, h)
        pair, inverse, own = np.unique(doc * np.uint64(len(hashes)) + at.astype(np.uint64), return_inverse=True, return_counts=True)
        others.append(np.where(h > 0, totals[at] - own[inverse], 0).astype(np.int64))
    n = np.maximum(1, int(totals[0]) - np.repeat(sizes, sizes)).astype(np.float64)
    log_alpha, score, done = math.log(alpha), np.zeros(len(tokens)), np.zeros(len(tokens), bool)
    steps = np.zeros(len(tokens))
    for k in range(order, 0, -1):
        c = others[k - 1]
        now = ~done & (c > 0)
        base = n if k == 1 else np.concatenate([[1], others[k - 2][:-1]])
        score[now] = np.log(c[now]) - np.log(base[now]) + steps[now] * log_alpha
        done |= now
        steps[~done & (grams[k - 1] > 0)] += 1
    score[~done] = steps[~done] * log_alpha - np.log(n[~done])
    return np.bincount(doc.astype(np.int64), score, len(sizes)) if len(tokens) else np.zeros(len(sizes))


def stupid_backoff(docs: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_tokens, log_score (sum) and mean_log_score (null without tokens) of each row.

    A token's score is the count of the n-gram that ends in it over the count of its
    context, both without the document's own; where the n-gram is not found in another
    document, ``alpha`` times the score with one word of context less, and at last alpha
    over the tokens of all other documents (1 at least). Words are in lower case without
    ASCII punctuation. Null and empty texts have no tokens and the sum 0. Repeated rows and
    rows without doc_id are documents of their own. Further columns are not read. ``docs``
    is read twice and must give its rows in the same parts again, as stored tables do;
    a block that finds no totals of its own raises an error.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    asked = rows.mapInPandas(_ask(order, parts), "part int, block string, hashes binary, counts binary")
    answers = asked.groupBy("part").applyInPandas(_answer, "part int, block string, totals binary")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, ids, sizes, tokens in _blocks(batches):
            words, at = np.unique(tokens, return_inverse=True)
            yield pd.DataFrame([(name, ids, sizes, _squeeze(words), _squeeze(at.astype(np.uint32)))], columns=["block", "ids", "sizes", "words", "tokens"])

    def score(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if len(block) != 1 or len(answer) == 0:
            raise ValueError("the documents were not read in the same parts again; store them first")
        b = block.iloc[0]
        sizes, tokens = np.array(b["sizes"], np.int64), _expand(b["words"], "<u8")[_expand(b["tokens"], "<u4")]
        totals = np.concatenate([_expand(t, "<u8") for t in answer.sort_values("part")["totals"]])
        sums = score_block(tokens, sizes, order, totals, alpha)
        ids = pd.array([None if v is None or v != v else int(v) for v in b["ids"]], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": sizes, "log_score": sums})

    blocks = rows.mapInPandas(read, "block string, ids array<bigint>, sizes array<bigint>, words binary, tokens binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "doc_id bigint, n_tokens bigint, log_score double")
    return scored.withColumn("mean_log_score", F.col("log_score") / F.nullif(F.col("n_tokens"), F.lit(0)))
