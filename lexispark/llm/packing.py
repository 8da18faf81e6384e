"""Best-fit packing of token pieces into sequences by exact complements.

Only the number of pieces of each length decides what fits where, so the packing itself
works on that histogram (at most ``capacity`` rows, whatever the input): lengths from the
longest down open sequences, whose gaps are filled exactly by one, two or three lengths in
stock, else by the longest length that fits, after which the rest of the gap is tried again.
All sequences alike are filled at once, as many as the stock allows, so the plan has a few
rows per length. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import pieces, stored, with_rank

_STOP = re.compile(r"(?<=[^\W\d_])(?=[!-/:-@\[-^{-~`]+(?:\s|\Z))")
_tokenizers: dict[str, _WordIds] = {}
#: Entries of the memo of word ids (about 200 bytes each), for the words of one task. When half
#: as many are new, they become the older half, from which words that come again are taken over.
MEMO_IDS = 150_000
#: Characters whose UTF-8 forms have every byte from 128 on that UTF-8 uses.
_UNITS = "".join(map(chr, range(0x80, 0x800))) + "\u0800\u1000\u2000\u3000\u4000\u5000\u6000\u7000\u8000\u9000\ua000\ub000\uc000\ud000\ue000\uf000\U00010000\U00050000\U00090000\U000d0000\U00100000"


@cache
def _pack(n: int):
    """n numbers to little-endian unsigned 32-bit numbers."""
    return struct.Struct(f"<{n}I").pack


class _WordIds(dict):
    """Ids (as bytes) of strings between blanks. Splitting there, and between a letter and
    closing stops, changes no id: the tokenizer drops white space and starts a new unit.
    Nor does lower case for A-Z, which it takes itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = {w: np.array([i], "<u4").tobytes() for w, i in special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if special else lambda text: [text]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(_UNITS)[0][0]
        self.to_letters = dict(zip(_UNITS.encode(), as_bytes))  # the letter that stands for a byte
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.pop(word, None)) is not None:
            self[word] = out
            return out
        if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):  # one unit, as it is
            unit = word if word.isascii() else word.encode().decode("latin-1").translate(self.to_letters)
            ids = [t.id for t in self.model.tokenize(unit)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = out = _pack(len(ids))(*ids)
        return out

    def ids(self, text: str) -> bytes:
        if len(self) > MEMO_IDS // 2:
            self.older = dict(self)
            self.clear()
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return b"".join(map(self.__getitem__, _STOP.sub(" ", low).replace("\n", " ").split(" ")))

    def all_ids(self, text: str) -> bytes:
        parts = self.cut(text)  # every second one is a special token
        if len(parts) == 1:
            return self.ids(text)
        return b"".join([self.special[p] if k % 2 else self.ids(p) if p else b"" for k, p in enumerate(parts)])


def _word_ids(path: str) -> _WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = _WordIds(path)
    return _tokenizers[path]


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers, special tokens as plain text."""
    return _word_ids(path).ids(text)


def text_bytes(text: str, path: str) -> bytes:
    """As the tokenizer gives them by default: special tokens, in exact case, have ids of their own."""
    return _word_ids(path).all_ids(text)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids, then ``end_id``,
    cut every ``capacity`` ids. A null text counts as empty."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows = []
            for doc, missing, text in zip(batch.doc_id, batch.doc_id.isna(), batch.text):
                ids = text_bytes(text or "", path) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (None if missing else int(doc), k, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<i4"),) * keep_ids)
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
            yield out.astype({"doc_id": "Int64"})
        _word_ids(path).forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, schema)


class Stock:
    """Pieces left of each length, with an index of the sums of two lengths in stock."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        have = np.flatnonzero(self.left)
        for a in have:
            self.pairs[a + have[have > a]] += 1
        np.add.at(self.pairs, 2 * np.flatnonzero(self.left >= 2), 1)

    def take(self, lengths: tuple[int, ...], n: int) -> None:
        for a in lengths:
            old, new = self.left[a], self.left[a] - n
            assert new >= 0
            if old >= 2 > new:
                self.pairs[2 * a] -= 1
            self.left[a] = new
            if new == 0 < old:
                have = np.flatnonzero(self.left)
                self.pairs[a + have] -= 1

    def available(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.left[a]) // lengths.count(a) for a in lengths)

    def pair(self, total: int) -> tuple[int, int] | None:
        """The most unequal pair in stock of that sum."""
        if total < 2 or not self.pairs[total]:
            return None
        small = np.arange(1, total // 2 + 1)
        ok = (self.left[small] > 0) & (self.left[total - small] > 0)
        if total % 2 == 0:
            ok[-1] = self.left[total // 2] >= 2
        return (total - int(small[ok.argmax()]), int(small[ok.argmax()])) if ok.any() else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that fill the gap, longest first."""
        if self.left[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        a = np.arange(1, gap - 1)
        for first in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)][::-1]:
            rest = self.pair(gap - int(first))
            if rest and self.available((int(first), *rest)):
                return (int(first), *rest)
        return None

    def longest(self, gap: int) -> int:
        have = np.flatnonzero(self.left[: gap + 1])
        return int(have[-1]) if len(have) else 0


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, hi, sequence, offset): pieces of that length with ranks lo to hi - 1
    go to sequences from ``sequence`` on, one each, at ``offset``."""
    stock, used = Stock(counts, capacity), dict.fromkeys(counts, 0)
    out, sequences = [], 0

    def place(lengths: tuple[int, ...], n: int, first: int, at: int) -> None:
        stock.take(lengths, n)
        for a in lengths:
            out.append((a, used[a], used[a] + n, first, at))
            used[a] += n
            at += a

    while longest := stock.longest(capacity):
        n = max(1, int(stock.left[longest]) // (capacity // longest))  # several of a short length go together
        place((longest,), n, sequences, 0)
        open_ = [(sequences, n, longest)]  # sequences alike: the first, how many, ids in each
        sequences += n
        while open_:
            first, n, at = open_.pop()
            gap = capacity - at
            if not gap:
                continue
            lengths = stock.exact(gap) or ((best,) if (best := stock.longest(gap)) else None)
            if lengths:
                m = min(n, stock.available(lengths))
                place(lengths, m, first, at)
                open_ += [(first + m, n - m, at)] * (n > m) + [(first, m, at + sum(lengths))]
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) plus sequence_id and
    offset. Sequences hold at most ``capacity``, without gaps. No piece gives no row.

    Ranks within a length are counted by stored file part, so that a length which most
    pieces share (full pieces, copies) is never numbered in one task.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    kept = stored(pieces.withColumn("_rid", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in kept.groupBy("length").count().collect()}  # one row per length at most
    ranked, rank = with_rank(kept, "length", "_rank"), F.col("_rank")
    # A step of the plan uses up a length or a group of sequences alike: a few rows per length.
    places = spark.createDataFrame(plan(counts, capacity), "_length bigint, _lo bigint, _hi bigint, _first bigint, offset bigint")
    fits = (F.col("length") == F.col("_length")) & (rank >= F.col("_lo")) & (rank < F.col("_hi"))
    placed = ranked.join(F.broadcast(places), fits)
    return placed.select(*names, (F.col("_first") + rank - F.col("_lo")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack. Of the documents only doc_id and text are read, so further
    columns never clash; a row without doc_id is packed like any other, repeated rows too."""
    return pack(token_pieces(docs, path, capacity, end_id, keep_ids), capacity)
