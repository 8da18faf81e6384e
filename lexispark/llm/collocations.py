"""Phrase collocations by a weighted de Bruijn graph.

With phrases of up to N words an edge is an N-gram, from the node of its first N - 1 words
to the node of its last N - 1; its weight is how often it occurs. Only edges are counted:
every place of a piece gives one row, the N-gram that starts there. Near the end of a piece
the gram is shorter; those rows are the corrections. All shorter counts follow: a phrase
occurs as often as the grams that start with it, which for a node is the flow out of it
plus the pieces that end in it.

A node all of whose flow comes in by one edge and leaves by one is inside a longer phrase
with the same count. Such nodes are compacted away: frequent edges are joined into unary
paths, stored as one list of words with one weight, from which edges and inner nodes can be
read again. A unary path lies within one piece (every passage through it goes all the way),
so its list is no longer than that piece.

Rows are shuffled once, by their first word, so that edges and flow are summed in the same
place; a task sends the grams of a word as one row. A first word, or longer start of a gram,
that holds over two of K parts of all places is hot: its grams are dealt by one word more.
A first pass over the texts finds the hot starts (lists of K at most, whatever the texts hold).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.shared import if_small, stored

#: Words whose grams a task counts before it sends them on.
CHUNK = 1_000_000
#: A start of grams counts as hot from this share of all places on (or a quarter of a shuffle part).
HOT_SHARE = 2000
#: Words of a shuffle part.
PART = 2_000_000

_MARK = 0xFF  # never part of UTF-8
_TABLE = bytes(_MARK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STARTS = "lang string, words int, start string, n bigint"
_GRAMS = "lang string, first string, part string, hot boolean, rests string, counts array<int>"


class Numbers(dict):
    """Words of a chunk, numbered as they come; the mark between pieces is 0."""

    def __init__(self):
        super().__init__({bytes([_MARK]): 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _words(text: bytes) -> list[bytes]:
    """Lower case (A-Z), the words of all pieces, a mark after each piece."""
    mark = bytes([_MARK])
    return (text.translate(_TABLE) + mark).replace(mark, b" \xff ").split(b" ")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    """(words by number, numbers of the words of each language) of some CHUNK words."""
    numbers, held, count = Numbers(), {}, 0

    def given():
        words = pa.array([None, *list(numbers)[1:]], pa.binary()).cast(pa.string())
        return words, {lang: np.concatenate(a) for lang, a in held.items()}

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for k, text in enumerate(batch.column(1)):
            words = [w for w in _words(text.as_py()) if w]
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            held.setdefault(langs[k], []).append(ids)
            count += len(ids)
            if count >= CHUNK:
                yield given()
                numbers, held, count = Numbers(), {}, 0
    if count:
        yield given()


def _places(ids: np.ndarray, words: int) -> list[np.ndarray]:
    """For each place of a word the numbers of the words from there on, 0 beyond the piece."""
    padded = np.concatenate([ids, np.zeros(words, np.int64)])
    at = np.flatnonzero(ids)
    columns = [ids[at]]
    for j in range(1, words):
        columns.append(np.where(columns[-1] == 0, 0, padded[at + j]))
    return columns


def _combined(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first, number) of every different row of ``columns`` (values < size)."""
    key, top = columns[0], size
    for c in columns[1:]:
        if top * size >= 1 << 63:
            different, key = np.unique(key, return_inverse=True)
            top = len(different)
        key, top = key * size + c, top * size
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def _joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words of the columns with blanks between. 0 is no word, and none follows it."""
    first, *more = (words.take(pa.array(c)) for c in columns)
    first = pc.fill_null(first, "")  # the join drops rows that have no word at all
    return pc.binary_join_element_wise(first, *more, " ", null_handling="skip") if more else first


def _begins(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _hot_words(names: pa.Array, columns: list[np.ndarray], hot: list[pa.Array]) -> np.ndarray:
    """How many words of each gram, from the first on, are hot starts."""
    depth, alive = np.zeros(len(columns[0]), np.int64), np.ones(len(columns[0]), bool)
    for k, starts in enumerate(hot, 1):
        new = _begins(columns[:k])
        at = np.flatnonzero(new & alive)
        found = np.zeros(len(new), bool)
        found[at] = pc.is_in(_joined(names, [c[at] for c in columns[:k]]), value_set=starts).to_numpy(zero_copy_only=False)
        alive = found[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else alive
        depth[alive] = k
    return depth


def grams(texts: DataFrame, words: int, hot: dict[str, list[pa.Array]]) -> DataFrame:
    """The grams of all places, summed by chunk of the text: (lang, first, part, hot, rests,
    counts). ``hot`` tells that the gram's node is split. ``rests`` are the grams' other words, a line each (fewer, or an empty line,
    where the piece ends before); ``part`` is what they share if ``first`` is hot."""

    def count(batches):
        for names, held in _chunks(batches):
            for lang, ids in held.items():
                columns = _places(ids, words)
                at, n = _combined(columns, len(names))
                columns = [c[at] for c in columns]
                depth = _hot_words(names, columns, hot.get(lang, []))
                shared = [np.where(depth >= k, c, 0) for k, c in enumerate(columns)]
                at = np.flatnonzero(_begins(shared))
                offsets = pa.array(np.append(at, len(n)), pa.int32())
                rests = _joined(names, columns[1:])
                part = pc.if_else(pa.array(depth[at] > 0), _joined(names, [c[at] for c in shared[1:]]), pa.scalar(None, pa.string()))
                rows = pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), names.take(pa.array(columns[0][at])), part, pa.array(depth[at] == words - 1),
                     pc.binary_join(pa.ListArray.from_arrays(offsets, rests), "\n"), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))],
                    ["lang", "first", "part", "hot", "rests", "counts"],
                )
                for k in range(0, len(at), 20_000):
                    yield rows.slice(k, 20_000)

    return texts.mapInArrow(count, _GRAMS)


def hot_starts(texts: DataFrame, words: int) -> tuple[dict[str, list[pa.Array]], int]:
    """(lang -> the hot starts of 1, 2, .. words - 1 words, number of places).

    A chunk gives the starts that hold a K-th of its own places, and its places. Those for
    which that makes a K-th of all places are at most K of each length; a start with two of
    K parts of all is among them, as what chunks leave out of it is below a K-th of all.
    """
    share = max(HOT_SHARE, 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def count(batches):
        for names, held in _chunks(batches):
            total = int(sum(map(np.count_nonzero, held.values())))
            out = [(None, 0, None, total)]
            for lang, ids in held.items():
                columns = _places(ids, words - 1)
                for k in range(1, words):
                    whole = [c[columns[k - 1] > 0] for c in columns[:k]]
                    at, n = _combined(whole, len(names))
                    at, n = at[n * share >= total], n[n * share >= total]
                    out += zip([lang] * len(n), [k] * len(n), _joined(names, [c[at] for c in whole]).to_pylist(), n.tolist())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "start", "n"])

    found = stored(texts.mapInArrow(count, _STARTS).groupBy("lang", "words", "start").agg(F.sum("n").alias("n")), "starts")
    total = found.where("words = 0").agg(F.sum("n")).first()[0] or 0
    hot: dict[str, list[list[str]]] = {}
    for r in found.where((F.col("words") > 0) & (F.col("n") * share >= total)).collect():  # K of each length at most
        hot.setdefault(r["lang"], [[] for _ in range(1, words)])[r["words"] - 1].append(r["start"])
    return {lang: [pa.array(s, pa.string()) for s in by] for lang, by in hot.items()}, total


def _summed(texts: DataFrame, words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges (lang, head, last, n) of weight ``least`` or more, and the flow (lang, head, n,
    hot) of every node; grams shorter than a node, with which pieces end, are rows of flow.
    The flow of a hot node is in several rows."""
    hot, total = hot_starts(texts, words)
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART + 1)
    rows = grams(texts, words, hot).repartition(parts, "lang", "first", "part")
    each = F.explode(F.arrays_zip(F.split("rests", "\n", -1).alias("rest"), F.col("counts").alias("n"))).alias("g")
    gram = rows.select("lang", "first", "part", "hot", each).groupBy("lang", "first", "part", "hot", F.col("g.rest").alias("rest")).agg(F.sum("g.n").alias("n"))
    full = (F.col("rest") != "") if words == 2 else F.size(F.split("rest", " ")) == words - 1
    gram = gram.withColumn("full", full)
    begin = F.concat_ws(" ", "first", F.when(F.col("rest") != "", F.col("rest")))
    gram = gram.select(
        "lang", "first", "part", "hot", "n", F.when(F.col("full"), F.substring_index(begin, " ", words - 1)).otherwise(begin).alias("head"),
        F.when(F.col("full"), F.substring_index("rest", " ", -1)).alias("last"),
    )
    none = F.lit(None).cast("string")
    kept = F.explode(F.when(F.col("last").isNotNull() & (F.col("n") >= least), F.array(none, F.col("last"))).otherwise(F.array(none))).alias("last")
    both = gram.select("lang", "first", "part", "hot", "head", "n", kept).groupBy("lang", "first", "part", "hot", "head", "last").agg(F.sum("n").alias("n"))
    both = stored(both.select("lang", "head", "last", "n", "hot"), "edges_and_flow")
    return both.where("last is not null").drop("hot"), both.where("last is null").drop("last")


def _length(gram: Column) -> Column:
    return F.size(F.split(gram, " "))


def shorter_counts(flow: DataFrame, words: int, least: int) -> dict[int, DataFrame]:
    """k -> (lang, gram, f) of the phrases of k < words words that occur ``least`` times."""
    node = flow.where(_length(F.col("head")) == words - 1) if words > 2 else flow
    whole = node.where("not hot").select("lang", F.col("head").alias("gram"), F.col("n").alias("f"))
    split = node.where("hot").groupBy("lang", F.col("head").alias("gram")).agg(F.sum("n").alias("f"))
    counts = {words - 1: whole.unionByName(split).where(F.col("f") >= least)}
    for k in range(1, words - 1):
        starts = flow.where(_length(F.col("head")) >= k).groupBy("lang", F.substring_index("head", " ", k).alias("gram")).agg(F.sum("n").alias("f"))
        counts[k] = starts.where(F.col("f") >= least)
    return {k: stored(c.withColumn("words", F.lit(k)), f"counts_{k}") for k, c in counts.items()}


def unary_paths(edges: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(lang, path, weight): the edges, joined where a node has one way in and one way out.

    ``nodes`` has (lang, gram, f). An edge is followed by the one that leaves its last node
    if both carry all of that node's flow. Each edge finds the first of its path by pointer
    doubling, in as many rounds as the logarithm of the longest path.
    """
    tail = F.col("last") if words == 2 else F.concat(F.expr("substring(head, instr(head, ' ') + 1)"), F.lit(" "), F.col("last"))
    edge = edges.select("lang", "head", tail.alias("tail"), F.concat("head", F.lit(" "), "last").alias("id"), "last", "n")
    leaves = edge.join(nodes.select("lang", F.col("gram").alias("head"), "f"), ["lang", "head"]).where("n = f").select("lang", F.col("head").alias("node"), F.col("id").alias("next"))
    enters = edge.join(nodes.select("lang", F.col("gram").alias("tail"), "f"), ["lang", "tail"]).where("n = f").select("lang", F.col("tail").alias("node"), "id")
    follows = stored(enters.join(leaves, ["lang", "node"]).select("lang", F.col("id").alias("before"), F.col("next").alias("id")), "follows")
    reach = follows.select("lang", "id", F.col("before").alias("first"), F.lit(1).cast("long").alias("steps"))
    open_ = True
    while open_:
        at = reach.select("lang", F.col("id").alias("first"), F.col("first").alias("_first"), F.col("steps").alias("_steps"))
        reach = reach.join(at, ["lang", "first"], "left").select("lang", "id", F.coalesce("_first", "first").alias("first"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_first").isNotNull().alias("moved"))
        reach = stored(reach, "reach")
        open_ = not reach.where("moved").isEmpty()
        reach = reach.drop("moved")
    placed = edge.join(reach, ["lang", "id"], "left").select("lang", F.coalesce("first", "id").alias("first"), F.coalesce("steps", F.lit(0)).alias("steps"), "last", "n")
    paths = placed.groupBy("lang", "first").agg(F.max("n").alias("weight"), F.sort_array(F.collect_list(F.struct("steps", "last")))["last"].alias("lasts"))
    path = F.concat(F.split("first", " "), F.slice("lasts", 2, 1 << 30))
    return paths.select("lang", path.alias("path"), "weight")


def graph(docs: DataFrame, max_words: int = 3, least: int = 10) -> tuple[DataFrame, dict[int, DataFrame], DataFrame]:
    """(unary paths, counts of shorter phrases by length, words (lang, n)), all stored."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    edges, flow = _summed(texts, max_words, least)
    counts = shorter_counts(flow, max_words, least)
    paths = stored(unary_paths(edges, counts[max_words - 1], max_words), "paths")
    total = stored(flow.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    return paths, counts, total


def _window(at: Column, words: int) -> Column:
    return F.array_join(F.slice("path", at, words), " ")


def _contained(longer: DataFrame) -> DataFrame:
    """(lang, gram, most): the greatest count of the longer phrases that start or end so."""
    start = F.expr("substring_index(gram, ' ', words - 1)")
    parts = longer.select("lang", F.explode(F.array(start, F.expr("substring(gram, instr(gram, ' ') + 1)"))).alias("gram"), "f")
    return parts.groupBy("lang", "gram").agg(F.max("f").alias("most"))


def candidates(paths: DataFrame, counts: dict[int, DataFrame], words: int, percent: int = 50) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, words, f) of phrases of 2 to ``words`` words that are in no longer
    phrase with ``percent`` of their count; and the counts of all parts they can be cut
    into, but for nodes inside a path, which have the weight of the path."""
    inside = F.expr(f"explode(transform(sequence(2, size(path) - {words - 1}), i -> array_join(slice(path, i, {words - 1}), ' ')))")
    inner = stored(paths.where(F.size("path") > words).select("lang", inside.alias("gram")).distinct(), "inner_nodes")
    spans = paths.select("lang", "path", "weight", F.explode(F.sequence(F.lit(1), F.size("path") - (words - 1))).alias("at"))
    longest = spans.select("lang", _window(F.col("at"), words).alias("gram"), F.lit(words).alias("words"), F.col("weight").alias("f"))
    ends = paths.select("lang", F.explode(F.array(_window(F.lit(1), words - 1), F.array_join(F.expr(f"slice(path, -{words - 1}, {words - 1})"), " "))).alias("gram"), F.col("weight").alias("f"))
    outer = stored(counts[words - 1].join(inner, ["lang", "gram"], "left_anti"), "outer_nodes")
    kept = [longest]
    if words > 2:
        most = ends.groupBy("lang", "gram").agg(F.max("f").alias("most"))
        kept.append(outer.join(most, ["lang", "gram"], "left"))
        for k in range(words - 2, 1, -1):
            kept.append(counts[k].join(_contained(counts[k + 1]), ["lang", "gram"], "left"))
        kept[1:] = [c.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * percent)).select("lang", "gram", "words", "f") for c in kept[1:]]
    found = kept[0]
    for c in kept[1:]:
        found = found.unionByName(c)
    parts = outer
    for k in range(1, words - 1):
        parts = parts.unionByName(counts[k])
    return found, parts.select("lang", "gram", "f")


def scored(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the cut of lowest score, of equal ones the first.

    The score is floor(1000000 a a / (l r)) in whole decimals of 38 digits, which hold it
    for counts up to 10^16. A part that is not in ``parts`` is a node inside the phrase's
    path, so it has the phrase's count.
    """
    cuts = found.select("lang", "gram", "f", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), F.split("gram", " ").alias("w"))
    cuts = cuts.select("lang", "gram", "f", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("right"))
    side = lambda name, f: parts.select("lang", F.col("gram").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"], "left").join(side("right", "r"), ["lang", "right"], "left")
    cuts = cuts.withColumns({"l": F.coalesce("l", "f"), "r": F.coalesce("r", "f")})
    d = lambda c: f"cast({c} as decimal(16, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {d('f')} * {d('f')}) div ({d('l')} * {d('r')})")
    best = cuts.groupBy("lang", "gram", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "b.l", "b.r", "b.score")


def first_of_each(rows: DataFrame, by: str, order: list[Column], tie: str, top: int) -> DataFrame:
    """The first ``top`` rows of each ``by`` with their ``rank``. Slices of a hot value are
    cut to ``top`` first, 1024, then 32, then one for each value."""
    for slices in (1024, 32):
        place = F.row_number().over(Window.partitionBy(by, F.pmod(F.xxhash64(tie), F.lit(slices))).orderBy(*order))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and these at
    blanks and tabs into words. A null text is empty, a null language ``und``. A phrase has
    2 to ``max_words`` words and occurs ``least`` times or more; phrases inside a longer one
    with ``percent`` of their count are left out. Repeated rows count as often as they
    occur. Texts without words, and an empty table, give no rows. Other columns than text
    and lang are not read.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    paths, counts, total = graph(docs, max_words, least)
    found, parts = candidates(paths, counts, max_words, percent)
    ranked = first_of_each(scored(found, stored(parts, "parts")), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top)
    return ranked.join(if_small(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
