import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words) -> text in short sentences, the same for the same arguments."""

    def make(seed, words, vocabulary=400):
        r = random.Random(seed)
        stems = ["".join(r2.choice("aeioulnrst") for _ in range(r2.randint(3, 8))) for r2 in (random.Random(i) for i in range(vocabulary))]
        out = []
        while len(out) < words:
            some = [r.choice(stems) for _ in range(min(r.randint(4, 9), words - len(out)))]
            some[-1] += "."
            out += some
        return " ".join(out)

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Texts with copies, near copies, nulls, empties, a long one, repeated rows and ids, and
    columns with names that operators use themselves."""
    base = [prose(i, 60) for i in range(12)]
    near = base[0].replace(base[0].split()[10], "changed", 1)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, near), (22, None), (23, ""), (24, "one"), (25, "one"), (26, "one two three"), (27, " \n\t ")]
    rows += [(28, prose(99, 6000)), (3, base[3]), (3, prose(77, 50)), (None, base[1]), (None, None), (29, "42 ... !!"), (30, base[5] + " " + base[6]), (31, "ÀÉ éü ß\u0301 Ω " * 30)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, tile int, part int, size int, rejected string"
    full = [(i, t, "xx" if k % 3 else "yy", None if k % 4 == 0 else "s", None, 1, 2, 3, 4, "r") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
