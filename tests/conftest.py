import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexispark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, *tuples) -> DataFrame"""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="session")
def kw(spark):
    """A small tag vocabulary; names and ids are those of the public tag files."""
    make = lambda *data: spark.createDataFrame(
        [(i, k, k + " descr", e) for i, k, e in data], "id INT, kw STRING, descr STRING, ents STRING"
    ).cache()
    plain = lambda *data: make(*[(i, k, None) for i, k in data])
    return {
        "pos": plain((14, "int"), (17, "n"), (28, "v1"), (6, "adv"), (46, "vs"), (13, "exp")),
        "misc": make((22, "uk", None), (5, "col", None), (27, "on-mim", None), (2, "abbr", None),
                     (15, "male", '{"jmdict":{"v":"male term"},"jmnedict":{"e":"masc","v":"male name"}}'), (17, "obs", '{"jmdict":1}'), (181, "given", '{"jmdict":0,"jmnedict":1}')),
        "fld": plain((2, "comp"), (3, "food")),
        "dial": plain((2, "ksb")),
        "kinf": plain((4, "ateji"), (1, "iK")),
        "rinf": plain((3, "ik"), (1, "gikun"), (103, "name"), (106, "kun"), (128, "on")),
        "freq": plain((1, "ichi"), (2, "gai"), (4, "spec"), (5, "nf"), (7, "news")),
        "lang": plain((1, "eng"), (137, "fre"), (150, "ger")),
        "ginf": plain((1, "equ"), (2, "lit"), (3, "fig"), (4, "expl"), (5, "tm")),
        "xref": plain((1, "syn"), (2, "ant"), (3, "see"), (6, "uses")),
        "stat": plain((2, "A"), (4, "D"), (6, "R")),
        "cinf": plain((25, "jis208"), (32, "nelson_rad"), (24, "strokes"), (23, "pinyin"), (1, "nelson_c"), (9, "moro"), (18, "skip")),
    }
