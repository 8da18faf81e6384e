"""Language codes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Three-letter codes whose bibliographic form differs from the terminological one.
BIBLIOGRAPHIC = {
    "sqi": "alb", "hye": "arm", "eus": "baq", "mya": "bur", "zho": "chi", "ces": "cze", "nld": "dut", "fra": "fre",
    "kat": "geo", "deu": "ger", "ell": "gre", "isl": "ice", "mkd": "mac", "mri": "mao", "msa": "may", "fas": "per",
    "ron": "rum", "slk": "slo", "bod": "tib", "cym": "wel",
}


def language_codes(spark: SparkSession) -> dict[str, str]:
    """Two-letter to bibliographic three-letter codes, from the JVM's language list."""
    locale = spark.sparkContext._jvm.java.util.Locale
    out = {}
    for two in locale.getISOLanguages():
        three = locale.forLanguageTag(two).getISO3Language()
        if len(two) == 2 and three:
            out[two] = BIBLIOGRAPHIC.get(three, three)
    return out


def language_code(spark: SparkSession, two: Column | str) -> Column:
    """X13 as a column: null for unknown codes."""
    two = F.col(two) if isinstance(two, str) else two
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in language_codes(spark).items() for x in kv]), F.lower(two))
