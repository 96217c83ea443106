import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
WORDS = {
    "en": "the of and to in is that for house water people morning between through because against".split(),
    "de": "der die und den nicht ein auch mit Straße über schön zwischen gegen Wasser Leute Morgen".split(),
    "es": "de la que el los del para una agua gente mañana entre contra porque casa señor".split(),
    "fr": "le les et des une dans pour eau maison être garçon matin contre entre parce français".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every odd case: nulls, empty, long, repeated rows, copies, ties."""
    rng = random.Random(7)
    rows = []
    for i in range(160):
        lang = ("en", "de", "es", "fr")[i % 4]
        text = prose(rng, lang, rng.choice((3, 40, 200, 900)))
        rows.append((i, text, lang, f"s{i % 5}" if i % 3 else "s0", len(text)))
    base = rows[10][1]
    rows += [(200 + i, base, "es", "s1", len(base)) for i in range(6)]
    rows += [(300, base + " agua", "es", "s1", 5), (301, None, "en", "s2", None), (302, "", "de", None, 0),
             (303, " \t\n", None, "s3", 3), (304, "one two", "en", "s3", 7), (None, "text without id the of", "en", "s4", 9),
             (305, prose(rng, "en", 60_000), "en", "s4", 1), (306, "😀 中文 <|endoftext|> x" * 5, None, "Ünï", 2),
             (307, "same", "en", "s1", 4), (307, "same", "en", "s1", 4), (308, "!!! ... 123", "en", "s1", 9)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
