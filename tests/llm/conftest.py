import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newswatch.llm.common import table

PASSAGE = "a passage of words that is long enough to be found once more in other texts é " * 9
TEXTS = [
    (-1, None), (-2, ""), (-3, " \n\t"), (-4, "a b"), (-5, "A b"), (-6, "a b c"), (-7, "x " * 60), (-8, "x " * 90),
    (-9, "y" * 399), (-10, "y" * 400), (-11, "ab" * 3000), (-12, PASSAGE + "tail one"), (-13, "head " + PASSAGE),
    (-14, "q" * 900), (-15, "q" * 900), (-16, "same id"), (-16, "same id"), (-16, "other text of one id"), (None, "no id " + PASSAGE),
    (-17, "word " * 30000), (-18, "don't IT'S é, € a*** <|endoftext|> \x00 　 \U0001f600"),
]


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The driver's documents and rows of every odd kind, with columns whose names operators use inside."""
    odd = spark.createDataFrame([(d, t, "en", None, 0) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    both = table(spark, sf_dir, "documents").filter("doc_id < 400").unionByName(odd)
    return both.withColumns({"n": F.lit(1), "digest": F.lit("x"), "stratum": F.lit("y"), "component": F.lit(2), "ids": F.lit(3), "text__": F.lit("z")}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def word_tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")
