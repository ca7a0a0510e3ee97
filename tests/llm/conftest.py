import pytest

from .helpers import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside or return
CLASH = ["b", "p", "band", "value", "head", "comp", "node", "leaf", "i", "h", "template", "score", "lang_pred", "hits",
         "licenses", "kept_text", "n_lines", "n_dropped", "bucket", "ids", "size", "center", "chunk", "data", "digest", "pos"]


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids, texts and languages; empty, blank, one-word and very long texts; exact
    and near copies; repeated rows."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = "\n".join(prose(100 + i, 60, 3000) for i in range(400))
    rows = [(1, base, "en", "s", 1), (2, base, "en", "s", 1), (3, near, None, "s", 1), (4, None, "en", None, None), (5, "", "fr", "s", 0),
            (6, " \n\t ", "fr", "s", 4), (7, "word", "en", "s", 4), (8, "word", "en", "s", 4), (9, long, "en", "s", 9),
            (10, prose(2, 80), "fr", "s", 1), (11, "日本語のテキスト と 日本語", "ja", "s", 1), (12, "12 34 !!", "en", "s", 1),
            (None, base, "en", "s", 1), (None, None, None, None, None), (13, prose(3, 40), "fr", "s", 1), (13, prose(3, 40), "fr", "s", 1)]
    return rows + [(20 + i, prose(10 + i, 50 + i), ("en", "fr")[i % 2], "s", 1) for i in range(20)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F
    return spark.createDataFrame(odd_rows, DOCS).select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
