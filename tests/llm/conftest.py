import pytest
from made_texts import prose
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns named like the operators' own."""
    base = prose(1, 60)
    rows = [(1, base, "en", "src1"), (2, base, "en", "src1"), (2, base, "en", "src1"), (3, "", "en", "src0"),
            (4, None, None, None), (None, "Nobody's text", "fr", "src2"), (None, None, None, "src2"), (5, "  \n\t ", "fr", "src0"),
            (6, base + " end", "en", "src1"), (7, prose(2, 30_000), "en", None), (8, "12 34 !!", None, "src3"),
            (9, "été à la plage", "fr", "src2"), (10, "one", "en", "src1"), (11, "ONE", "en", "src1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    clash = ("component_id", "fp", "score", "lang_pred", "n_tokens", "row", "fingerprint", "cell", "key", "copies", "s", "d")
    return docs.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
