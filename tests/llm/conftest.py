import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """docs_of([(id, text), (id, text, lang, source)...]) with columns whose names clash with operators' own."""

    def make(rows):
        full = [(*r, *("en", "s1")[len(r) - 2 :], len(r[1] or "")) if len(r) < 5 else r for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for extra in ("score", "fp", "component_id", "spans", "items", "size", "copies", "root", "held_out"):
            df = df.withColumn(extra, F.lit("clash"))
        return df

    return make


#: Null, empty, blank, one word, very long, repeated rows and a null id.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "word " * 60_000), (6, "same text here and there"), (6, "same text here and there"), (None, "no id at all"), (7, "ünï çödé \U0001f600 <|im_end|>")]


@pytest.fixture
def odd():
    return list(ODD)
