import random

import pytest


@pytest.fixture
def rnd():
    return random.Random(11)


@pytest.fixture
def docs(spark):
    """Makes a documents table with clashing extra columns from (id, text, lang, source) rows."""

    def make(rows):
        clash = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, _id int, _text string"
        full = [(i, t, lang, src, None, "x", "y", 3, "z") for i, t, lang, src in rows]
        return spark.createDataFrame(full, clash)

    return make
