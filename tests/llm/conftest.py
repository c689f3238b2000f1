from __future__ import annotations

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


#: Rows that every operator must survive: nulls, empty and blank texts, repeats, and columns named like inner ones.
ODD = [
    (1, None, "a", "en"),
    (2, "", "a", None),
    (3, "  \n\t ", None, "en"),
    (4, "one", "b", "de"),
    (4, "one", "b", "de"),
    (None, "no id here, and yet a text", "b", "de"),
    (5, "word " * 3000 + "x" * 5000, "c", "en"),
    (6, "mixed CASE text, with marks!\nmixed CASE text, with marks!", "", "en"),
    (6, "same id, other text", "a", "en"),
]
NAMES = "doc_id long, text string, source string, lang string, row string, n long, size long, node long, kept boolean, score double"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, "r", 7, 8, 9, True, 0.5) for r in ODD]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NAMES)
