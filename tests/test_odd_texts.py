"""Queries against their SQL on odd texts: null, empty, short, accented, with marks close to those the rules look for."""

import duckdb
import pandas as pd
import pytest

from loamline.operators import ingest
from loamline.plans.registry import ORACLES, QUERIES
from test_queries import rows

TEXTS = [
    "", None, "a", "ab", "abc", "  ", "-x", "- x", "*y", "• z", "x = 5", "Note: a", "note :a", " Note: x　", "1.2 A", "\t- x", "Und dieü", "the andé", "ü" * 150, "ü" * 199, "ü" * 200,
    "x" * 200, "1) x", "a) b\n\n-\n  ", "NOTE： x", "und der̈ und die",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("odd"))
    texts = pd.DataFrame({"i": range(len(TEXTS)), "text": pd.Series(TEXTS, dtype="object")})
    c = duckdb.connect()
    c.register("texts", texts)
    c.sql(f"COPY (SELECT i * 3 + j AS doc_id, text, 'en' AS lang, 'src' || (j % 2) AS source, length(text) AS n_chars FROM texts, range(3) AS t(j)) TO '{base}/documents.parquet'")
    c.sql(f"COPY (SELECT i AS conv_id, CAST(1 AS INTEGER) AS turn, 'user' AS role, text FROM texts) TO '{base}/conversations.parquet'")
    return base


@pytest.mark.parametrize("name", ["completion_claim", "detect_format", "exact_duplicates", "line_roles", "line_roles_by_document", "batch_status"])
def test_query(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = rows(c.sql(ORACLES[name]).df())
    assert want and rows(QUERIES[name](spark, folder).toPandas()) == want


def test_a_batch_lists_its_problems(spark, folder):
    got = QUERIES["batch_status"](spark, folder).toPandas()
    assert got["bad"].str.split(",").map(len).tolist() == got["n_bad"].tolist()


def test_facts_of_a_line_are_taken_once(spark):
    """The test for capitals once ran over the whole line for each of its tokens."""
    df = spark.createDataFrame([("µABC DEÖ x\nABC µÖ DEF\n",)], "t string")
    out = ingest.repair_legacy(df, "t")
    assert [tuple(r) for r in out.select("fixed", "lines_changed").collect()] == [("àABC".upper() + " DEệ".upper() + " x\nABC ÀỆ DEF\n", 2)]
    assert "_told" not in out.columns
