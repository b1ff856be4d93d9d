from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

from frostline.llm.common import table

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    """Where the session has no shared folder, the tests set their own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        folder = str(tmp_path_factory.mktemp("shared"))
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    table(spark, SF, "documents")  # lets Python workers find the package


@pytest.fixture(scope="session")
def rows():
    """Documents of the smallest tables, as tuples ``(doc_id, text, lang, source)``."""
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture
def frame(spark):
    """A table of documents from ``(doc_id, text)`` pairs, with further columns whose names the operators use too."""

    def make(pairs, parts=3):
        full = [(k, t, "en", "s", 1, "x") for k, t in pairs]
        schema = "doc_id long, text string, lang string, source string, row_ long, words_ string"
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


