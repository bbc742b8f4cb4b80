import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and an extra column with a clashing name."""
    rows = [
        (1, None, None, "x"), (None, "Some words here and there for a test", "en", None), (None, None, None, None), (2, "", "en", "x"), (3, "  \n ", None, "x"),
        (4, "the same text " * 60, "en", "x"), (4, "the same text " * 60, "en", "x"), (5, "the same text " * 60, None, "y"), (6, "12345 !!! ??", "de", "x"),
        (7, "a" * 30_000, "de", "x"), (8, "été à la plage " * 2000, "fr", "x"), (9, "word", "en", "x"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), "extra") for i, t, lang, source in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string")
