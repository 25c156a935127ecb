"""Edge-case documents and a small sample shared by the tests of this folder."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part int, h long, row string, n_words long"

EDGES = [
    (1, None), (2, ""), (3, "one"), (4, " \t\n "), (5, "ein  zwei\tdrei vier fünf sechs sieben"), (6, "word " * 60), (7, "word " * 60),
    (8, "a b c d e f g h i j k l m n o p"), (8, "a b c d e f g h i j k l m n o p"), (None, "no id here"), (9, "x" * 70_000),
    (10, "12345 --- !!! 9"), (11, "<|endoftext|> #     tail "), (12, "long text " + " ".join(f"w{i}" for i in range(30_000))),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty, long and repeated rows, and columns named like those that operators add."""
    rows = [(i, t, None if k % 4 == 0 else "xy"[k % 2] * 2, None if k % 5 == 0 else f"s{k % 3}", None, 7, None, 1, "r", 5) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, edges, tmp_path_factory):
    """A folder of tables: the edge-case documents beside the small sample's other tables."""
    folder = tmp_path_factory.mktemp("edge")
    edges.write.parquet(str(folder / "documents.parquet"))
    for name in ("benchmark", "labels", "embeddings", "pages"):
        (folder / f"{name}.parquet").symlink_to(Path(DATA) / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    """The tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def sample() -> pd.DataFrame:
    return pd.read_parquet(f"{DATA}/documents.parquet")
