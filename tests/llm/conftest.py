from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]

#: Null ids and texts, empty and white texts, ties, repeated rows, copies that differ in white space, a long text.
MESSY = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha  beta gamma delta\nepsilon zeta eta theta"),
    (2, "alpha  beta gamma delta\nepsilon zeta eta theta"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (None, "alpha beta gamma delta epsilon zeta eta theta"),
    (None, None),
    (6, "Ünïcode 🙂 text \\ ### </turn> mail a@b.co"),
    (7, "x " * 30_000),
    (8, " ".join(WORDS)),
    (9, " ".join(WORDS[:-1] + ["other"])),
    (10, " ".join(WORDS[:200])),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Rows of MESSY with extra columns whose names clash with what the operators use inside."""
    clash = ["_t", "_h", "_n", "n", "g", "w", "rep", "comp", "shard", "slot", "sequence_id", "_gm_s", "_gm_in", "kept", "_th", "spans", "item", "bucket"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(MESSY, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
