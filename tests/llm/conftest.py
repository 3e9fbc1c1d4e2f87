from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    where = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(where / "warehouse"))
        .config("spark.checkpoint.dir", str(where / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(seed: int = 1, n: int = 200) -> list[tuple]:
    """Documents with nulls in any column, empty, blank and long texts, copies and repeated rows."""
    r = random.Random(seed)
    words = ["the", "And", "of", "é", "naïve", "x"] + [f"w{r.randrange(10**6)}" for _ in range(300)]
    out = [(i, " ".join(r.choices(words, k=r.randrange(1, 120))), r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "c", "d", None]), 1) for i in range(n)]
    out += [(n + i, out[3][1], "en", "a", 2) for i in range(12)]
    out += [(n + 20, None, "en", "b", None), (n + 21, "", "en", "c", 0), (n + 22, " \n\t\x0b", None, "e", 0), (None, "Some words here", "en", "a", 3), (None, None, None, None, None)]
    out += [(n + 23, " ".join(r.choices(words, k=20_000)), "en", "b", 9), out[5], out[5], out[6]]
    return out


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    """Extra columns bear names that operators use within."""
    return spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'x' as id", "1L as uid", "2L as size", "3 as n", "4 as key", "5 as shard", "6 as token").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
