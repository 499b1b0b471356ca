import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ITEM = "example_id string, question string, options array<string>, label int, split string, subject string, topic string, provenance_group string, explanation string, ingested_at timestamp"


@pytest.fixture
def make_items(spark):
    """Items from (id, question, options, split) with defaults for the rest."""

    def make(rows):
        full = [(r[0], r[1], r[2], r[4] if len(r) > 4 else 0, r[3], r[5] if len(r) > 5 else "Anatomy", "unknown", r[6] if len(r) > 6 else None, None, None) for r in rows]
        return spark.createDataFrame(full, ITEM)

    return make
