from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dayzero import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.maxMetadataStringLength": "5000",
    }
    session = build_session("tests", "local[4]", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a DDL schema as a DataFrame; days and times may be text."""

    def build(schema: str, *rows: tuple):
        fields = [field.rsplit(" ", 1) for field in schema.split(", ")]
        as_text = ", ".join(
            f"{name} {'string' if kind in ('date', 'timestamp') else kind}"
            for name, kind in fields
        )
        df = spark.createDataFrame(list(rows), as_text)
        return df.selectExpr(*[f"cast({name} as {kind}) {name}" for name, kind in fields])

    return build


@pytest.fixture(scope="session")
def rows():
    """The rows of a DataFrame as tuples, in their order."""
    return lambda df: [tuple(row) for row in df.collect()]
