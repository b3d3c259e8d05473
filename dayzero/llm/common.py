"""What several operators share: words, intermediate tables, table reading."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayzero.sources.folders import shared_folder

#: Bytes that part words; in UTF-8 none of them occurs inside another character.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


#: The folder that holds this library; executors find it at the same place or by what the cluster was given.
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """The session, with this library on the Python path of its workers."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, then) -> Column:
    """then(value) with value computed once per row.

    A column that is named inside a lambda would otherwise be computed for each element.
    """
    return F.transform(F.array(value), then)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here and lost executors cost nothing.

    Every call takes a folder of its own. The files stay until the cluster clears the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
