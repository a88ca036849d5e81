"""Bring this package's code to the executors' Python workers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).parent


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_lexweave_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="lexweave-code-")) / "lexweave.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, f"{HERE.name}/{p.relative_to(HERE)}")
    context.addPyFile(str(at))
    context._lexweave_shipped = True


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand in the workers, and with columns of any name."""
    ship(df.sparkSession)
    if all(re.fullmatch(r"\w+", c) for c in df.columns):
        return df.mapInArrow(function, schema)
    names = df.columns

    def renamed(batches):
        return function(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(renamed, schema)
