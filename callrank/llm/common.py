"""Small helpers that the operators share: clean inputs, text batches, unused column names."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that a task works on at a time, whatever the size of an Arrow batch; a longer text is a group alone.
BATCH_CHARS = 2_000_000


#: Rows of an Arrow batch: whole texts and what is made of them are in memory by the batch, in the JVM and in Python.
ARROW_ROWS, _ARROW_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Let the executors' Python import this library, once a Spark application (``--py-files`` does the same).

    Where the session leaves Spark's batch size for short rows (10,000) as it is, batches are made smaller.
    """
    if spark.conf.get(_ARROW_SETTING, "10000") == "10000":
        spark.conf.set(_ARROW_SETTING, str(ARROW_ROWS))
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if top in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_callrank_shipped", False):
        return
    folder = tempfile.TemporaryDirectory()  # the driver's own, which serves the file to executors until it ends
    with zipfile.ZipFile(f"{folder.name}/callrank_code.zip", "w") as archive:
        for base, _, names in os.walk(f"{top}/callrank"):
            for name in names:
                if name.endswith(".py"):
                    archive.write(f"{base}/{name}", os.path.relpath(f"{base}/{name}", top))
    context.addPyFile(f"{folder.name}/callrank_code.zip")
    context._callrank_shipped = folder


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less those columns: outputs replace input columns of the same name."""
    return df.drop(*names)


def by_size(texts: list, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``most`` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array) -> list:
    """Python values of a text or binary column, null as empty."""
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    return [empty if v is None else v for v in column.to_pylist()]
