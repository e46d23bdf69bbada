"""Reading the four CRM tables and writing and re-reading the ranked one."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.sources import schemas as S
from callrank.sources.staging import stage

RANKED_NAME = "scored_records"
REPORT_NAME = "run_report"


class CrmTables(NamedTuple):
    accounts: DataFrame
    leads: DataFrame
    contacts: DataFrame
    campaign_members: DataFrame


SCHEMAS = {
    "accounts": S.ACCOUNTS,
    "leads": S.LEADS,
    "contacts": S.CONTACTS,
    "campaign_members": S.CAMPAIGN_MEMBERS,
}


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Fail before any job starts when a needed column is missing."""
    if not isinstance(df, DataFrame):
        raise ValueError(f"{name}: a DataFrame is needed, got {type(df).__name__}")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _typed(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return column
    if isinstance(have, T.StringType) and isinstance(want, T.LongType):
        # A whole number with gaps is often written as 85.0.
        return F.coalesce(column.try_cast(want), column.try_cast("double").try_cast(want))
    return column.try_cast(want)


#: What stands for a missing value in exported text files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def _without_missing(df: DataFrame) -> DataFrame:
    """Text columns with null where a word for a missing value stands."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(
        [F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns]
    )


def malformed(raw: DataFrame, typed: DataFrame) -> list[str]:
    """SQL text of counts: values of a column that are given in ``raw`` and have no place in its type."""
    have = {f.name: f.dataType for f in raw.schema}
    return [
        f"count_if(`{f.name}` IS NOT NULL AND try_cast(`{f.name}` AS {'double' if isinstance(f.dataType, T.LongType) else f.dataType.simpleString()}) IS NULL) AS `{f.name}`"
        for f in typed.schema
        if have[f.name] != f.dataType
    ]


def conform(df: DataFrame, schema: T.StructType, own: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Give the known columns, and those of ``own``, their types by name; columns may be missing or in any order.

    A response that comes with its time of day keeps it: the days since are counted from it.
    """
    known = {f.name: f.dataType for f in df.schema}
    timed = (T.TimestampType, T.TimestampNTZType)
    if isinstance(known.get("response_date"), timed):
        fields = [
            T.StructField(f.name, known[f.name]) if f.name == "response_date" else f for f in schema
        ]
        schema = T.StructType(fields)
    wanted = [*schema, *[T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in own]]
    return df.select(
        [
            _typed(F.col(f.name), known[f.name], f.dataType).alias(f.name)
            for f in wanted
            if f.name in known
        ]
    )


def _load(
    spark: SparkSession, input_dir: str, file_format: str, multi_line: bool, own: Sequence[tuple[str, str]]
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each table as it is in its file and with the columns and types it should have."""
    if file_format not in ("csv", "parquet"):
        raise ValueError("input format is 'csv' or 'parquet'")
    if file_format == "csv" and multi_line:
        warnings.warn("multi_line: each CSV file is read by one task; turn it off if no record has a line break", stacklevel=3)
    loaded = {}
    for name in CrmTables._fields:
        path = f"{input_dir.rstrip('/')}/{name}.{file_format}"
        reader = spark.read
        if file_format == "csv":
            reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
        try:
            raw = reader.format(file_format).load(path)
        except AnalysisException as error:
            raise ValueError(f"input not found: {path}") from error
        if file_format == "csv":
            raw = _without_missing(raw)
        typed = conform(raw, SCHEMAS[name], own if name in ("leads", "contacts") else ())
        loaded[name] = raw, require_columns(typed, S.REQUIRED[name], name)
    return loaded


def _refuse(name: str, counts: Mapping[str, int]) -> None:
    bad = {c: n for c, n in counts.items() if n}
    if bad:
        raise ValueError(f"{name}: values that don't fit their column: {bad}")


def read_tables(
    spark: SparkSession,
    input_dir: str,
    file_format: str = "csv",
    multi_line: bool = True,
    on_malformed: str = "null",
    own: Sequence[tuple[str, str]] = (),
) -> CrmTables:
    """Load ``<input_dir>/<table>.<format>`` for the four tables, lazily.

    Column types come from our schemas, never from a look at the data. In CSV the words of ``MISSING`` are null, and
    ``multi_line`` keeps line breaks in quotes inside their record; without it, which quoted line breaks forbid, a file
    is split over tasks. A value that doesn't fit its column's type is null, or an error that names the column and the
    number of values if ``on_malformed`` is ``"fail"``. ``own`` names further columns of leads and contacts with their types.
    """
    if on_malformed not in ("null", "fail"):
        raise ValueError("on_malformed is 'null' or 'fail'")
    loaded = _load(spark, input_dir, file_format, multi_line, own)
    if on_malformed == "fail":
        for name, (raw, typed) in loaded.items():
            if counts := malformed(raw, typed):
                _refuse(name, raw.selectExpr(*counts).first().asDict())
    return CrmTables(*[typed for _, typed in loaded.values()])


def ingest(
    spark: SparkSession,
    input_dir: str,
    folder: str,
    file_format: str = "csv",
    multi_line: bool = True,
    on_malformed: str = "null",
    own: Sequence[tuple[str, str]] = (),
) -> tuple[CrmTables, dict[str, dict[str, int]]]:
    """The tables of ``read_tables``, written once as typed parquet in ``folder``, and per table and column how many values didn't fit.

    Text is parsed in one pass, which counts those values too; all that follows reads columns of known size.
    """
    tables, misfits = [], {}
    for name, (raw, typed) in _load(spark, input_dir, file_format, multi_line, own).items():
        counts = malformed(raw, typed)
        watch = Observation(f"ingest_{name}")
        # the counts are made on the rows as they are parsed, the types given after that
        watched = raw.observe(watch, *[F.expr(c) for c in counts]) if counts else raw
        schema = SCHEMAS[name]
        tables.append(stage(conform(watched, schema, own if name in ("leads", "contacts") else ()), name, folder))
        misfits[name] = {c: n for c, n in watch.get.items() if n} if counts else {}
        if on_malformed == "fail":
            _refuse(name, misfits[name])
    return CrmTables(*tables), misfits


def write_ranked(df: DataFrame, output_dir: str, file_format: str = "parquet") -> str:
    """Write the ranked table. ``rank`` is a column, so any number of files will do."""
    if file_format not in ("csv", "parquet"):
        raise ValueError("output format is 'csv' or 'parquet'")
    path = f"{output_dir.rstrip('/')}/{RANKED_NAME}.{file_format}"
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(file_format).save(path)
    return path


def write_report(spark: SparkSession, report: Mapping, output_dir: str) -> str:
    """Write the report of a run, one JSON row, beside the ranked table."""
    path = f"{output_dir.rstrip('/')}/{REPORT_NAME}.json"
    misfits = report.get("malformed", {})
    values = [F.lit(v).alias(name) for name, v in report.items() if name != "malformed"]
    pairs = [F.lit(x) for pair in misfits.items() for x in pair]
    found = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
    spark.range(1).select(*values, found.alias("malformed")).write.mode("overwrite").json(path)
    return path


def read_ranked(
    spark: SparkSession, output_dir: str, file_format: str = "parquet", schema: T.StructType = None
) -> DataFrame:
    """Re-read the ranked table for analytics; CSV needs its schema."""
    path = f"{output_dir.rstrip('/')}/{RANKED_NAME}.{file_format}"
    if file_format == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError("a schema is needed to read CSV")
    return conform(spark.read.option("header", True).option("escape", '"').csv(path), schema)
