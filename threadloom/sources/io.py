"""Sources and sinks: message dumps in CSV, tables in Parquet or CSV, JSON summaries, settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..plans.staging import Scratch
from . import quoted
from .messages import RAW_COLUMNS

CORRUPT = "_corrupt"


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """``df`` itself, if it has the columns; checked before anything runs."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"{what} lacks {', '.join(lacking)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system exists."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Empty strings and the usual literals for missing values become null in string columns."""
    tokens = ["", *V.MISSING]
    return df.select(
        *(
            F.when(~F.col(f.name).isin(tokens), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema
        )
    )


def read_messages(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, malformed records) of a CSV dump with a header; all columns are strings.

    A quoted field may hold line breaks; files are split all the same. The dump is read and parsed once, into a scratch
    table that both results read. A header with other columns raises MissingColumns.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    scratch = Scratch(spark, "messages")
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*RAW_COLUMNS, CORRUPT]])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    record = F.from_csv("value", ", ".join(f"{f.name} string" for f in fields), options)
    rows = quoted.records(spark, path, split_bytes).select(quoted.first_of_file().alias("header"), record.alias("r"))
    parsed = scratch.write(rows.select("header", "r.*"), "parsed")
    for header in parsed.where("header").drop("header").distinct().limit(2).collect():
        if list(header)[:-1] != RAW_COLUMNS or header[CORRUPT]:
            raise MissingColumns(f"the header of {path} isn't {', '.join(RAW_COLUMNS)}")
    rows = parsed.where("not header")
    good = missing_to_null(rows.where(F.col(CORRUPT).isNull()).select(*RAW_COLUMNS))
    return good.select(*(columns or RAW_COLUMNS)), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


_TYPES = ["int", "bigint", "double", "timestamp", "boolean"]


def sampled_types(spark: SparkSession, path: str, rows: int = 5000) -> list[tuple[str, str]]:
    """Names and inferred types of the first rows of a CSV file; the limit is the feature. A column without a value is a string."""
    sample = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).limit(rows)
    fits = lambda c, t: F.count(F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(), 1)) == 0
    checks = [F.struct((F.count(f"`{c}`") > 0).alias("any"), *(fits(c, t).alias(t) for t in _TYPES)) for c in sample.columns]
    found = sample.agg(*(x.alias(f"c{k}") for k, x in enumerate(checks))).first()
    return [(c, next((t for t in _TYPES if x["any"] and x[t]), "string")) for c, x in zip(sample.columns, found)]


def generated_at() -> str:
    """The time, in UTC, to the second, as summaries and reports state it."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S+00:00")


def megabytes(n_bytes: int) -> float:
    return round(n_bytes / (1024 * 1024), 2)


def size_in_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder, on any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or the CSV of the same name where that is missing."""
    if exists(spark, path):
        return spark.read.parquet(path) if not path.endswith(".csv") else spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"').csv(path)
    other = path.removesuffix(".parquet") + ".csv"
    if path.endswith(".parquet") and exists(spark, other):
        return read_table(spark, other)
    raise FileNotFoundError(path)


def write_table(df: DataFrame, path: str) -> dict:
    """CSV, and Parquet beside it; a failure of the latter is noted, not raised."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}.csv")
    try:
        df.write.mode("overwrite").parquet(f"{path}.parquet")
    except Exception as e:
        return {"csv": f"{path}.csv", "parquet": None, "note": f"Parquet not written ({type(e).__name__})"}
    return {"csv": f"{path}.csv", "parquet": f"{path}.parquet", "note": ""}


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row table of structs as JSON; nulls stay."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A nested summary of small collected figures as one line of JSON."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """A Markdown report as one text file, its lines in order."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Settings:
    """The configuration; ``api_key`` is kept out of its text."""

    brand: str | None = None
    seed: int = 42
    model: str = "mock"
    url: str | None = None
    api_key: str | None = field(default=None, repr=False)

    def key(self) -> str:
        if not self.api_key:
            raise RuntimeError("no API key is set; use the mock client")
        return self.api_key


def load_settings(path: str | None = None, env: dict | None = None) -> Settings:
    """From a JSON file (its absence is allowed) and environment variables LLM_API_KEY, LLM_MODEL and LLM_URL."""
    env = os.environ if env is None else env
    found = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    return Settings(
        brand=found.get("brand"), seed=int(found.get("seed", 42)), model=env.get("LLM_MODEL") or found.get("model", "mock"),
        url=env.get("LLM_URL") or found.get("url"), api_key=env.get("LLM_API_KEY"),
    )
