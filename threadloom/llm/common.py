"""What the operators of this subpackage share: Arrow batches of bounded size, text input, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.staging import Scratch

__all__ = ["ASCII_SPACE", "Scratch", "arrow_schema", "as_batches", "beside_text", "column", "map_batches", "split_by", "text_of", "trim", "tune", "with_text"]

#: Deleted by ``bytes.split()`` and by the contracts' class ``[\x20\x09-\x0D]`` alike.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't fill a worker's memory, and send the sources to the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def text_of(column: str) -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def column(name: str, of: str = "") -> Column:
    """A column, or a field of the struct ``of``, whatever its name."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def trim() -> None:
    """Give memory that this worker process has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def beside_text(docs: DataFrame, text_col: str) -> DataFrame:
    """row (a struct of all other columns, whatever their names) and text, for functions that filter Arrow batches."""
    return docs.select(F.struct(*(column(c) for c in docs.columns if c != text_col)).alias("row"), column(text_col).alias("text"))


def with_text(rows: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """The documents again from ``beside_text``'s rows."""
    return rows.select(*((F.col("text") if c == text_col else column(c, "row")).alias(c) for c in columns))


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` maps one Arrow batch to a dict of columns (or None); whole batches stay in Arrow."""
    spark = df.sparkSession
    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from as_batches(function(batch), arrow)
        trim()

    return df.mapInArrow(run, target)


def as_batches(columns: dict | None, schema: pa.Schema, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows from equally long columns."""
    if columns:
        arrays = [
            c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
            for f, c in ((f, columns[f.name]) for f in schema)
        ]
        table = pa.Table.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, schema)], schema=schema)
        yield from (b for b in table.to_batches(max_chunksize=rows) if b.num_rows)


def arrow_schema(spark: SparkSession, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = spark.createDataFrame([], schema).schema
    return target, to_arrow_schema(target)


#: Words of 64 bits that a filter of keys has at most: 8 MB, broadcast.
FILTER_WORDS = 1 << 20


def split_by(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is certainly not among ``keys``, all other rows), without a shuffle of rows. keys: h (long), a scratch table.

    A Bloom filter of 32 bits a key, of FILTER_WORDS words at most, travels to the rows. Beyond what that holds (some
    ten million keys) more rows than necessary are among the others, all of them in the end, which no result depends on.
    Columns may have any names.
    """
    words = min(FILTER_WORDS, max(1, keys.count() // 2))
    bit = lambda h, k: F.expr("shiftleft(1L, cast(shiftrightunsigned({h}, {k}) & 63 as int))".format(h=h, k=k))
    mask = lambda h: bit(h, 40).bitwiseOR(bit(h, 46)).bitwiseOR(bit(h, 52))
    word = lambda h: F.expr(f"pmod({h}, {words}L)")
    table = keys.groupBy(word("h").alias("word")).agg(F.bit_or(mask("h")).alias("bits"))
    at = rows.select(F.struct(*map(column, rows.columns)).alias("row"), key.alias("h"))
    at = at.withColumn("word", word("h")).join(F.broadcast(table), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(mask("h")) == mask("h"), F.lit(False))
    return tuple(at.where(c).select("row.*") for c in (~may, may))
