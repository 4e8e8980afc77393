"""CSV records whose quoted fields may hold line breaks, read by many tasks however few the files.

A file is split by bytes and read as lines. What a line does depends on whether it begins inside a quoted field, which the split
alone doesn't tell. So each split is read as if it began outside, and notes how it would end from either beginning: two bits. These
bits compose along a file, which tells how each split really begins. The few that begin inside a field are put
together anew, from the lines that they have; and the parts of a record that splits have cut are joined.

The scan runs once, into a scratch table, so that all steps see the same splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shipping import ship
from ..plans.staging import Scratch

#: Of a split's rows: a record as text (``open`` if it goes on in the next split, ``goes_on`` if it began in one before), or, without
#: a value, how the split ends if it begins outside and if it begins inside a quoted field.
ROWS = "file long, split long, nth long, value string, open boolean, goes_on boolean, outside boolean, inside boolean"

#: Bytes of a split, at most.
SPLIT = 16 << 20


def _bytes(spark: SparkSession, size: str) -> int:
    """A setting such as "128m" in bytes."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, by whether it begins inside one. A quote opens only where a field begins."""
    i, n = 0, len(line)
    while True:
        if not inside:  # i is where a field begins
            if not line.startswith('"', i):
                i = line.find(',"', i)
                if i < 0:
                    return False
                i += 1
            i += 1
        inside = False
        while True:  # i is within a quoted field
            j = line.find('"', i)
            if j < 0:
                return True
            if j + 1 < n and line[j + 1] == '"':
                i = j + 2
                continue
            break
        i = line.find(",", j + 1)
        if i < 0:
            return False
        i += 1


class Assembler:
    """Records of one split from its lines, for a known or assumed beginning."""

    def __init__(self, file: int, split: int, inside: bool):
        self.file, self.split, self.state, self.nth, self.held = file, split, inside, 0, []
        self.goes_on = inside
        self.ends = [False, True]  # of a beginning outside, inside

    def line(self, line: str) -> Iterator[tuple]:
        if '"' in line:
            a, b = ends_inside(line, False), ends_inside(line, True)
            self.ends = [b if x else a for x in self.ends]
            self.state = b if self.state else a
        self.held.append(line)
        if not self.state:
            yield self.record(False)

    def record(self, open_: bool) -> tuple:
        value, goes_on = "\n".join(self.held), self.goes_on
        self.nth, self.held, self.goes_on = self.nth + 1, [], False
        return self.file, self.split, self.nth - 1, value, open_, goes_on, None, None

    def end(self) -> Iterator[tuple]:
        if self.held:
            yield self.record(True)
        yield self.file, self.split, None, None, None, None, *self.ends


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _schema(spark: SparkSession) -> tuple[T.StructType, pa.Schema]:
    target = spark.createDataFrame([], ROWS).schema
    return target, to_arrow_schema(target)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of every split, each as if it began outside a quoted field."""
    target, arrow = _schema(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            rows: list[tuple] = []
            for file, split, value in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or (now.file, now.split) != (file, split):
                    rows += now.end() if now else ()
                    now = Assembler(file, split, False)
                rows += now.line(value)
            if rows:
                yield _batch(rows, arrow)
        if now:
            yield _batch(list(now.end()), arrow)

    return lines.mapInArrow(run, target)


def beginnings(ends: DataFrame) -> DataFrame:
    """file, split, begins (inside a quoted field). ends: file, split, outside, inside; a row for each split.

    A split that ends alike from either beginning settles all before it; from there on those that turn the state over are counted.
    """
    along = Window.partitionBy("file").orderBy("split")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(along)
    settled = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("to"), "turns"))
    rows = ends.withColumn("turns", turns).withColumn("settled", settled)
    last, seen = F.last("settled", ignorenulls=True).over(before), F.last("turns").over(before)
    odd = lambda n: n % 2 == 1
    begins = F.when(last.isNull(), odd(F.coalesce(seen, F.lit(0)))).otherwise(last["to"] != odd(seen - last["turns"]))
    return rows.select("file", "split", begins.alias("begins"))


def again(rows: DataFrame) -> DataFrame:
    """The records of splits that begin inside a quoted field. rows: their records as if they began outside; together they are the split's lines.

    A split's rows come in order and pass one by one, so that a task holds no more than the record that it is at.
    """
    target, arrow = _schema(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out: list[tuple] = []
            for file, split, value in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
                if now is None or (now.file, now.split) != (file, split):
                    out += [r for r in now.end() if r[3] is not None] if now else ()
                    now = Assembler(file, split, True)
                for line in value.split("\n"):
                    out += now.line(line)
            if out:
                yield _batch(out, arrow)
        out = [r for r in now.end() if r[3] is not None] if now else []
        if out:
            yield _batch(out, arrow)

    return rows.select("file", "split", "nth", "value").repartition("file", "split").sortWithinPartitions("file", "split", "nth").mapInArrow(run, target)


def joined(parts: DataFrame) -> DataFrame:
    """Records that splits have cut. parts: those that are open or go on. A part that doesn't go on begins a record."""
    along = Window.partitionBy("file").orderBy("split", "nth")
    marked = parts.withColumn("record", F.sum((~F.col("goes_on")).cast("int")).over(along))
    each = F.array_sort(F.collect_list(F.struct("split", "nth", "value")))
    whole = marked.groupBy("file", "record").agg(each.alias("x"))
    first = F.col("x")[0]
    return whole.select("file", first["split"].alias("split"), first["nth"].alias("nth"), F.array_join(F.col("x.value"), "\n").alias("value"))


def records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """file, split, nth, value: each record of the CSV files at ``path``, as text; the order is that of file, split and nth.

    Fields are quoted by double quotes, which are doubled within them; a quote within a field that doesn't begin with one is text, as is what
    follows a closing quote up to the next comma. Lines end in "\\n" or "\\r\\n". An open quote at the end of a file leaves the rest as one record. Blank
    lines outside fields go. ``split_bytes``: the size of a split, else the session's; SPLIT at most, since one record may take a whole split.
    """
    ship(spark)
    scratch, setting = Scratch(spark, "csv"), "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(min(SPLIT, split_bytes or _bytes(spark, usual))))
        rows = scratch.write(scanned(spark, path), "records")
    finally:
        spark.conf.set(setting, usual)
    begins = beginnings(rows.where("value is null").select("file", "split", "outside", "inside")).where("begins").select("file", "split")
    begins = F.broadcast(scratch.write(begins, "begins"))  # of the splits, a row for 128 MB each, those that begin inside a field
    told = rows.where("value is not null")
    right = told.join(begins, ["file", "split"], "left_anti").unionByName(again(told.join(begins, ["file", "split"], "left_semi")))
    cut = F.col("open") | F.col("goes_on")
    out = right.where(~cut).select("file", "split", "nth", "value").unionByName(joined(right.where(cut)))
    return out.withColumn("value", F.regexp_replace("value", "\r$", "")).where("trim(value) <> ''")


def first_of_file() -> Column:
    """Whether a record is its file's first, the header."""
    return (F.col("split") == 0) & (F.col("nth") == 0)
