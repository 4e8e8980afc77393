"""Line dedup over a suffix array of line ids, built by distributed prefix doubling.

A run of lines counts as repeated if it holds at least ``min_words`` words and an identical
run starts earlier in the corpus (by doc_id, then line number). Every line of a later copy of
a maximal repeated run is deleted.

1. Lines become 128-bit ids. A line whose id occurs once cannot be part of a repeated run, so
   each document falls into segments of repeated lines; segments with too few words drop out.
2. Identical segments collapse: the first stays, and the others are later copies as a whole.
   This keeps groups of copies of any size out of the suffix array.
3. Prefix doubling ranks the suffixes that are left: the rank of 2^(k+1) lines is the place of
   the pair of ranks of its halves in sorted order. Suffixes whose rank is unique leave.
4. Suffixes that agree over their first lcp lines form an interval of the suffix array, named by
   the ranks of the two overlapping 2^k-blocks that cover those lines. The table of intervals has
   a row for each: name, lcp, number of suffixes, first start in the corpus. A maximal repeated run
   of at least ``min_words`` words is the union of the shortest such runs that start, and that end,
   at each of its lines; so the intervals of those runs' lengths are all that deletions need. A run
   is a later copy if its interval's first start is another one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, as_batches, column, split_by, trim, tune


def _kind(df: DataFrame) -> str:
    return df.schema["d"].dataType.simpleString()


def line_rows(docs: DataFrame) -> DataFrame:
    """d, t, i, id (16 bytes), w: one row per line of each document. docs: d, t, text."""
    target, arrow = arrow_schema(docs.sparkSession, f"d {_kind(docs)}, t long, i int, id binary, w int")

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            rows, i, ids, w = [], [], [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                rows += [k] * len(lines)
                i += range(len(lines))
                ids += [digest(x.strip()) for x in lines]
                w += [len(x.split()) for x in lines]
            at = pa.array(rows, pa.int32())
            yield from as_batches({"d": b.column(0).take(at), "t": b.column(1).take(at), "i": i, "id": ids, "w": w}, arrow)
        trim()

    return docs.mapInArrow(run, target)


def _shortest_runs(w: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of at least ``least`` words that start, or that end, at each line."""
    total = np.concatenate([[0], np.cumsum(w)])
    n = len(w)
    ends = np.searchsorted(total, total[:n] + least)  # first end with enough words
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    out = {(s, int(e)) for s, e in enumerate(ends) if e <= n}
    return sorted(out | {(int(s), e + 1) for e, s in enumerate(starts) if s >= 0})


def segment_rows(repeated: DataFrame, least: int) -> DataFrame:
    """d, t, start, n, key, ids, starts, ends: segments of adjacent repeated lines with enough words.

    repeated: one row per document with ``lines``, an array of (i, id, w). A row is as long as its document.
    """
    target, arrow = arrow_schema(
        repeated.sparkSession,
        f"d {_kind(repeated)}, t long, start int, n int, key binary, ids binary, starts array<int>, ends array<int>",
    )

    def run(batches):
        for b in batches:
            out = {f.name: [] for f in arrow}
            for d, t, lines in zip(*(b.column(k).to_pylist() for k in range(3))):
                lines = sorted({(x["i"], x["id"], x["w"]) for x in lines})
                i = np.array([x[0] for x in lines])
                for part in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(i) != 1) + 1):
                    w = np.array([lines[k][2] for k in part])
                    if len(part) and w.sum() >= least:
                        ids = b"".join(lines[k][1] for k in part)
                        runs = _shortest_runs(w, least)
                        row = (d, t, int(i[part[0]]), len(part), xxhash.xxh3_128_digest(ids), ids,
                               [s for s, _ in runs], [e for _, e in runs])
                        for name, x in zip(out, row):
                            out[name].append(x)
            yield from as_batches(out, arrow, rows=2048)
        trim()

    return repeated.mapInArrow(run, target)


def ranked(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``rank``, its place in sorted order: range partitions, numbered from their sizes."""
    spark = pairs.sparkSession
    keys = pairs.columns
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    target, arrow = arrow_schema(spark, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", part int, nth long")

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield from as_batches(
                {k: b.column(j) for j, k in enumerate(keys)} | {"part": [part] * n, "nth": pa.array(np.arange(seen, seen + n))}, arrow
            )
            seen += n

    placed = scratch.write(pairs.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(number, target), "ranks")
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    return placed.join(offsets, "part").select(*keys, (F.col("before") + F.col("nth")).alias("rank"))


def doubled(scratch: Scratch, level: DataFrame, size: int) -> DataFrame:
    """Ranks of blocks of 2 x size lines (d, t, i, stop, rank), of those that occur more than once."""
    second = level.select("d", "t", (F.col("i") - size).alias("i"), F.col("rank").alias("b"))
    pairs = scratch.write(
        level.where(F.col("i") + 2 * size <= F.col("stop"))
        .join(second, ["d", "t", "i"])
        .select("d", "t", "i", "stop", F.col("rank").alias("a"), "b"),
        "pairs",
    )
    more = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    names = scratch.write(ranked(scratch, more), "names")
    out = scratch.write(pairs.join(names, ["a", "b"]).select("d", "t", "i", "stop", "rank"), "level")
    scratch.drop(pairs, names)
    return out


def lcp_intervals(suffixes: DataFrame) -> DataFrame:
    """The intervals of the suffix array of more than one suffix: a, b (the name), n (the lcp), size, first.

    suffixes: d, t, i (the start), n, and the ranks a and b of the blocks that cover n lines from there.
    """
    rows = suffixes.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("d", "t", "i")).alias("first"))
    return rows.where("size > 1")


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """d, t, start, n: runs of lines that repeat an earlier run. docs: d (not null), t, text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = scratch.write(line_rows(docs), "lines")
    repeats = scratch.write(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeats")
    of_doc = lines.join(repeats, "id").groupBy("d", "t").agg(F.collect_list(F.struct("i", "id", "w")).alias("lines"))
    segments = scratch.write(segment_rows(of_doc, min_words), "segments")
    scratch.drop(lines, repeats)
    place = F.struct("d", "t", "start")
    firsts = scratch.write(segments.groupBy("key").agg(F.min(place).alias("p")), "firsts")
    copies = (
        segments.select("d", "t", "start", "n", "key").join(firsts, "key").where(place != F.col("p")).select("d", "t", "start", "n")
    )
    kept = firsts.select("p.*").join(segments, ["d", "t", "start"])  # identical rows of `documents` give one segment twice
    kept = scratch.write(kept.dropDuplicates(["d", "t", "start"]), "kept")
    runs = scratch.write(
        kept.select("d", "t", "start", F.explode(F.arrays_zip("starts", "ends")).alias("r")).select(
            "d", "t", (F.col("start") + F.col("r.starts")).alias("i"), (F.col("r.ends") - F.col("r.starts")).alias("n")
        ),
        "runs",
    )
    longest = runs.agg(F.max("n")).first()[0]
    if longest is None:
        return copies
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    spread = kept.select("d", "t", "start", "n", "ids", at).select(
        "d", "t", (F.col("start") + F.col("k")).alias("i"), (F.col("start") + F.col("n")).alias("stop"),
        F.substring("ids", F.col("k") * 16 + 1, F.lit(16)).alias("id"),
    )
    spread = scratch.write(spread, "positions")
    more = spread.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    level = scratch.write(
        spread.join(scratch.write(ranked(scratch, more), "names"), "id").select("d", "t", "i", "stop", "rank"), "level"
    )
    found, size = [], 1
    while True:
        here = runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        tail = level.select("d", "t", F.col("i").alias("j"), F.col("rank").alias("b"))
        named = (
            here.join(level.select("d", "t", "i", F.col("rank").alias("a")), ["d", "t", "i"])
            .withColumn("j", F.col("i") + F.col("n") - size)
            .join(tail, ["d", "t", "j"])
            .select("d", "t", "i", "n", "a", "b")
        )
        named = scratch.write(named, "suffixes")
        table = scratch.write(lcp_intervals(named), "intervals")
        later = named.join(table, ["a", "b", "n"]).where(F.struct("d", "t", "i") != F.col("first"))
        found.append(scratch.write(later.select("d", "t", F.col("i").alias("start"), "n"), "later"))
        scratch.drop(named, table)
        if 2 * size > longest:
            break
        before, level = level, doubled(scratch, level, size)
        scratch.drop(before)
        size *= 2
    scratch.drop(level, spread)
    for f in found:
        copies = copies.unionByName(f)
    return copies


def line_results(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """row (a struct of all columns, whatever their names), n_lines, removed (sorted line numbers), clean (the text that stays).

    Lines are what "\\n" separates, compared without ASCII white space at either end. Documents come
    in the order of doc_id; rows that repeat an id come in the order of a hash of their text, and
    rows that repeat id and text count as one document (each gets its result). Rows with a null id or a null text are
    neither changed nor compared. A copy may overlap its source, as in a line repeated many times:
    then all but the first period goes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    text = column(text_col).cast("string")
    row = F.struct(*map(column, docs.columns))
    keyed = docs.select(row.alias("row"), column(id_col).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    copies = later_copies(keyed.where("d is not null and text is not null").select("d", "t", "text"), min_words)
    numbers = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1)))))
    removed = Scratch(spark, "lines").write(copies.groupBy("d", "t").agg(numbers.alias("removed")), "removed")
    # texts without a removal, most of them, don't shuffle
    plain, maybe = split_by(keyed, F.xxhash64("d", "t"), removed.select(F.xxhash64("d", "t").alias("h")))
    none = F.expr("cast(array() as array<int>)")
    met = maybe.join(removed, ["d", "t"], "left").withColumn("removed", F.coalesce("removed", none))
    out = plain.withColumn("removed", none).unionByName(met)
    lines = F.split("text", "\n", -1)
    out = out.withColumn("lines", lines).withColumn("n_lines", F.size(F.when(F.col("text").isNotNull(), F.col("lines")).otherwise(F.array())))
    # a removed line becomes null in an indexed pass over the lines; array_except keeps it linear
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("removed"))
    joined = F.array_join(F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    return out.select("row", "n_lines", "removed", F.when(F.size("removed") == 0, F.col("text")).otherwise(joined).alias("clean"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with all its columns, plus __n_lines, __removed and __clean, as ``line_results`` has them.

    Columns of ``docs`` with one of these three names are replaced; others may have any name. Nulls, empty texts, repeated rows and
    empty tables are as in ``line_results``.
    """
    results = {"__n_lines": "n_lines", "__removed": "removed", "__clean": "clean"}
    own = [column(c, "row") for c in docs.columns if c not in results]
    return line_results(docs, id_col, text_col, min_words).select(*own, *(F.col(c).alias(name) for name, c in results.items()))


def ranges(numbers) -> "F.Column":
    """Sorted line numbers as "first-last,first-last"."""
    zero = F.struct(F.lit("").alias("s"), F.lit(-2).alias("a"), F.lit(-2).alias("b"))
    shut = lambda x: F.when(x["a"] < 0, F.lit("")).otherwise(
        F.concat(F.when(x["s"] == "", "").otherwise(F.concat(x["s"], F.lit(","))), x["a"], F.lit("-"), x["b"])
    )
    step = lambda x, i: F.when(
        i == x["b"] + 1, F.struct(x["s"].alias("s"), x["a"].alias("a"), i.alias("b"))
    ).otherwise(F.struct(shut(x).alias("s"), i.alias("a"), i.alias("b")))
    return F.aggregate(numbers, zero, step, shut)
