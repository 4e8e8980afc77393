"""Blocks of postings: what a search reads where it lies, so that no posting moves.

A block holds some thousands of documents of similar words as one row: the documents, their terms with the largest
weight of each, and the postings. A search goes through the blocks of its task one by one, for many queries at once. Each
query has a bounded heap of its best documents, which lasts from block to block; a block whose terms at their largest
weights can't lift a document into it is skipped. The block that promises most comes first, in a pass of its own, so that
in all others a document must beat what was found there. Only the heaps leave the task.

Few queries need no stored blocks: ``search_texts`` makes a block of the next documents of a task, meets it and forgets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..plans.shipping import ship
from ..plans.staging import Scratch

#: A block's documents and postings, at most (but for a document that alone has more).
DOCS, POSTINGS = 8192, 1 << 18
#: Queries that travel to the tasks at once, and their terms.
QUERIES, QUERY_TERMS = 16384, 1 << 20
#: Tokens of the documents that become a block where they lie, at most (but for a document that alone has more).
TOKENS = 1 << 19
#: A term of more of a block's documents is added up for many queries at once.
RARE = 32
DIGITS = 9  # scores are compared after rounding, since sums of doubles depend on their order


def _schema(vectors: DataFrame, doc: str, tie: str) -> tuple[StructType, pa.Schema]:
    shape = vectors.sparkSession.createDataFrame([], "terms array<string>, most array<double>, sizes array<int>, places binary, weights binary").schema
    of = lambda name: f"array<{vectors.schema[name].dataType.simpleString()}>"
    keys = vectors.sparkSession.createDataFrame([], f"docs {of(doc)}, ties {of(tie)}").schema
    target = StructType([*keys, *shape])
    return target, to_arrow_schema(target)


def _block(rows: pa.Table, arrow: pa.Schema) -> pa.RecordBatch:
    """One block of the vectors doc, tie, terms, weights; its documents are in the order of tie, then doc."""
    rows = rows.sort_by([("tie", "ascending"), ("doc", "ascending")]).combine_chunks()
    column = lambda name: rows.column(name).combine_chunks() if isinstance(rows.column(name), pa.ChunkedArray) else rows.column(name)
    lists = column("terms")
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((place, code))
    weight = column("weights").flatten().to_numpy(zero_copy_only=False)[order]
    sizes = np.bincount(code, minlength=len(coded.dictionary))
    most = np.maximum.reduceat(weight, np.cumsum(sizes) - sizes)
    values = [
        column("doc"), column("tie"), coded.dictionary, pa.array(most), pa.array(sizes.astype(np.int32)),
        place[order].astype("<i4").tobytes(), weight.astype("<f8").tobytes(),
    ]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if isinstance(x, pa.Array) else pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays([one(x).cast(f.type) for x, f in zip(values, arrow)], schema=arrow)


def build(vectors: DataFrame, doc: str, tie: str, docs: int = DOCS, postings: int = POSTINGS) -> DataFrame:
    """docs, ties, terms, most, sizes, places, weights: a row per block. vectors: doc, tie, terms (most frequent first), weights.

    Documents are dealt by their most frequent terms, in order, so that a block's documents are alike; equal ones by tie
    and doc, so that any number of them is split. The keys must not be null.
    """
    spark = vectors.sparkSession
    ship(spark)
    target, arrow = _schema(vectors, doc, tie)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_postings = [], 0, 0
        for b in batches:
            while b.num_rows:
                ends = np.cumsum(np.diff(b.column(2).offsets.to_numpy()))
                cut = int(min(docs - n_docs, np.searchsorted(ends, postings - n_postings, side="right"), b.num_rows))
                if not cut and not held:
                    cut = 1  # a long document is a block of its own
                if cut:
                    held.append(b.slice(0, cut))
                    n_docs, n_postings, b = n_docs + cut, n_postings + int(ends[cut - 1]), b.slice(cut)
                if b.num_rows:
                    yield _block(pa.Table.from_batches(held), arrow)
                    held, n_docs, n_postings = [], 0, 0
        if held:
            yield _block(pa.Table.from_batches(held), arrow)

    shaped = vectors.where(F.size("terms") > 0).select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), "terms", "weights")
    near = _near()
    return shaped.repartitionByRange(near, "tie", "doc").sortWithinPartitions(near, "tie", "doc").mapInArrow(run, target)


class Queries:
    """A block of queries against one block of postings after another. Terms are strings, or hashes as ``kind`` says, like the blocks'."""

    def __init__(self, names: list, terms: list[list], weights: list[list[float]], k: int, min_score: float, kind: pa.DataType | None = None):
        self.names, self.k, self.min_score = names, k, min_score
        numbers: dict = {}
        self.flat = np.array([numbers.setdefault(t, len(numbers)) for x in terms for t in x], np.int64)
        self.vocabulary = pa.array(list(numbers), kind or pa.string())
        self.weights = np.array([w for x in weights for w in x], float)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int64)

    def begin(self, least: np.ndarray | None = None) -> None:
        """``least``: scores that a query's k documents elsewhere reach, NaN where it has fewer."""
        self.best: list[list[tuple]] = [[] for _ in self.names]
        known = np.full(len(self.names), np.nan) if least is None else least
        self.full = ~np.isnan(known)
        self.least = np.where(self.full, known, self.min_score)  # what a document must exceed, or equal once k are known
        self.scanned = 0  # (query, block) pairs that weren't skipped

    def bounds(self, block: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's terms lie in the block, and what a document of the block scores at most."""
        at = pc.index_in(self.vocabulary, value_set=block["terms"]).fill_null(-1).to_numpy()[self.flat]
        bound = np.where(at >= 0, self.weights * block["most"][at], 0.0)
        bound = np.concatenate([[0.0], np.cumsum(bound)])
        return at, bound[self.first[1:]] - bound[self.first[:-1]]

    def meet(self, block: dict, mine: np.ndarray | None = None) -> None:
        """``mine``: the queries that meet this block, else all.

        Terms of many of the block's documents are added up once for all queries that have them in the same proportion; what a
        query then adds are its rare terms.
        """
        at, bound = self.bounds(block)
        slack = 10.0**-DIGITS * len(self.flat) ** 0.5  # rounding, and the running sum
        wanted = (bound > 0) & (bound + slack >= self.least)
        if mine is not None:
            wanted &= mine
        asks = []
        for q in np.flatnonzero(wanted).tolist():
            a, b = self.first[q], self.first[q + 1]
            here, weight = at[a:b], self.weights[a:b]
            here, weight = here[here >= 0], weight[here >= 0]
            often = block["sizes"][here] > RARE
            scale = float(weight[often][0]) if often.any() else 1.0
            key = (here[often].tobytes(), np.round(weight[often] / scale, 12).tobytes())
            asks.append((key, q, scale, here[~often].tolist(), weight[~often].tolist()))
        asks.sort(key=lambda x: x[:2])  # so that one sum is held at a time
        last, common = None, None
        for key, q, scale, rare, weights in asks:
            self.scanned += 1
            if key != last:
                last, common = key, _Sum(block, np.frombuffer(key[0], at.dtype).tolist(), np.frombuffer(key[1]).tolist()) if key[0] else None
            found, score = _candidates(block, common, scale, rare, weights, self.k)
            keep = score >= self.least[q] if self.full[q] else score > self.min_score
            found, score = found[keep], score[keep]
            if len(found) > self.k:
                top = np.lexsort((found, -score))[: self.k]  # documents are in the order of ties
                found, score = found[top], score[top]
            if len(found):
                new = zip((-score).tolist(), block["ties"].take(found).to_pylist(), block["docs"].take(found).to_pylist())
                self.best[q] = sorted([*self.best[q], *new])[: self.k]
                if len(self.best[q]) >= self.k:
                    self.full[q], self.least[q] = True, max(-self.best[q][-1][0], self.least[q])


    def found(self, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """name, doc, tie, score of all heaps."""
        rows = [(n, d, t, -s) for n, best in zip(self.names, self.best) for s, t, d in best]
        for a in range(0, len(rows), 65536):
            columns = zip(*rows[a : a + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)


class _Sum:
    """The scores that some terms in fixed proportion give a block's documents, and these documents, best first."""

    def __init__(self, block: dict, at: list[int], parts: list[float]):
        self.score = np.zeros(len(block["docs"]))
        for j, w in zip(at, parts):
            lo, hi = block["starts"][j], block["starts"][j + 1]
            self.score[block["places"][lo:hi]] += w * block["weights"][lo:hi]
        level = np.round(self.score, 11)
        order = np.argsort(-level, kind="stable")
        self.order = order[: np.count_nonzero(level > 0)]
        self.down = -level[self.order]


def _candidates(block: dict, common: _Sum | None, scale: float, rare: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of a block's documents, among them the k best of one query."""
    if rare:
        spans = [(block["starts"][j], block["starts"][j + 1]) for j in rare]
        touched, which = np.unique(np.concatenate([block["places"][lo:hi] for lo, hi in spans]), return_inverse=True)
        more = np.bincount(which, np.concatenate([w * block["weights"][lo:hi] for w, (lo, hi) in zip(weights, spans)]), len(touched))
    else:
        touched, more = np.zeros(0, np.int64), np.zeros(0)
    if common is None:
        return touched, np.round(more, DIGITS)
    n = k + len(touched)
    if n < len(common.order):
        last = common.down[n - 1]
        end = int(np.searchsorted(common.down, last + 4 * 10.0**-DIGITS / scale, side="right"))
        if common.down[end - 1] != last:  # some score almost as much, and may be equal once they are rounded
            n = end
    rest = common.order[:n]
    if len(touched):
        rest = rest[~np.isin(rest, touched)]
    found = np.concatenate([touched, rest])
    return found, np.round(scale * common.score[found] + np.concatenate([more, np.zeros(len(rest))]), DIGITS)


def _read(row: dict) -> dict:
    """A block from its columns as Arrow scalars; of the summary only, where it has no more."""
    out = {"terms": row["terms"].values, "most": row["most"].values.to_numpy()}
    if "places" in row:
        sizes = row["sizes"].values.to_numpy()
        out |= {
            "docs": row["docs"].values, "ties": row["ties"].values, "sizes": sizes, "starts": np.concatenate([[0], np.cumsum(sizes)]).tolist(),
            "places": np.frombuffer(row["places"].as_py(), "<i4"), "weights": np.frombuffer(row["weights"].as_py(), "<f8"),
        }
    return out


def _near(terms: str = "terms"):
    """What documents and queries are sorted by, so that those of similar words lie together."""
    return F.array_join(F.slice(terms, 1, 8), " ")


def query_lists(vectors: DataFrame, most: int = QUERIES, most_terms: int = QUERY_TERMS) -> int:
    """In how many lists the queries travel."""
    count, terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    return max(-(-count // most), -(-terms // most_terms))


def query_blocks(vectors: DataFrame, name: str, most: int = QUERIES, most_terms: int = QUERY_TERMS) -> Iterator[list]:
    """The queries (name, terms, weights) in lists of about ``most``, similar ones together; more queries are more lists, each of bounded size."""
    n = query_lists(vectors, most, most_terms)
    rows = vectors.select(name, "terms", "weights")
    if n > 1:
        rows = rows.repartitionByRange(n, _near(), name).withColumn("list", F.spark_partition_id())
        rows = Scratch(vectors.sparkSession, "lists").write(rows, "lists")
    for k in range(n):
        mine = rows.where(F.col("list") == k) if n > 1 else rows
        if found := mine.collect():
            yield found


def _homes(blocks: DataFrame, sent) -> dict:
    """Of each query (by number) the block that promises most, named by its first document. Reads the blocks' summaries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, firsts = sent.value, []
        best, which = np.zeros(len(asked.names)), np.full(len(asked.names), -1)
        for b in batches:
            for i in range(b.num_rows):
                _, bound = asked.bounds(_read({c: b.column(c)[i] for c in ("terms", "most")}))
                which, best = np.where(bound > best, len(firsts), which), np.maximum(best, bound)
                firsts.append(b.column("home")[i].as_py())
        q = np.flatnonzero(which >= 0)
        rows = [pa.array(q, pa.int64()), pa.array(best[q]), pa.array([firsts[x] for x in which[q].tolist()], arrow.field("home").type)]
        yield pa.RecordBatch.from_arrays(rows, schema=arrow)

    summary = blocks.select("terms", "most", F.col("docs")[0].alias("home"))
    shape = blocks.sparkSession.createDataFrame([], "q long, bound double").schema
    target = StructType([*shape, summary.schema["home"]])
    arrow = to_arrow_schema(target)
    best = summary.mapInArrow(run, target).groupBy("q").agg(F.max(F.struct("bound", "home")).alias("x")).select("q", "x.home")
    return {r.q: r.home for r in best.collect()}


def search(blocks: DataFrame, vectors: DataFrame, name: str, k: int, min_score: float, keep) -> DataFrame:
    """name, doc, tie, score: of each query at least its k best documents (equal ones by tie, then doc), by task.

    Each query meets the block that promises most first. What its k best there score, the others must reach. ``keep`` writes a
    result into a scratch table; only one list of queries travels at a time.
    """
    spark = blocks.sparkSession
    ship(spark)
    inner = {f.name: f.dataType.elementType for f in blocks.schema if f.name in ("docs", "ties")}
    score = spark.createDataFrame([], "score double").schema["score"]
    target = StructType([vectors.schema[name], StructField("doc", inner["docs"]), StructField("tie", inner["ties"]), score])
    arrow = to_arrow_schema(target)
    out, kept, held = None, [], []

    def met(sent, homes, least=None) -> DataFrame:
        """Of all queries and blocks those pairs that are at home (``least`` is None), or all others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            asked.begin(least.value if least else None)
            for b in batches:
                for i in range(b.num_rows):
                    row = {c: b.column(c)[i] for c in b.schema.names}
                    at_home = homes.value.get(row["docs"].values[0].as_py())
                    mine = np.zeros(len(asked.names), bool)
                    if at_home is not None:
                        mine[at_home] = True
                    mine = ~mine if least else mine
                    if mine.any():
                        asked.meet(_read(row), mine)
            yield from asked.found(arrow)

        return blocks.mapInArrow(run, target)

    for rows in query_blocks(vectors, name):
        if out is not None:
            kept.append(keep(out))
            for x in held:
                x.unpersist()
        asked = Queries([r[0] for r in rows], [r.terms for r in rows], [r.weights for r in rows], k, min_score)
        sent, number, homes = spark.sparkContext.broadcast(asked), {n: q for q, n in enumerate(asked.names)}, {}
        for q, home in _homes(blocks, sent).items():
            homes.setdefault(home, []).append(q)
        homes = spark.sparkContext.broadcast({home: np.array(qs) for home, qs in homes.items()})
        kept.append(keep(met(sent, homes)))
        least = np.full(len(asked.names), np.nan)
        for r in kept[-1].groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
            least[number[r[0]]] = r.least
        held = [sent, homes, spark.sparkContext.broadcast(least)]
        out = met(*held)
    if out is None:
        return spark.createDataFrame([], target)
    return out.unionByName(spark.read.schema(target).parquet(*(t._scratch_path for t in kept)))


class Words:
    """Hashes of the vocabulary's terms, ascending, with df: what a task weighs its documents by. ``n``: documents in all."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n: int):
        self.hashes, self.df, self.n = hashes, df, n

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        """0 where a term isn't in the vocabulary."""
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, np.log((1 + self.n) / (1 + self.df[at].astype(float))) + 1, 0.0)


def _weighed(rows: pa.RecordBatch, words: Words) -> dict:
    """A block, as ``_read`` gives it, of the documents doc, tie, terms (hashes), times (how often each; null: once a place)."""
    rows = rows.take(pc.sort_indices(rows, [("tie", "ascending"), ("doc", "ascending")]))
    n, lists, times = rows.num_rows, rows.column("terms"), rows.column("times")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    hashes = coded.dictionary.to_numpy(zero_copy_only=False)
    idf, code = words.idf(hashes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at, known = code * n + np.repeat(np.arange(n), sizes), idf[code] > 0
    if times.null_count < n:
        often = np.ones(len(code))
        often[np.repeat(times.is_valid().to_numpy(zero_copy_only=False), sizes)] = times.flatten().to_numpy(zero_copy_only=False)
        at, which = np.unique(at[known], return_inverse=True)
        tf = np.bincount(which, often[known], len(at))
    else:
        at, tf = np.unique(at[known], return_counts=True)
    code, place = np.divmod(at, n)
    w = (1 + np.log(tf)) * idf[code]
    w /= np.sqrt(np.bincount(place, w * w, n))[place]
    here, sizes = np.unique(code, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    most = np.maximum.reduceat(w, starts[:-1]) if len(here) else w
    return {"terms": pa.array(hashes[here], pa.int64()), "most": most, "docs": rows.column("doc"), "ties": rows.column("tie"), "sizes": sizes,
            "starts": starts.tolist(), "places": place, "weights": w}


def _portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``most`` tokens together at most, or one row of more."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield b.slice(a, z - a)
            a = z


def search_texts(texts: DataFrame, words: Words, vectors: DataFrame, name: str, k: int, min_score: float, tokens: int = TOKENS) -> DataFrame:
    """name, doc, tie, score, as ``search`` gives them, in one pass over documents doc, tie, terms, times: nothing of them is written or moved.

    Terms are hashes, of documents and queries alike. All queries travel at once: see ``query_lists``.
    """
    spark = texts.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # of long texts; more than a portion isn't needed at once
    score = spark.createDataFrame([], "score double").schema["score"]
    target = StructType([vectors.schema[name], texts.schema["doc"], texts.schema["tie"], score])
    arrow = to_arrow_schema(target)
    rows = vectors.select(name, "terms", "weights").collect()
    asked = Queries([r[0] for r in rows], [r.terms for r in rows], [r.weights for r in rows], k, min_score, pa.int64())
    sent, known = spark.sparkContext.broadcast(asked), spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        asked.begin()
        for b in _portions(batches, tokens):
            block = _weighed(b, known.value)
            if len(block["terms"]):
                asked.meet(block)
        yield from asked.found(arrow)

    return texts.mapInArrow(run, target)
