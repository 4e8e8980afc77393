"""Ranked lexical search: document-at-a-time heap merge over compressed postings, shard by shard.

1. ``build_index`` cuts the documents, where they lie, into shards of bounded text. Documents of a shard are
   numbered in the order of their ids; a term's postings are these numbers, as differences, and the term's
   counts, both as variable-length bytes. No text and no posting shuffles for it.
2. ``search`` takes the items in blocks of bounded size. Of the index it reads the postings of the block's
   terms. In each shard a heap of cursors walks an item's postings in the order of the documents, all terms of
   one document at a time, into a bounded heap of the best (score, then smallest id), which a task keeps from
   shard to shard. Terms that even together can't lift a document into that heap aren't walked but looked up
   for the documents that the other terms name; that is exact, since a term's greatest gain is known.
3. Each task's best meet, at most ``k`` an item and task, and are ranked.

A term that a third of all documents hold is as many short lists as there are shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, as_batches, column, text_of, trim, tune

#: ASCII but digits and letters separates terms; A-Z become a-z.
_TERMS = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))
SHARD_BYTES = 16 << 20  # of text
ITEMS, ITEM_BYTES = 2048, 4 << 20  # of a block of items, about
#: The id under which documents without one are ranked: after all others.
LAST = (1 << 63) - 1
INDEX = "shard long, term string, n long, total long, docs binary, counts binary"
RESULT = "item_id {item}, doc_id long, score long"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many of each): seven bits a byte, lowest first; the high bit says that more follow."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        sizes += (values >> np.uint64(shift)) > 0
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = sizes > k
        more = (sizes[at] > k + 1).astype(np.uint8) << 7
        out[first[at] + k] = ((values[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    """The values that ``packed`` has written, as int64."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def shard_columns(shard: int, ids: np.ndarray, lengths: np.ndarray, words: pa.ChunkedArray) -> dict:
    """The rows of one shard: under the term "" its ids and lengths, then each term's postings."""
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    coded = words.combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    sort = pc.sort_indices(coded.dictionary)
    place = np.empty(len(sort), np.int64)
    place[sort.to_numpy()] = np.arange(len(sort))
    at = place[coded.indices.to_numpy(zero_copy_only=False)] * len(ids) + np.repeat(number, lengths)
    at.sort()
    head = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(np.append(head, len(at)))
    term, doc = np.divmod(at[head], max(1, len(ids)))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    df = np.diff(np.append(first, len(term)))
    columns = []
    for values in (step, count):
        data, sizes = packed(values)
        columns.append(_binary(data, np.add.reduceat(sizes, first) if len(first) else sizes))
    header, sizes = packed(lengths[order])
    names = coded.dictionary.take(sort).cast(pa.string())
    return {
        "shard": np.full(len(names) + 1, shard), "term": pa.concat_arrays([pa.array([""]), names]),
        "n": np.concatenate([[int((lengths > 0).sum())], df]),
        "total": np.concatenate([[len(at)], np.add.reduceat(count, first) if len(first) else count]),
        "docs": pa.concat_arrays([pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), columns[0]]),
        "counts": pa.concat_arrays([pa.array([header.tobytes()], pa.binary()), columns[1]]),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, path: str | None = None) -> DataFrame:
    """The index, a table at ``path`` (a scratch table without one): shard, term, n, total, docs, counts.

    A row for each shard and term: n documents hold it, total times in all; the row of the term "" has the shard's ids and
    lengths. A term is a run of ASCII letters and digits and other characters beyond ASCII, A-Z lower-cased. Null and empty
    texts have none. Every row is a document of its own, whatever its id, which must be an integer or null. A text longer than
    a shard is a shard. Other columns are ignored. No documents: no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    narrow = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(LAST)).alias("d"), text_of(text_col).alias("text"))
    target, arrow = arrow_schema(spark, INDEX)

    def run(batches):
        from pyspark import TaskContext

        name, ids, lengths, words, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            flat, n = [], []
            for text in b.column(1).to_pylist():
                found = terms_of(text)
                n.append(len(found))
                flat += found
            ids.append(b.column(0).to_numpy())
            lengths.append(np.array(n, np.int64))
            words.append(pa.array(flat, pa.binary()))
            size += b.column(1).nbytes
            if size >= shard_bytes:
                yield from as_batches(shard_columns(name, np.concatenate(ids), np.concatenate(lengths), pa.chunked_array(words)), arrow, 1 << 14)
                name, ids, lengths, words, size = name + 1, [], [], [], 0
        if ids and sum(map(len, ids)):
            yield from as_batches(shard_columns(name, np.concatenate(ids), np.concatenate(lengths), pa.chunked_array(words)), arrow, 1 << 14)
        trim()

    index = narrow.mapInArrow(run, target)
    if path is None:
        return Scratch(spark, "lexical").write(index, "index")
    index.write.mode("overwrite").parquet(path)
    return spark.read.schema(target).parquet(path)


def best_of(lists: list[tuple[int, list, list]], ids: list, best: list, k: int) -> None:
    """Merge an item's postings of one shard, document by document, into ``best``, a heap of (score, -id) of at most k.

    lists: (greatest gain, documents in ascending order, gains) of each term.
    """
    lists = sorted(lists, key=lambda x: x[0])
    docs, gains = [x[1] for x in lists], [x[2] for x in lists]
    upto, total = [], 0  # what the lists up to each one give at most
    for x in lists:
        total += x[0]
        upto.append(total)
    n, first, full = len(lists), 0, len(best) >= k
    while full and first < n and upto[first] < best[0][0]:
        first += 1
    at = [0] * n
    heap = [(docs[j][0], j) for j in range(first, n)]
    heapify(heap)
    while heap:
        doc, score, named = heap[0][0], 0, False
        while heap and heap[0][0] == doc:
            j = heap[0][1]
            if j < first:  # from now on only looked up
                heappop(heap)
                continue
            i = at[j]
            score += gains[j][i]
            named = True
            at[j] = i = i + 1
            if i < len(docs[j]):
                heapreplace(heap, (docs[j][i], j))
            else:
                heappop(heap)
        if not named:
            continue
        for j in range(first - 1, -1, -1):
            if score + upto[j] < best[0][0]:
                break
            at[j] = i = bisect_left(docs[j], doc, at[j])
            if i < len(docs[j]) and docs[j][i] == doc:
                score += gains[j][i]
        else:
            if score > 0:
                key = (score, -ids[doc])
                if not full:
                    heappush(best, key)
                    full = len(best) >= k
                elif key > best[0]:
                    heapreplace(best, key)
                while full and first < n and upto[first] < best[0][0]:
                    first += 1


class ShardSearch:
    """The items of a block against one shard after another; the best of each stay from shard to shard."""

    def __init__(self, items: list[list[str]], weights: dict[str, int], n: int, total: int, k: int):
        self.items, self.weights, self.n, self.total, self.k = items, weights, n, total, k
        self.best: list[list] = [[] for _ in items]

    def shard(self, rows: pa.Table) -> None:
        """rows: term, docs and counts of one shard."""
        names = rows.column("term").to_pylist()
        head = names.index("")
        ids = np.frombuffer(rows.column("docs")[head].as_py(), "<i8").tolist()
        lengths = unpacked(np.frombuffer(rows.column("counts")[head].as_py(), np.uint8))
        rows = rows.filter(pa.array([bool(x) for x in names]))
        names = [x for x in names if x]
        if not names:
            return
        joined = lambda c: unpacked(np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8))
        step, tf = joined("docs"), joined("counts")
        df = rows.column("n").to_numpy()
        first = np.cumsum(df) - df
        run = np.cumsum(step)
        doc = run - np.repeat(run[first] - step[first], df)
        m = 100 - 50 + (50 * lengths * self.n) // self.total
        gain = np.repeat(np.array([self.weights[x] for x in names], np.int64), df) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        most = np.maximum.reduceat(gain, first).tolist()
        at = {x: j for j, x in enumerate(names)}
        lists: dict[int, tuple] = {}

        def postings(j: int) -> tuple:
            if j not in lists:
                a, b = int(first[j]), int(first[j] + df[j])
                lists[j] = (most[j], doc[a:b].tolist(), gain[a:b].tolist())
            return lists[j]

        for item, best in zip(self.items, self.best):
            found = [postings(at[x]) for x in item if x in at]
            if found:
                best_of(found, ids, best, self.k)


def item_blocks(items: DataFrame, item_col: str, text_col: str, most: int = ITEMS, most_bytes: int = ITEM_BYTES):
    """Lists of (id, terms), each of about ``most`` items and ``most_bytes`` of text; more items are more blocks."""
    narrow = items.select(column(item_col).alias("item"), text_of(text_col).alias("text"))
    count, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(count / most), math.ceil(size / most_bytes))
    for k in range(n):
        terms: dict = {}
        for r in narrow.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).distinct().collect():
            terms.setdefault(r.item, set()).update(x.decode("utf-8", "surrogatepass") for x in terms_of(r.text))
        yield sorted(((i, sorted(t)) for i, t in terms.items()), key=lambda x: (x[0] is not None, x[0]))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = 50, block: int = ITEMS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k best documents of each item with a score above 0.

    With N documents that have a term, L terms in all of them, n in one, df documents with a term and tf of it in one:
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and the score is the sum of
    w ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms. Equal scores: smaller doc_id first, null last. Rows
    that repeat an item_id (null included) are one item with the terms of all; an item without a known term gives no rows, and no documents or no
    items give none. Other columns are ignored.
    """
    spark = index.sparkSession
    tune(spark)
    target, arrow = arrow_schema(spark, RESULT.format(item=items.schema[item_col].dataType.simpleString()))
    n, total = index.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    out = spark.createDataFrame([], target)
    for asked in item_blocks(items, item_col, text_col, block) if n else ():
        names = sorted({t for _, terms in asked for t in terms})
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in ["", *names]], "term string"))  # of one block
        found = index.join(wanted, "term", "left_semi")
        df = {r.term: r.df for r in found.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df")).collect()}  # of its terms
        weights = {t: weight(n, x) for t, x in df.items()}
        sent = spark.sparkContext.broadcast(([i for i, _ in asked], [[t for t in terms if t in weights] for _, terms in asked], weights))

        def run(batches, sent=sent, n=n, total=total):
            ids, terms, weights = sent.value
            work, held = ShardSearch(terms, weights, n, total, k), []
            for b in batches:
                while b.num_rows:  # a shard's rows come together and may span batches
                    shard = b.column(0).to_numpy()
                    if held and held[0].column(0)[0].as_py() != shard[0]:
                        work.shard(pa.Table.from_batches(held))
                        held = []
                    cut = int(np.searchsorted(shard, shard[0], side="right"))
                    held.append(b.slice(0, cut))
                    b = b.slice(cut)
            if held:
                work.shard(pa.Table.from_batches(held))
            rows = [(i, None if -d == LAST else -d, s) for i, best in zip(ids, work.best) for s, d in best]
            if rows:
                yield from as_batches(dict(zip(("item_id", "doc_id", "score"), map(list, zip(*rows)))), arrow)
            trim()

        postings = found.select("shard", "term", "n", "docs", "counts").repartition("shard").sortWithinPartitions("shard")
        out = out.unionByName(postings.mapInArrow(run, target))
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM len, total),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
score AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
          FROM item JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 50
"""
