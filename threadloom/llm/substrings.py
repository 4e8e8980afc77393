"""Substring dedup: suffix automata of reference shards, matching statistics, removal of what a long enough match covers.

A word goes if a window of ``window`` words around it, by sequence, also starts earlier in the corpus.

1. Each window is known by an anchor, the least hash among its short word sequences. Equal windows have equal anchors at the same
   place within, and neighbouring windows mostly share one; the words of windows that share one are a piece. Only
   windows whose anchor is found at two places can repeat; a Bloom filter of such anchors lets the others go without a shuffle.
2. Equal pieces collapse to the first; the others go whole. Where an anchor has different pieces, as around an edit, these are the
   reference. It is cut into shards by anchor, of about SHARD_WORDS words.
3. A shard's suffix automaton over words grows with its pieces in the order of the corpus, and each piece streams through it: the
   length of the suffix link at each word is the matching statistic, the longest stretch up to there that has
   been seen before. Where it reaches the window the window goes.

The automata aren't sent to all documents, since each document would then run through every shard; equal windows meet in one
shard, and only pieces that can match come to it. An anchor with more than HEAVY different pieces (a template whose words
around it change) is cut into single windows, which meet by their hash alone.

Words compare by 64-bit hashes, so two different windows would have to agree in all of their words' hashes to be taken for equal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, arrow_schema, as_batches, column, split_by, trim, tune

#: Words of an anchor's sequence, at most; windows of fewer words take half of theirs.
SEQUENCE = 8
SHARD_WORDS = 1 << 17
HEAVY = 4096
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(29))


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(_MIX[0]) + words[k : len(out) + k]
    return _mixed(out)


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of each window: the first of the least hashes of its sequences."""
    n = min(SEQUENCE, (window + 1) // 2)
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = sequences(words, n)
    width = window - n + 1
    place = np.arange(len(h) - width + 1)
    least, at = h[: len(place)].copy(), place.copy()
    for k in range(1, width):
        lower = h[k : len(place) + k] < least
        least[lower] = h[k : len(place) + k][lower]
        at[lower] = place[lower] + k
    return least, at


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of each run of equal values."""
    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
    return head, np.append(head[1:], len(x))[: len(head)] - 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _kind(df: DataFrame) -> str:
    return df.schema["d"].dataType.simpleString()


def _emit(rows: list[tuple], arrow: pa.Schema):
    if rows:
        yield from as_batches(dict(zip(arrow.names, map(list, zip(*rows)))), arrow, 2048)


def range_hashes(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the words from each ``first`` up to ``stop``: a polynomial over the words' hashes, modulo 2^64."""
    base, inverse = np.uint64(_MIX[0]), np.uint64(pow(_MIX[0], -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), base)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), inverse)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1])])
    return _mixed((total[stop] - total[first]) * back[first] + (stop - first).astype(np.uint64))


def pieces_of(words: np.ndarray, window: int, single: bool = False) -> tuple[np.ndarray, ...]:
    """(anchor, key, start, n) of each piece, or with ``single`` of each window."""
    v, at = anchors(words, window)
    first, last = (np.arange(len(at)),) * 2 if single else runs_of(at)  # the place never falls
    return v[first].view(np.int64), range_hashes(words, first, last + window).view(np.int64), first.astype(np.int32), (last - first + window).astype(np.int32)


def piece_rows(docs: DataFrame, window: int) -> DataFrame:
    """v, key, d, t, start, n: the pieces of all documents. docs: d, t, text."""
    target, arrow = arrow_schema(docs.sparkSession, f"v long, key long, d {_kind(docs)}, t long, start int, n int")

    def run(batches):
        for b in batches:
            found = [pieces_of(hashed(_words(text)), window) for text in b.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            if len(row):
                v, key, start, n = (pa.array(np.concatenate(x)) for x in zip(*found))
                take = pa.array(row)
                yield from as_batches({"v": v, "key": key, "d": b.column(0).take(take), "t": b.column(1).take(take), "start": start, "n": n}, arrow)
        trim()

    return docs.mapInArrow(run, target)


def wanted_rows(docs: DataFrame, window: int, single: bool) -> DataFrame:
    """v, key, d, t, start, n, ids of the pieces asked for; with ``single`` of their windows, without ids. docs: d, t, text, asked (start, n, v)."""
    target, arrow = arrow_schema(docs.sparkSession, f"v long, key long, d {_kind(docs)}, t long, start int, n int, ids binary")

    def run(batches):
        for b in batches:
            rows = []
            for d, t, text, asked in zip(*(b.column(k).to_pylist() for k in range(4))):
                words = hashed(_words(text))
                for x in asked:
                    part = words[x["start"] : x["start"] + x["n"]]
                    if single:
                        v, key, start, n = (c.tolist() for c in pieces_of(part, window, True))
                        rows += [(*z[:2], d, t, x["start"] + z[2], z[3], None) for z in zip(v, key, start, n)]
                    else:
                        rows.append((x["v"], 0, d, t, x["start"], x["n"], part.tobytes()))
            yield from _emit(rows, arrow)
        trim()

    return docs.mapInArrow(run, target)


def collapsed(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, key, n, p of the first of equal pieces, d, t, start, n of the others). A hot piece is a combined minimum and a split join."""
    place = F.struct("d", "t", "start")
    firsts = scratch.write(rows.groupBy("v", "key").agg(F.min(place).alias("p"), F.max("n").alias("n")), "firsts")
    copies = rows.join(firsts.select("v", "key", "p"), ["v", "key"]).where(place != F.col("p")).select("d", "t", "start", "n")
    return firsts, scratch.write(copies, "copies")


class Automaton:
    """A suffix automaton over several word sequences. A state has one transition in place, and a dict where there are more."""

    def __init__(self):
        self.length, self.link, self.word, self.to = [0], [-1], [None], [-1]
        self.more: dict[int, dict] = {}

    def step(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def put(self, state: int, w: int, to: int) -> None:
        if self.word[state] is None or self.word[state] == w:
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(None)
        self.to.append(-1)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the stretches of q that p and w make."""
        twin = self._state(self.length[p] + 1, self.link[q])
        self.word[twin], self.to[twin] = self.word[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        self.link[q] = twin
        while p >= 0 and self.step(p, w) == q:
            self.put(p, w, twin)
            p = self.link[p]
        return twin

    def add(self, last: int, w: int) -> tuple[int, int]:
        """(the state after w, the length of the longest stretch up to w that was there before). last: 0 to begin a sequence."""
        q = self.step(last, w)
        if q >= 0:
            if self.length[q] != self.length[last] + 1:
                q = self._split(last, w, q)
            return q, self.length[q]
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self.step(p, w)) < 0:
            self.put(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new, self.length[self.link[new]]


def statistics(automaton: Automaton, words: list[int]) -> list[int]:
    """The matching statistic at each word of a sequence, which the automaton then knows."""
    out, state = [], 0
    for w in words:
        state, n = automaton.add(state, w)
        out.append(n)
    return out


def covered(matched: list[int], window: int) -> list[tuple[int, int]]:
    """(start, n) of the unions of windows that end where the match is as long as a window."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(matched):
        if n >= window:
            start = end + 1 - window
            if out and start <= sum(out[-1]):
                out[-1] = (out[-1][0], end + 1 - out[-1][0])
            else:
                out.append((start, window))
    return out


def matched_rows(pieces: DataFrame, window: int) -> DataFrame:
    """d, t, start, n: what matches earlier pieces. pieces: shard, d, t, start, ids, in the order of shard and corpus."""
    target, arrow = arrow_schema(pieces.sparkSession, f"d {_kind(pieces)}, t long, start int, n int")

    def run(batches):
        shard, automaton = None, Automaton()
        for b in batches:
            rows = []
            for s, d, t, start, ids in zip(*(b.column(k).to_pylist() for k in range(5))):
                if s != shard:
                    shard, automaton = s, Automaton()
                found = covered(statistics(automaton, np.frombuffer(ids, np.uint64).tolist()), window)
                rows += [(d, t, start + a, n) for a, n in found]
            yield from _emit(rows, arrow)
        trim()

    return pieces.select("shard", "d", "t", "start", "ids").mapInArrow(run, target)


def repeated_spans(docs: DataFrame, window: int = 20, shard_words: int = SHARD_WORDS, heavy: int = HEAVY) -> DataFrame:
    """d, t, start, n: stretches of words to remove; they may overlap. docs: d (not null), t, text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    pieces = scratch.write(piece_rows(docs, window), "pieces")
    twice = scratch.write(pieces.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("v").alias("h")), "twice")
    _, maybe = split_by(pieces, F.xxhash64("v"), twice)  # an anchor that the filter lets through by mistake has one piece
    maybe = scratch.write(maybe, "maybe")
    scratch.drop(pieces, twice)
    firsts, found = collapsed(scratch, maybe)
    scratch.drop(maybe)
    several = firsts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    asked = F.collect_list(F.struct("start", "n", "v"))
    reference = scratch.write(firsts.join(several, "v").select("v", "c", "p.d", "p.t", "p.start", "n"), "reference")
    scratch.drop(firsts)

    def rows(part: DataFrame, single: bool) -> DataFrame:
        of_doc = scratch.write(part.groupBy("d", "t").agg(asked.alias("asked")), "asked")
        _, texts = split_by(docs, F.xxhash64("d", "t"), of_doc.select(F.xxhash64("d", "t").alias("h")))
        once = texts.join(of_doc, ["d", "t"]).dropDuplicates(["d", "t"])  # rows of `documents` may repeat
        return wanted_rows(once.select("d", "t", "text", "asked"), window, single)

    many = reference.where(F.col("c") > heavy)
    if many.limit(1).count():
        _, copies = collapsed(scratch, scratch.write(rows(many, True).drop("ids"), "windows"))
        found = found.unionByName(copies)
    light = reference.where(F.col("c") <= heavy)
    shards = max(1, math.ceil((light.agg(F.sum("n")).first()[0] or 0) / shard_words))
    streams = rows(light, False).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    streams = streams.repartition("shard").sortWithinPartitions("shard", "d", "t", "start")
    matched = scratch.write(matched_rows(streams, window), "matched")
    return found.unionByName(matched)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, carry: list[str] | None = None,
    shard_words: int = SHARD_WORDS, heavy: int = HEAVY,
) -> DataFrame:
    """row (a struct of the columns ``carry``, all by default), n_words, n_removed, spans (start, n; sorted, apart), kept (words joined by a space).

    Words are what ASCII white space separates. A word goes if a window of ``window`` (two or more) consecutive words of its document that covers it
    has the words of a window that starts earlier: in a document of smaller id, or in its own one further up. Windows are judged on the
    texts as they come. Rows that repeat an id come in the order of a hash of their text, and rows that repeat id and text count
    as one document, each with the result. Rows with a null id aren't compared and stay whole; a null or empty text has no words.
    Extra columns may have any name. No documents: no rows.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    spark = docs.sparkSession
    tune(spark)
    d, text = column(id_col), column(text_col).cast("string")
    row = F.struct(*(column(c) for c in (docs.columns if carry is None else carry)))
    keyed = docs.select(row.alias("row"), d.alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans = repeated_spans(keyed.where("d is not null and text is not null").select("d", "t", "text"), window, shard_words, heavy)
    gone = Scratch(spark, "substrings").write(spans.groupBy("d", "t").agg(F.collect_set(F.struct("start", "n")).alias("found")), "gone")
    plain, maybe = split_by(keyed, F.xxhash64("d", "t"), gone.select(F.xxhash64("d", "t").alias("h")))
    none = F.lit(None).cast(gone.schema["found"].dataType)
    met = plain.withColumn("found", none).unionByName(maybe.join(gone, ["d", "t"], "left").select(*keyed.columns, "found"))
    narrow = met.select("row", "text", "found")
    result, _ = arrow_schema(spark, "n_words long, n_removed long, spans array<struct<start:int,n:int>>, kept string")
    target = StructType([narrow.schema["row"], *result])  # names of carried columns may need no parser
    arrow = to_arrow_schema(target)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = _words(text)
                spans = merged(sorted((x["start"], x["n"]) for x in found or ()))
                kept, at = [], 0
                for start, n in spans:
                    kept += words[at:start]
                    at = start + n
                kept += words[at:]
                joined = b" ".join(kept).decode("utf-8", "surrogatepass")
                out.append((len(words), len(words) - len(kept), [{"start": s, "n": n} for s, n in spans], joined))
            if out:
                columns = dict(zip(("n_words", "n_removed", "spans", "kept"), map(list, zip(*out))))
                yield from as_batches({"row": b.column(0)} | columns, arrow)
        trim()

    return narrow.mapInArrow(run, target)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without those that touch or overlap, joined."""
    out: list[tuple[int, int]] = []
    for start, n in spans:
        if out and start <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), start + n) - out[-1][0])
        else:
            out.append((start, n))
    return out


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, CAST(generate_subscripts(w, 1) AS BIGINT) AS i, unnest(w) AS word FROM
       (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER ahead) AS h, count(*) OVER ahead AS n FROM words
            WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, i FROM windows WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) r(k)),
kept AS (SELECT doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL), '') AS text
         FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
