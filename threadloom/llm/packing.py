"""Best-fit-decreasing packing of token sequences.

Capacities are small integers, so bins with the same room left are interchangeable and so
are pieces of the same length. The whole corpus is therefore summed up by a histogram of at
most ``capacity`` lengths. The driver runs best-fit decreasing over that histogram: a
segment tree over remaining capacities finds the tightest open bin in logarithmic time, and
runs of equal pieces are placed together. The outcome is a plan whose size depends on the
capacity, not on the corpus; each piece finds its place in it by its rank among the pieces
of its length. No group of rows meets in one task.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, as_batches, column, text_of, trim, tune

VOCABULARY = "word_bpe_49k.json"
_CACHE_WORDS = 500_000
_SEPARATOR = 0  # after each document
#: Words that are one run of letters, with a comma or a full stop behind it or not.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[,.]?$"
#: What a vocabulary file must say of its normalizer and pre-tokenizer for words to be encoded one by one.
_SPLIT = {"pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from start on, of these sizes, end to end."""
    total = np.cumsum(size)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((start - total + size).astype(kind), size) + np.arange(n, dtype=kind)]


def _texts(strings) -> pa.Array:
    return pa.array(strings, pa.large_string())


class _Table:
    """Strings and the ids of each. Beyond ``most`` strings those used longest ago go."""

    def __init__(self, most: int):
        self.most, self.clock = most, 0
        self.names, self.flat = _texts([]), np.zeros(0, "<u4")
        self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, names: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each). names: each once; ``learn`` does the same for unknown ones."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.names) + np.arange(len(new))
            unknown = names.take(pa.array(new))
            flat, size = learn(unknown)
            self.names = pa.concat_arrays([self.names, unknown])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.clock += 1
        self.used[at] = self.clock
        start, size = np.cumsum(self.size) - self.size, self.size[at]
        out = _gather(self.flat, start[at], size)
        if len(self.names) > self.most:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
            self.flat = _gather(self.flat, start[stay], self.size[stay])
            self.names, self.size, self.used = self.names.take(pa.array(stay)), self.size[stay], self.used[stay]
        return out, size


class _Words:
    """Ids of texts. Words between ASCII white space are encoded once and remembered.

    The vocabulary's pre-tokenizer never lets a token cross white space, so a text's ids are those of its
    words in order; with a vocabulary file of another kind whole texts are encoded. Plain words fall into
    a run of letters and a mark, and equal runs are encoded once, whatever their case. Their ids are told
    apart by the ids that end a run; those of the other words by their offsets.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = (spec.get("normalizer") or {}).get("normalizers")
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_words = bool(suffix) and normal == _NORMAL and {k: steps[0].get(k) for k in _SPLIT} == _SPLIT
        if self.by_words:
            plain = spec | {"normalizer": None, "added_tokens": [], "post_processor": None}
            plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *steps[1:]]}
            self.runs_of = Tokenizer.from_str(json.dumps(plain)).encode_batch_fast
            vocabulary = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for word, k in vocabulary.items() if word.endswith(suffix)]] = True
            self.marks = [self._alone(m) for m in (",", ".")]
        self.words, self.runs = _Table(_CACHE_WORDS), _Table(_CACHE_WORDS // 2)

    def _alone(self, word: str) -> np.ndarray:
        return np.array(self.encode(word, add_special_tokens=False).ids, "<u4")

    def _letters(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of lower-case letters."""
        runs = runs.to_pylist()
        ids = []
        for k in range(0, len(runs), 10_000):  # an encoding is many times as large as its ids
            parts = [" ".join(runs[j : j + 500]) for j in range(k, min(k + 10_000, len(runs)), 500)]
            ids += [np.array(e.ids, "<u4") for e in self.runs_of(parts, add_special_tokens=False)]
        ids = np.concatenate(ids)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _others(self, words: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        near = []
        for k, w in enumerate(words):
            # words of common letters keep their offsets; others, and marks of special tokens, go alone
            if "<|" in w or max(w) > "\u024f":
                out[k] = self._alone(w)
            else:
                near.append(k)
        for k in range(0, len(near), 500):
            part = near[k : k + 500]
            got = self.encode(" ".join(words[j] for j in part), add_special_tokens=False)
            ids, first = np.array(got.ids, "<u4"), np.array([a for a, _ in got.offsets], np.int64)
            ends = np.cumsum([len(words[j]) + 1 for j in part])
            for j, x in zip(part, np.split(ids, np.searchsorted(first, ends[:-1]))):
                out[j] = x
        return out

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, _PLAIN)
        easy = words.filter(plain)
        lower = pc.utf8_lower(easy)
        runs = pc.utf8_rtrim(lower, ",.").dictionary_encode()
        flat, size = self.runs.find(runs.dictionary, self._letters)
        rest = self._others(words.filter(pc.invert(plain)).to_pylist())
        # codes: runs, then comma and full stop, then the other words, then nothing
        size = np.concatenate([size, [len(m) for m in self.marks], [len(x) for x in rest], [0]]).astype(np.int64)
        flat = np.concatenate([flat, *self.marks, *rest])
        n = len(runs.dictionary)
        code = np.full((len(words), 2), len(size) - 1)
        is_plain = plain.to_numpy(zero_copy_only=False)
        mark = np.full(len(easy), len(size) - 1)
        for k, m in enumerate((",", ".")):
            mark[pc.ends_with(easy, m).to_numpy(zero_copy_only=False)] = n + k
        code[is_plain, 0] = runs.indices.to_numpy()
        code[is_plain, 1] = mark
        code[~is_plain, 0] = n + 2 + np.arange(len(rest))
        start = np.cumsum(size) - size
        return _gather(flat, start[code.ravel()], size[code.ravel()]), size[code].sum(axis=1)

    def ids(self, texts: list[str]) -> tuple[memoryview, list[int]]:
        """Little-endian unsigned 32-bit ids of all texts end to end, a 0 after each; where each begins and the last ends, in bytes."""
        if not self.by_words:
            each = [np.append(self._alone(t), np.uint32(_SEPARATOR)).astype("<u4").tobytes() for t in texts]
            return memoryview(b"".join(each)), np.cumsum([0, *map(len, each)]).tolist()
        split = pc.ascii_split_whitespace(_texts(texts))
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary
        blank = pc.equal(known, "").to_numpy(zero_copy_only=False)  # white space at either end leaves an empty word
        flat, some = self.words.find(known.filter(pa.array(~blank)), self._learn)
        size = np.zeros(len(known) + 1, np.int64)
        size[:-1][~blank] = some
        size[-1] = 1  # the separator
        flat = np.append(flat, np.uint32(_SEPARATOR)).astype("<u4")
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        code = np.insert(coded.indices.to_numpy(), ends, len(known))
        n = size[code]
        bounds = np.concatenate([[0], np.cumsum(n)[ends + np.arange(len(ends))]]) * 4
        return memoryview(_gather(flat, (np.cumsum(size) - size)[code], n).tobytes()), bounds.tolist()


_words: dict[str, _Words] = {}  # of this worker process; kept from task to task


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(path: str | None) -> _Words:
    path = path or vocabulary_path()
    if path not in _words:
        _words[path] = _Words(path)
    return _words[path]


def groups(texts: list[str], chars: int = 2_000_000):
    """Lists of texts of about so many characters, at least one text each: bounds the words in memory at once."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str | None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: its place among this task's pieces of that length."""
    narrow = docs.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    target, arrow = arrow_schema(
        docs.sparkSession, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )

    def run(batches):
        from pyspark import TaskContext

        part, words, seen = TaskContext.get().partitionId(), words_of(tokenizer_path), np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            k = 0
            for texts in groups(b.column(1).to_pylist()):
                ids, bounds = words.ids(texts)
                for first, end in zip(bounds, bounds[1:]):
                    for n, at in enumerate(range(first, end, 4 * capacity)):
                        cut = ids[at : min(end, at + 4 * capacity)]
                        row.append(k)
                        piece.append(n)
                        start.append((at - first) // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                    k += 1
            if row:
                size = np.array(length)
                order = np.argsort(size, kind="stable")
                sizes, first, count = np.unique(size[order], return_index=True, return_counts=True)
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.repeat(first, count) + np.repeat(seen[sizes], count)
                seen[sizes] += count
                yield from as_batches(
                    {"doc_id": b.column(0).take(pa.array(row)), "piece": piece, "start": start, "length": length,
                     "ids_crc32": crc, "part": [part] * len(row), "nth": pa.array(nth)}, arrow)
        trim()

    return narrow.mapInArrow(run, target)


class OpenBins:
    """A segment tree over remaining capacities: which of them have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _changed(self, room: int) -> None:
        at = self.leaves + room
        self.tree[at] = 1 if self.bins[room] else 0
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.bins[room].append((first, count))
            if not self.tree[self.leaves + room]:
                self._changed(room)

    def take(self, room: int) -> tuple[int, int]:
        """A run of bins with this room: (first, count)."""
        run = self.bins[room].pop()
        if not self.bins[room]:
            self._changed(room)
        return run

    def tightest(self, length: int) -> int:
        """The least room of at least ``length`` that an open bin has; 0 if none."""
        at = self.leaves + length
        if self.tree[at]:
            return length
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return 0


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first bin, offset), and the number of bins.

    A piece of this length and rank r goes into bin first + r - first rank. The placement is
    that of best-fit decreasing one piece at a time: equal pieces fill the tightest bin as
    long as it has room, then the next.
    """
    plan, bins, opened = [], OpenBins(capacity), 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room:
                first, count = bins.take(room)
            else:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            spare = [(full, each)] if full else []
            left -= full * each
            if full < count and left < each and left:
                spare.append((1, left))
                left = 0
            for n, deep in spare:
                for k in range(deep):
                    plan.append((length, rank, rank + n, first, capacity - room + k * length))
                    rank += n
                bins.put(room - deep * length, first, n)
                first, count = first + n, count - n
            bins.put(room, first, count)
    return plan, opened


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; null and empty texts are the id 0 alone. Documents of
    more than ``capacity`` ids are cut into pieces of that length, the last may be shorter; no
    other document is cut. Rows that repeat an id, a null id included, are packed each on its own.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "packing")
    cut = scratch.write(pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    counts = scratch.write(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # at most `capacity` rows, whatever the corpus
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_plan(histogram, capacity)[0] or np.zeros((0, 5)), np.int64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast(plan)
    ranked = cut.join(offsets.select("part", "length", "before"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    kind = cut.schema["doc_id"].dataType.simpleString()
    target, arrow = arrow_schema(
        spark, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

    def place(batches):
        table = sent.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
                at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
                yield from as_batches(
                    {f.name: b.column(k) for k, f in enumerate(list(arrow)[:5])}
                    | {"sequence_id": pa.array(table[at, 3] + rank - table[at, 1]), "offset": pa.array(table[at, 4])}, arrow)

    return ranked.mapInArrow(place, target)
