"""Benchmark decontamination: CGK random walks, repeated bit-sampling LSH, exact edit verification.

Texts and items are sequences of lower-case words. A CGK walk reads a sequence for a number of steps:
in each it emits the word at its place and moves on by one or not, as a hash of step and word says.
Two sequences walked with the same hash meet again soon after an edit, so that a small edit distance
becomes a small Hamming distance of what they emit, and a few sampled steps (a band) agree by chance.

The walk drifts apart with the number of edits, so windows are as long as an item only up to about ten
words. A longer item, which may differ by d edits, is cut into d // 2 + 1 pieces. Whatever the edits and
wherever they are, one piece has one edit at most. Half of the bands walk from a window's start on, half
from its end back, so that an edit near either end is met late by one of them. A pair of bands proposes
a piece with one edit with a chance of PAIR at least, an untouched piece for certain; ``recall`` sets the
number of pairs. Each region proposed is verified by the exact word edit distance between the item and
its best-fitting stretch. A stretch within d edits of an item of n words has at least n - d words of the
item; that lossless test spares most of the distances.

Items travel to the tasks in blocks of bounded size (``block_bytes``); a larger benchmark takes more
passes over the documents. Documents never shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batches, beside_text, column, text_of, trim, tune, with_text

_PUNCTUATION = bytes(32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))
BYTES_A_WORD = 250  # of an item's word in a Matcher, about
LONGEST_REGION = 1 << 16
#: Steps of a walk; a window takes the most that don't exceed its words.
STEPS = (1, 2, 3, 4, 5, 7, 10, 14, 20, 28, 40)
SAMPLES = 4  # of a band
#: The least chance that a band from the start or one from the end proposes a piece with one edit (measured: 0.47).
PAIR = 0.45
_MIX = np.uint64(0x27D4EB2F165667C5)
_SIEVE = 18  # bits of a key that are looked up first
_PAIRS = 22  # bits of the hash of two neighbouring words
RESULT = "doc_id {kind}, item_id {item}, distance int, similarity double, start_word long, end_word long"


def words_of(text: str) -> list[bytes]:
    """Lower-case words: what ASCII punctuation and white space separate."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def allowed(n: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def cuts(n: int, d: int) -> list[int]:
    """The bounds of the pieces of n words with d edits: d // 2 + 1 of them, of which one has one edit at most."""
    pieces = d // 2 + 1
    return [n * k // pieces for k in range(pieces + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def samples(band: int, steps: int) -> list[int]:
    """The steps that a band samples: one of each quarter of the walk."""
    bounds = [steps * k // SAMPLES for k in range(SAMPLES + 1)]
    draw = lambda k: int(_mixed(np.array([band * 64 + steps, k], np.uint64) + np.uint64(1))[:1][0] >> np.uint64(7 + 11 * k))
    return sorted({a + draw(k) % (b - a) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a})


def walks(words: np.ndarray, start: np.ndarray, band: int, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length of walk the band's key of the window at each start. words: followed by enough zeros."""
    move = _mixed(words.astype(np.uint64) + (np.uint64(band + 1) << np.uint64(40)))
    word, at = words.astype(np.uint64), start.copy()
    sampled = {n: samples(band, n) for n in lengths}
    out = {n: np.zeros(len(start), np.uint64) for n in lengths}
    for step in range(1 + max(s[-1] for s in sampled.values())):
        here = [n for n in lengths if step in sampled[n]]
        if here:
            now = word[at]
            for n in here:
                out[n] = (out[n] ^ (out[n] >> np.uint64(29))) * _MIX + now
        at += ((move[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
    return {n: x ^ (x >> np.uint64(31)) for n, x in out.items()}


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a.astype(np.uint32) * np.uint32(0x9E3779B1) ^ b.astype(np.uint32) * np.uint32(0x85EBCA77)
    return mixed * np.uint32(0xC2B2AE3D) >> np.uint32(32 - _PAIRS)


class Matcher:
    """The bands of the pieces of one block of items. Word 0 stands for every word that no item has."""

    def __init__(self, items: list[tuple], similarity: float, recall: float = 0.99):
        self.similarity = similarity
        self.bands = 2 * max(1, math.ceil(math.log(1 - recall) / math.log(1 - PAIR)))
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                if allowed(len(words), similarity) >= len(words):
                    raise ValueError("similarity must be above 0")
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
                self.items.append((item_id, ids))
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.least = np.array([len(w) - allowed(len(w), similarity) for _, w in self.items], np.int64)
        # 1024 bits for each item, by a hash of its words
        self.masks = np.zeros((len(self.items), 128), np.uint8)
        for mask, (_, w) in zip(self.masks, self.items):
            bit = w.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(22)
            np.bitwise_or.at(mask, bit >> np.uint32(3), np.uint8(1) << (bit & np.uint32(7)).astype(np.uint8))
        rows = [
            (j, a, b, max(s for s in STEPS if s <= b - a))
            for j, (n, least) in enumerate(zip(self.sizes.tolist(), self.least.tolist()))
            for bounds in [cuts(n, n - least)]
            for a, b in zip(bounds, bounds[1:])
        ]
        item, low, high, steps = np.array(rows, np.int64).reshape(-1, 4).T
        self.lengths = sorted(set(steps.tolist()))
        first = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate([w for _, w in self.items]) if self.items else np.zeros(0, np.int32)
        self.tables = {}  # for each band and length of walk: sorted keys, and the item and the piece's place in it
        for band in range(self.bands):
            back = band % 2
            start = len(flat) - first[item] - high if back else first[item] + low
            keys = walks(self._padded(flat[::-1] if back else flat), start, band, self.lengths) if len(rows) else {}
            for n, key in keys.items():
                mine = np.flatnonzero(steps == n)
                order = mine[np.argsort(key[mine], kind="stable")]
                self.tables[band, n] = key[order], item[order].astype(np.int32), (high if back else low)[order].astype(np.int32)
        self.sieves: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sieves": {}}

    def _padded(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([words, np.zeros(self.lengths[-1] + 1, words.dtype)])

    def _sieve(self, band: int, n: int) -> np.ndarray:
        """Which low bits of keys occur: spares most of the searches."""
        if (band, n) not in self.sieves:
            self.sieves[band, n] = np.zeros(1 << _SIEVE, bool)
            self.sieves[band, n][self.tables[band, n][0] & np.uint64((1 << _SIEVE) - 1)] = True
        return self.sieves[band, n]

    def _neighbours(self, words: np.ndarray) -> np.ndarray:
        """Whether each word and the next follow one another in an item, too; or seem to by their hash."""
        if "pairs" not in self.sieves:
            self.sieves["pairs"] = np.zeros(1 << _PAIRS, bool)
            for _, w in self.items:
                self.sieves["pairs"][_pair(w[:-1], w[1:])] = True
        return self.sieves["pairs"][_pair(words[:-1], words[1:])] & (words[:-1] > 0) & (words[1:] > 0)

    def proposed(self, words: np.ndarray) -> np.ndarray:
        """Rows (item, place in the text of the item's start, as if there were no edits)."""
        found, far = [], self.lengths[-1]
        pairs = self._neighbours(words)
        sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64), np.full(far + 1, np.count_nonzero(flags))])
        for back in (0, 1):
            text = words[::-1] if back else words
            known, met = sums(text > 0), sums(pairs[::-1] if back else pairs)
            count = len(text)
            # of n words that a window begins with one at most is no word of the item, and two at most of their pairs are none of its
            near = {
                n: (known[n : n + count] - known[:count] >= max(1, n - 1)) & (met[n - 1 : n - 1 + count] - met[:count] >= n - 3) for n in self.lengths
            }
            start = np.flatnonzero(np.logical_or.reduce(list(near.values())))
            near, text = {n: ok[start] for n, ok in near.items()}, self._padded(text)
            for band in range(back, self.bands, 2):
                for n, key in walks(text, start, band, self.lengths).items():
                    hit = np.flatnonzero(self._sieve(band, n)[key & np.uint64((1 << _SIEVE) - 1)] & near[n])
                    keys, item, place = self.tables[band, n]
                    a, b = (np.searchsorted(keys, key[hit], side) for side in ("left", "right"))
                    size = b - a
                    which = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                    at = np.repeat(start[hit], size)
                    found.append(np.stack([item[which].astype(np.int64), (len(words) - at if back else at) - place[which]]))
        item, at = np.concatenate(found, axis=1)
        low = at.min(initial=0)
        wide = int(at.max(initial=0) - low) + 1
        return np.stack(np.divmod(np.unique(item * wide + (at - low)), wide), axis=1) + [0, low]

    def shared(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words from low to high are words of the item, or a little more."""
        out = np.zeros(len(item), np.int64)
        size = high - low
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1):
            if len(part):
                n = size[part]
                begin = np.cumsum(n) - n
                word = words[np.repeat(low[part] - begin, n) + np.arange(n.sum())]
                bit = word.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(22)
                byte = self.masks[np.repeat(item[part], n), bit >> np.uint32(3)]
                mine = (word > 0) & ((byte >> (bit & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
                out[part] = np.add.reduceat(mine.astype(np.int64), begin)
        return out

    def regions(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to) in which a piece is proposed, joined where they meet. words: ids of texts end to end, a 0 after each; first: where each begins."""
        total = np.concatenate([[0], np.cumsum(words > 0, dtype=np.int64)])
        j, at = self.proposed(words).T
        size, d = self.sizes[j], self.sizes[j] - self.least[j]
        middle = np.clip(at + size // 2, 0, len(words) - 1)
        # a piece may lie in the text before or after the one that holds the item's middle
        rows = [np.searchsorted(first, np.clip(x, 0, len(words) - 1), side="right") - 1 for x in (middle, at, at + size - 1)]
        other = [rows[0] >= 0, rows[1] != rows[0], (rows[2] != rows[0]) & (rows[2] != rows[1])]
        row, j, at = (np.concatenate([x[ok] for x, ok in zip(xs, other)]) for xs in (rows, [j] * 3, [at] * 3))
        size, d = self.sizes[j], self.sizes[j] - self.least[j]
        low, high = np.maximum(first[row], at - d - 1), np.minimum(first[row + 1] - 1, at + size + d + 1)
        may = np.flatnonzero(high > low)
        may = may[total[high[may]] - total[low[may]] >= self.least[j[may]]]
        may = may[self.shared(words, j[may], low[may], high[may]) >= self.least[j[may]]]
        row, j, low, high = (x[may] for x in (row, j, low, high))
        order = np.lexsort((high, low, j, row))
        out: list[list[int]] = []
        for r, i, a, b in np.stack([row, j, low, high]).T[order].tolist():
            last = out[-1] if out else None
            if last and last[:2] == [r, i] and a <= last[3] and b - last[2] <= max(LONGEST_REGION, b - a):
                last[3] = max(last[3], b)
            else:
                out.append([r, i, a, b])
        return [tuple(x) for x in out]

    def verify(self, item: int, text: np.ndarray) -> tuple[int, int, int] | None:
        """(distance, start, end) of the first stretch of the text that fits the item best, if it fits."""
        want = self.items[item][1]
        n, least = len(want), int(self.least[item])
        d = n - least
        known, often = np.unique(want, return_counts=True)
        at = np.searchsorted(known, text)
        at[at == len(known)] = 0
        if np.minimum(np.bincount(at[known[at] == text], minlength=len(known)), often).sum() < least:
            return None  # so many words would have to match
        # rows: item words; columns: text words; a match may begin and end anywhere in the text
        cost, origin = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
        scale = len(text) + 2
        state = cost * scale + (len(text) - origin)  # least cost first, then the latest origin
        steps = np.arange(len(text) + 1) * scale
        for k in range(n):
            down = state + scale
            down[1:] = np.minimum(down[1:], state[:-1] + scale * (text != want[k]))
            state = np.minimum.accumulate(down - steps) + steps
            if k % 8 == 7 and state.min() // scale > d:  # the least cost never falls
                return None
        end = int(np.argmin(state // scale))
        distance = int(state[end] // scale)
        if distance > d:
            return None
        return distance, len(text) - int(state[end] % scale), end

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end), the best place of each item in each text."""
        get = self.vocabulary.get
        ids = [np.array([get(w, 0) for w in words_of(t)], np.int32) for t in texts]
        if not self.items or not ids:
            return []
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in ids])])
        flat = np.concatenate([y for x in ids for y in (x, np.zeros(1, np.int32))])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, low, high in self.regions(flat, first):
            got = self.verify(item, flat[low:high])
            if got:
                skipped = low - int(first[row])
                place = (got[0], got[1] + skipped, got[2] + skipped)
                if (row, item) not in best or place < best[row, item]:
                    best[row, item] = place
        return [(row, item, *got) for (row, item), got in sorted(best.items())]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in lists whose Matchers take about ``block_bytes`` each: fixed memory, more passes for more items."""
    narrow = benchmark.select(column(item_col).alias("item"), text_of(text_col).alias("text"))
    words = F.size(F.split("text", r"\s+"))
    total = narrow.agg(F.sum(words)).first()[0]
    n = max(1, math.ceil((total or 0) * BYTES_A_WORD / block_bytes))
    for k in range(n):
        rows = narrow.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct().orderBy("item", "text").collect()
        yield [(r.item, r.text) for r in rows]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    recall: float = 0.99,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per (document, item) found: doc_id, item_id, distance, similarity, start_word, end_word.

    An item can be found only if its word edit distance to a stretch of the document is at most
    (1 - similarity) of its words, and is then found with a chance of ``recall`` at least, for certain if a
    piece of it is untouched. Of the places found the best counts, then the first. similarity = 1 - distance /
    words. Null and empty texts and items without words are never found. Of items that repeat an id,
    each is found on its own; rows that repeat a doc_id too. No items or no documents: no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    narrow = docs.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind, item_kind = (x.dataType.simpleString() for x in (narrow.schema["doc_id"], benchmark.schema[item_col]))
    target, arrow = arrow_schema(spark, RESULT.format(kind=kind, item=item_kind))
    out = None
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(Matcher(items, similarity, recall))

        def run(batches, sent=sent):
            matcher = sent.value
            for b in batches:
                if b.num_rows:
                    got = matcher.matches(b.column(1).to_pylist())
                    if got:
                        row, item, distance, start, end = zip(*got)
                        names = [matcher.items[j] for j in item]
                        yield from as_batches(
                            {"doc_id": b.column(0).take(pa.array(row)), "item_id": [n for n, _ in names], "distance": distance,
                             "similarity": [1 - d / len(w) for d, (_, w) in zip(distance, names)], "start_word": start, "end_word": end},
                            arrow)

        part = narrow.mapInArrow(run, target)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    similarity: float = 0.8,
    recall: float = 0.99,
    block_bytes: int = 64 << 20,
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with all its columns, without the documents in which an item is found, as by ``find_leaks``.

    Null and empty texts stay. Each row counts on its own, whatever its id. No items: all documents stay. Columns may have any names.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = beside_text(docs, text_col)
    for items in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(Matcher(items, similarity, recall))

        def run(batches, sent=sent):
            for b in batches:
                if b.num_rows:
                    keep = np.ones(b.num_rows, bool)
                    keep[[m[0] for m in sent.value.matches([t or "" for t in b.column(1).to_pylist()])]] = False
                    yield b.filter(pa.array(keep))
            trim()

        rows = rows.mapInArrow(run, rows.schema)
    return with_text(rows, docs.columns, text_col)
