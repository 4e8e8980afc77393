"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, by a rare-first q-gram prefix filter.

1. Words are counted per task, then by word; only the table of distinct words goes on.
2. All bigrams are ordered by their frequency among the words (a table of at most 90 x 90 rows). One edit touches at
   most two bigrams of either word, and the others keep their order; so the first one that both words keep is among the
   three rarest of each, at the same place or, if it lies behind an inserted letter, one place on.
3. Words meet by an equality key: such a bigram, its place, the shorter word's length, and all of the word but the third
   that the edit is in (each third in turn). No pair within one edit is lost by it, and words that meet differ in a
   third of their letters only, however frequent a bigram is at a place. Each pair that meets is verified by its edit distance.
4. A word's form occurs ten times as often as the word, so that pointer doubling finds all roots in a few rounds.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, as_batches, column, map_batches, text_of, trim, tune

#: A-Z become a-z; what is neither an ASCII letter nor U+00C0 to U+00FF separates words (in Latin-1).
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Distinct words that a task holds before it hands their counts on.
_HELD = 200_000


def altered(doc_id, run: bytes, seed: int, every: int) -> bytes:
    """The run, in Latin-1, without the letter that the hash of document and run names, if that hash is a multiple of ``every``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least: int, every: int | None) -> DataFrame:
    """word, n: what each task has counted. docs: d (as text), text."""
    target, arrow = arrow_schema(docs.sparkSession, "word string, n long")

    def rows(counts: Counter):
        yield from as_batches({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())}, arrow)

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seed = zlib.crc32(f"{d}:".encode())
                for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(word) >= least:
                        word = altered(d, word, seed, every) if every else word
                        if len(word) >= least:
                            counts[word] += n
            if len(counts) > _HELD:
                yield from rows(counts)
                counts.clear()
        yield from rows(counts)
        trim()

    return docs.mapInArrow(run, target)


def bigram_order(words: DataFrame) -> dict[bytes, int]:
    """Bigram (in Latin-1) -> its place, rarest first. At most 90 x 90 of them, whatever the words."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    found = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r.n, r.gram.encode("latin-1")) for r in found.collect())
    return {gram: k for k, (_, gram) in enumerate(rows)}


def rarest(word: bytes, order: dict[bytes, int], most: int = 3) -> list[int]:
    """The places (from 0) of the word's ``most`` rarest bigrams; of equal ones the first."""
    ranks = [(order[word[i : i + 2]], i) for i in range(len(word) - 1)]
    return [i for _, i in sorted(ranks)[:most]]


def placed(words: DataFrame) -> DataFrame:
    """word, n, at: the words with the places of their three rarest bigrams."""
    order = bigram_order(words)

    def run(batch) -> dict:
        return {"word": batch.column(0), "n": batch.column(1), "at": [rarest(w.encode("latin-1"), order) for w in batch.column(0).to_pylist()]}

    return map_batches(words.select("word", "n"), run, "word string, n long, at array<int>")


def _rest(length: Column, third: int, more: int) -> Column:
    """The word without a third of a word of ``length``; the word itself may have ``more`` letters in that third."""
    cut = [F.lit(0), F.floor(length / 3).cast("int"), F.floor(length * 2 / 3).cast("int"), length]
    head = F.substring("word", F.lit(1), cut[third])
    return F.concat(head, F.lit("|"), F.substring("word", cut[third + 1] + (1 + more), F.length("word")))


def _key(p: Column, gram: Column, length: Column, third: int, rest: Column) -> Column:
    return F.xxhash64(gram, p, length, F.lit(third), rest)


def _gram(p: Column) -> Column:
    return F.substring("word", p + 1, F.lit(2))


def _exploded(words: DataFrame, length: Column, more: int, keys) -> DataFrame:
    """key, word, n: ``keys`` of each of the rarest bigrams' places and the three rests, without repeats."""
    rested = words.select("word", "n", "at", *(_rest(length, k, more).alias(f"rest{k}") for k in range(3)))
    all_keys = F.array_compact(F.array_distinct(F.flatten(F.transform("at", keys))))
    return rested.select(F.explode(all_keys).alias("key"), "word", "n")


def indexed(words: DataFrame) -> DataFrame:
    """key, word, n: each word under its rarest bigrams and three rests."""
    length = F.length("word")
    return _exploded(words, length, 0, lambda p: F.array(*(_key(p, _gram(p), length, k, F.col(f"rest{k}")) for k in range(3))))


def longer(words: DataFrame) -> DataFrame:
    """key, word, n: each word as one with a letter more than those that it may meet.

    A bigram before the third that has the letter keeps its place, one behind it is one place less; one that touches it may do either.
    """
    length = F.length("word") - 1

    def keys(p: Column) -> Column:
        out = []
        for k in range(3):
            start, stop = F.floor(length * k / 3), F.floor(length * (k + 1) / 3)
            rest = F.col(f"rest{k}")
            out.append(F.when(p < stop + 1, _key(p, _gram(p), length, k, rest)))
            out.append(F.when(p + 1 >= start, _key(p - 1, _gram(p), length, k, rest)))
        return F.array(*out)

    return _exploded(words, length, 1, keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one edit apart, once in either direction. words: word, n, at."""
    index = indexed(words)
    right = index.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    one = F.levenshtein("a", "b", 1) == 1
    side = lambda rows: rows.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    # the lengths tell which of the two kinds of meeting a pair of rows can be
    probe = side(index).withColumn("more", F.lit(0)).unionByName(side(longer(words)).withColumn("more", F.lit(1)))
    meets = (F.length("a") == F.length("b") + F.col("more")) & ((F.col("more") == 1) | (F.col("a") < F.col("b")))
    half = probe.join(right, "key").where(meets & one).select("a", "a_n", "b", "b_n").distinct()
    turned = half.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    return half.unionByName(turned)


def roots(scratch: Scratch, forms: DataFrame, most_n: int) -> DataFrame:
    """word, root for the words of ``forms`` (word, form). Forms grow tenfold, so a path has at most log10(most_n) steps."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log10(max(10, most_n)) + 1)))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = scratch.write(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, times: int = 10, every: int | None = None
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased, of at least ``least`` letters that occur at least
    twice. n_near counts the words one edit away; form is the one of them of largest n (then the first in code-point order) if
    that is at least ``times`` the word's n (10 or more, so that paths are short), else null; root is the last of the path along forms, the word itself without one. With
    ``every``, a run whose crc32 of "doc_id:run" is a multiple of it loses the letter at that number modulo its length.
    Null and empty texts have no words; a null id is an empty text; rows that repeat an id count each. Other columns are
    ignored. No words: no rows.
    """
    if least < 4 or times < 10:
        raise ValueError("words have at least four letters, and forms at least ten times the count")
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "spelling")
    narrow = docs.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("d"), text_of(text_col).alias("text"))
    counted = word_counts(narrow, least, every).groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    words = scratch.write(counted, "counts")
    words = scratch.write(placed(words), "words")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")))
    near = pairs.groupBy("a", "a_n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= times * F.col("a_n")
    near = scratch.write(
        near.select(F.col("a").alias("word"), "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "near"
    )
    most_n = words.agg(F.max("n")).first()[0] or 0
    rooted = roots(scratch, near.where("form is not null"), most_n)
    out = words.select("word", "n").join(near.join(rooted, "word", "left"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE_SQL = """
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS x FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM counted, tab),
altered AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, i FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs JOIN words ON word = b GROUP BY ALL),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
           FROM words LEFT JOIN near ON a = word),
path AS (SELECT word, word AS last FROM formed UNION ALL SELECT path.word, form FROM path JOIN formed ON formed.word = path.last WHERE form IS NOT NULL),
root AS (SELECT path.word, last AS root FROM path JOIN formed ON formed.word = path.last WHERE form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN root USING (word)
"""
