"""Operators 11 to 13 against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from threadloom.llm import lexical, queries, spelling, substrings

from ..conftest import SF, cells

EXTRA = "doc_id long, text string, `a.b` string, word string, term string, d long, t long, n long, row string, shard long, v long, key string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "w", "t", 1, 2, 3, "r", 4, None, "k") for i, t in zip(ids, texts)], EXTRA).repartition(3)


ODD = [None, "", "  \n", "a", "A", "a ", "É é × ", "x y z w v " * 400, "x y z w v " * 400, "word\x01\x02", "١٢٣ 𝒳y", " "]


@pytest.mark.parametrize("name", ["op11_lexical", "op12_spelling", "op13_substrings"])
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    wanted = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert cells([r.asDict() for r in df.collect()], columns) == cells(wanted, columns)


# ---- lexical search ----
def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    """docs: (id, text); items: id -> texts."""
    tf = [collections.Counter(brute_terms(t)) for _, t in docs]
    df = collections.Counter(t for c in tf for t in c)
    n, total = sum(bool(c) for c in tf), sum(sum(c.values()) for c in tf)
    out = []
    for item, texts in items.items():
        scores = []
        for (i, _), c in zip(docs, tf):
            m = 100 - 50 + (50 * sum(c.values()) * n) // total if total else 0
            w = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            s = sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in {t for x in texts for t in brute_terms(x)} if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "k", "block"), [(200, 5, 2), (1 << 20, 50, 2048), (1, 1, 3)])
def test_lexical(spark, shard, k, block):
    rng = random.Random(4)
    vocabulary = [f"w{j}" for j in range(60)]
    text = lambda most: " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randrange(most)))
    texts = ODD + [text(40) for _ in range(150)] + ["w0 w1 w59"] * 20
    ids = [*range(len(texts) - 4), None, None, 7, 7]
    items = {1: ["w1 w40, W59; w59"], 2: [None], 3: ["nothing-known"], 4: ["W0", "w33 w34"], None: ["w2 w3 w4 w5 w6 w50"], 6: [text(30)], 7: ["É"]}
    rows = [(i, t, 1) for i, ts in items.items() for t in ts]
    asked = spark.createDataFrame(rows + rows[:1], "item_id long, text string, term long")
    index = lexical.build_index(frame(spark, texts, ids), shard_bytes=shard)
    got = sorted(map(tuple, lexical.search(index, asked, k=k, block=block).collect()), key=str)
    assert got == brute_search(list(zip(ids, texts)), items, k)


def test_lexical_empty(spark, tmp_path):
    none = frame(spark, [])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).count() == 0
    assert lexical.search(lexical.build_index(frame(spark, [None, " "])), items).count() == 0
    index = lexical.build_index(frame(spark, ODD), path=str(tmp_path / "index"))
    assert lexical.search(index, items.where("false")).count() == 0
    assert [r.doc_id for r in lexical.search(index, items).orderBy("rank").collect()] == [3, 4, 5]


def test_variable_length_bytes():
    rng = random.Random(5)
    values = [0, 1, 127, 128, 16383, 16384, (1 << 62) + 5, *(rng.randrange(1 << rng.randrange(1, 60)) for _ in range(500))]
    data, sizes = lexical.packed(np.array(values))
    assert lexical.unpacked(data).tolist() == values and sizes.sum() == len(data) and lexical.unpacked(np.zeros(0, np.uint8)).tolist() == []


# ---- spelling ----
def brute_words(docs, every):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(docs, every=None):
    words = brute_words(docs, every)
    form, near = {}, {}
    for w, n in words.items():
        near[w] = sorted((-words[x], x) for x in words if one_edit(w, x))
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


@pytest.mark.parametrize("every", [None, 5])
def test_spelling(spark, every):
    rng = random.Random(6)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(60)] + ["aaaaaaaa", "Ababababa", "ÉÉÉÉÉÉÉ", "×÷×÷×÷×"]
    words = []
    for w in base:
        words += [w] * rng.choice([2, 3, 30, 400])
        for _ in range(6):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]])] * rng.choice([2, 3, 30])
    rng.shuffle(words)
    texts = ODD + [rng.choice(" ,.9\n中").join(words[k : k + 40]) for k in range(0, len(words), 40)]
    ids = [*range(len(texts) - 3), None, 3, 3]
    got = spelling.spelling_variants(frame(spark, texts, ids), every=every)
    assert sorted(map(tuple, got.collect())) == brute_spelling(list(zip(ids, texts)), every)


def test_spelling_path_and_empty(spark):
    """A path of forms, each ten times as frequent; no words at all."""
    path = ["abcdefghij", "abcdefghi", "abcdefgh", "abcdefg"]
    text = " ".join(w for k, w in enumerate(path) for _ in range(2 * 10**k))
    got = {r.word: r for r in spelling.spelling_variants(frame(spark, [text])).collect()}
    assert {r.root for r in got.values()} == {"abcdefg"} and got["abcdefghij"].form == "abcdefghi" and got["abcdefg"].form is None
    assert spelling.spelling_variants(frame(spark, [])).count() == 0 and spelling.spelling_variants(frame(spark, [None, "word"])).count() == 0


def test_rarest_keeps_one_in_common():
    """The lemma behind the prefix filter, over random words and orders of bigrams."""
    rng = random.Random(7)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(7, 12)))
        k = rng.randrange(len(w))
        x = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])
        grams = [(a + b).encode() for a in "abc" for b in "abc"]
        rng.shuffle(grams)
        order = {g: i for i, g in enumerate(grams)}
        a, b = sorted((w.encode(), x.encode()), key=len)
        shifts = {0, len(b) - len(a)}
        if len(a) >= 4:
            assert any(a[p : p + 2] == b[p + s : p + s + 2] and p + s in spelling.rarest(b, order) for p in spelling.rarest(a, order) for s in shifts)


# ---- substrings ----
def brute_substrings(docs, window):
    """docs: (id, text) in any order -> sorted (id, words, removed, kept)."""
    seen, gone = set(), {}
    for i, t in sorted({x for x in docs if x[0] is not None and x[1] is not None}):
        words = t.encode().split()
        marks = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                marks.update(range(k, k + window))
            seen.add(w)
        gone[i, t] = marks
    out = []
    for i, t in docs:
        words, marks = (t or "").encode().split(), gone.get((i, t), set())
        out.append((i, len(words), len(marks), b" ".join(w for k, w in enumerate(words) if k not in marks).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "shard_words", "heavy"), [(5, 1 << 17, 4096), (5, 30, 1), (2, 50, 3), (20, 1000, 2)])
def test_substrings(spark, window, shard_words, heavy):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    texts = list(ODD) + ["p q " * 60, "q p q " * 30, "z " * 100]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages).split()
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "changed"
            parts += p + ["own" + str(rng.randrange(50)) for _ in range(rng.randrange(6))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    texts += [passages[0]] * 40
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = None
    texts, ids = texts + [texts[20]] * 2, ids + [ids[20], None]
    got = substrings.dedup_substrings(frame(spark, texts, ids), window=window, shard_words=shard_words, heavy=heavy)
    rows = [(r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()]
    assert sorted(rows, key=str) == brute_substrings(list(zip(ids, texts)), window)


def test_substrings_columns_and_empty(spark):
    assert substrings.dedup_substrings(frame(spark, [])).count() == 0
    rows = substrings.dedup_substrings(frame(spark, ["a b c", "x a b c y", None]), window=3).orderBy("row.doc_id").collect()
    assert [r.row["a.b"] for r in rows] == ["x"] * 3 and [r.row["row"] for r in rows] == ["r"] * 3
    assert [(r.kept, [tuple(s) for s in r.spans]) for r in rows] == [("a b c", []), ("x y", [(1, 3)]), ("", [])]


def test_automaton():
    rng = random.Random(8)
    for _ in range(60):
        automaton, before = substrings.Automaton(), []
        for _ in range(5):
            words = [rng.randrange(3) for _ in range(rng.randrange(25))]
            got = substrings.statistics(automaton, words)
            for end in range(len(words)):
                known = lambda x: any(x == s[k : k + len(x)] for s in before for k in range(len(s) - len(x) + 1)) or any(
                    x == words[k : k + len(x)] for k in range(end + 1 - len(x))
                )
                assert got[end] == max(n for n in range(end + 2) if n == 0 or known(words[end + 1 - n : end + 1]))
            before.append(words)


def test_substring_query_digest(spark):
    rows = queries.op13_substrings(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_substrings(docs, 20))
    assert sorted(map(tuple, rows)) == want
