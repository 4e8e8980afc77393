"""Threads, pairs, sampling, retrieval and the agent on small fixtures, with plain-Python cross-checks."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import catalog
from threadloom.functions import text as X
from threadloom.operators import agent, asking, blocks, brands, labels, many, pairs, profile, quantiles, retrieval, sampling, threads
from threadloom.operators.typed import typed
from threadloom.plans.filters import marked
from threadloom.plans.staging import Scratch
from threadloom.sources import io, messages
from threadloom.streaming.labelling import label_stream

from .conftest import SF

RAW = ", ".join(f"{c} string" for c in messages.RAW_COLUMNS)


def raw(spark, rows):
    """rows: id, author, inbound, text, parent."""
    full = [(str(i) if i is not None else None, a, b, "Mon Jan 01 00:00:07 +0000 2024", t, None, None if p is None else str(p)) for i, a, b, t, p in rows]
    return spark.createDataFrame(full, RAW)


def test_roots(spark):
    rows = [(1, "c", "True", "a", None)] + [(k, "c", "True", "a", k - 1) for k in range(2, 101)]
    rows += [(201, "c", "True", "a", 150), (202, "c", "True", "a", 150)]  # one ghost parent
    rows += [(203, "c", "True", "a", 203), (204, "c", "True", "a", 900), (300, "c", "True", "x", None), (300, "c", "False", "x", None)]
    n = threads.nodes(typed(raw(spark, rows)))
    r = dict(threads.roots(n).collect())
    assert {r[k] for k in range(1, 101)} == {1} and r[201] == r[202] == 150 and r[203] == 203 and r[204] == 204
    s = {x.root: x for x in threads.sizes(n, threads.roots(n)).collect()}
    assert s[1].size == 100 and s[150].size == 2 and s[300].size == 1 and s[300].n_inbound == 1


def test_roots_of_nothing(spark):
    assert threads.roots(threads.nodes(typed(raw(spark, [])))).count() == 0


def test_cycle_ends(spark):
    rows = [(1, "c", "True", "a", 2), (2, "c", "True", "a", 3), (3, "c", "True", "a", 1)]
    assert threads.roots(threads.nodes(typed(raw(spark, rows))), most_rounds=5).count() == 3


def test_bad_ids(spark):
    t = typed(raw(spark, [("x", "c", "True", None, "y"), (None, None, None, None, None), (5, "c", "maybe", "a", "7.0")]))
    assert sorted((r.id, r.parent, r.inbound) for r in t.collect()) == [(0, 0, False), (0, 0, True), (5, 7, False)]


def test_pairs(spark):
    rows = [
        (1, "c", "True", "my delivery is late", None), (2, "B", "False", "please dm us", 1), (3, "b", "False", "ok 1", None), (4, "b", "False", "ok", 99),
        (5, "b", "False", "ok", 2), (6, "c", "True", "My Delivery is late", 2), (7, "b", "False", "Please DM us", 6), (8, "c", "True", "@x", 7),
        (9, "b", "False", "hello there", 8), (10, "c", "True", "q", None), (11, "b", "False", "", 10),
    ]
    t = typed(raw(spark, rows + [(120, "c", "True", "z", None)]))
    out = dict(pairs.outcomes(t, pairs.brand_replies(t, ["B"])).select("id", "outcome").collect())
    assert out == {2: "candidate", 3: "no_parent_id", 4: "parent_not_in_data", 5: "reply_to_non_customer", 7: "candidate", 9: "candidate", 11: "candidate"}
    p = {r.brand_tweet_id: r for r in pairs.interactions(t, ["B"]).collect()}
    assert p[2].is_usable and p[7].is_duplicate and p[7].unusable_reason == "duplicate"
    assert p[9].unusable_reason == "customer_only_mention_or_url" and p[11].unusable_reason == "empty_brand_text"
    assert [p[k].turn_in_conversation for k in (2, 7, 9)] == [1, 2, 3] and p[2].conversation_id == "b-conv-1"
    assert len(next(iter(p.values()))) == 27


def test_distribution(spark):
    r = threads.distribution(spark.createDataFrame([(1,), (2,), (3,), (10,)], "n int"), "n").first()
    assert (r.p10, r.median, r.max, r["count"]) == (1, 2, 10, 4)
    assert threads.distribution(spark.createDataFrame([], "n int"), "n").first()["count"] == 0
    h = dict(threads.histogram(spark.createDataFrame([(1,), (7,), (50,)], "n int"), "n").collect())
    assert h == {"1": 1, "2": 0, "3": 0, "4": 0, "5": 0, "6-10": 1, "11+": 1}


def test_greedy_pool(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, a string, b string")
    assert sorted(r.id for r in sampling.greedy_rows(df([(1, "a", "x"), (2, "a", "y"), (3, "b", "y")])).collect()) == [1, 3]
    rng = random.Random(7)
    rows = [(k, f"a{rng.randrange(25)}", f"b{rng.randrange(25)}") for k in range(120)]
    want, seen_a, seen_b = [], set(), set()
    for k, a, b in rows:
        if a not in seen_a and b not in seen_b:
            want.append(k)
            seen_a.add(a)
            seen_b.add(b)
    assert sorted(r.id for r in sampling.greedy_rows(df(rows)).collect()) == want


def test_greedy_rows_long_chain(spark):
    # row k shares its text with k + 1, and that its conversation with k + 2
    rows = [(k, f"a{(k + 1) // 2}", f"b{k // 2}") for k in range(130)] + [(200, None, "z"), (201, "z", None)]
    got = sampling.greedy_rows(spark.createDataFrame(rows, "id long, a string, b string"))
    assert sorted(r.id for r in got.collect()) == list(range(0, 130, 2))


def test_golden_choice(spark):
    """The bounded candidate lists give what a scan of the whole pool gives."""
    import hashlib

    from threadloom.functions import values as V

    rng = random.Random(3)
    rows = [
        (k, rng.choice(V.TAXONOMY_ORDER[:4] + [V.OTHER]), f"r{rng.randrange(60)}", *(rng.random() < 0.1 for _ in range(4)))
        for k in range(400)
    ]
    p = spark.createDataFrame(rows, "brand_tweet_id long, intent string, reply_key string, is_short boolean, is_multi_turn boolean, is_ambiguous boolean, has_url boolean")
    got = dict(sampling.choose(p, 42))
    order = sorted(rows, key=lambda r: hashlib.md5(f"42-{r[0]}".encode()).hexdigest())
    chosen, used = {}, set()

    def pick(r, why):
        if r[0] in chosen:
            chosen[r[0]].add(why)
            return False
        if r[2] in used:
            return False
        chosen[r[0]] = {why}
        used.add(r[2])
        return True

    for intent in V.TAXONOMY_ORDER:
        n = 0
        for r in order:
            if len(chosen) >= 150:
                break
            if r[1] == intent and pick(r, f"intent:{intent}"):
                n += 1
                if n >= 12:
                    break
    for at, (bucket, least) in enumerate(V.TOP_UPS.items(), 3):
        have = sum(1 for r in rows if r[0] in chosen and r[at])
        if have >= least:
            continue
        for r in order:
            if have >= least or len(chosen) >= 150:
                break
            if r[at] and pick(r, f"difficulty:{bucket}"):
                have += 1
    assert set(got) == set(chosen)
    assert all(got[k].split(";")[0].startswith(("intent", "difficulty")) for k in got)


@pytest.fixture(scope="module")
def index(spark):
    texts = ["my delivery never arrived", "the delivery was late again", "refund for my order please", "refund my order", "clubcard points missing", "points missing", "zzz"]
    rows = [(f"i{k}", f"c{k}", k, t, t, t, f"reply {k}", f"@h reply {k}", "delivery_issue" if "delivery" in t else "other_or_unclear") for k, t in enumerate(texts)]
    schema = "interaction_id string, conversation_id string, brand_tweet_id long, customer_text string, customer_redacted_text string, customer_normalized_text string, brand_text string, brand_redacted_text string, intent string"
    return retrieval.TfidfIndex.fit(spark.createDataFrame(rows, schema), "interaction_id", "customer_normalized_text", min_df=1, tie="brand_tweet_id")


def test_ties_by_number(spark):
    """Of equal scores the smaller reply number comes first, whatever the order of the keys as text."""
    rows = [(f"brand-{k}", k, "refund please" if k % 2 else "other words here") for k in (123, 99, 1001, 7, 8)]
    index = retrieval.TfidfIndex.fit(spark.createDataFrame(rows, "interaction_id string, n long, t string"), "interaction_id", "t", min_df=1, tie="n")
    q = spark.createDataFrame([(1, "refund please")], "id long, q string")
    assert [r.interaction_id for r in index.search(q, "id", "q").orderBy("rank").collect()] == ["brand-7", "brand-99", "brand-123", "brand-1001"]


def test_retrieval_invariants(spark, index, tmp_path):
    hits = index.retrieve("my delivery never arrived")
    scores = [h["retrieval_score"] for h in hits]
    assert hits[0]["interaction_id"] == "i0" and abs(scores[0] - 1) < 1e-6 and scores == sorted(scores, reverse=True)
    assert len({h["interaction_id"] for h in hits}) == len(hits)
    assert "i0" not in [h["interaction_id"] for h in index.retrieve("my delivery never arrived", exclude_interaction_id="i0")]
    assert len(index.retrieve("refund my order", top_k=1)) == 1
    assert index.retrieve("") == index.retrieve(None) == index.retrieve("  ") == index.retrieve("qqq") == index.retrieve("refund", top_k=0) == []
    index.save(f"{tmp_path}/index")
    again = retrieval.TfidfIndex.load(spark, f"{tmp_path}/index")
    assert [h["interaction_id"] for h in again.retrieve("refund my order")] == [h["interaction_id"] for h in index.retrieve("refund my order")]
    with pytest.raises(FileNotFoundError):
        retrieval.TfidfIndex.load(spark, f"{tmp_path}/none")
    assert again.manifest["counts"] == {"documents": 7, "documents_with_terms": 7, "vocabulary_size": index.vocabulary.count()} and again.manifest["generated_at"]
    metadata = f"{tmp_path}/index/metadata/{again.manifest['version']}"
    index.metadata.limit(3).write.mode("overwrite").parquet(metadata)
    with pytest.raises(ValueError, match="documents"):
        retrieval.TfidfIndex.load(spark, f"{tmp_path}/index")
    index.metadata.drop("intent").write.mode("overwrite").parquet(metadata)
    with pytest.raises(io.MissingColumns, match="intent"):
        retrieval.TfidfIndex.load(spark, f"{tmp_path}/index")


def _corpus(spark, n=160):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(25)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(25)], k=rng.randrange(1, 9))) for _ in range(n)]
    return spark.createDataFrame([(k, (k * 37) % 50, t) for k, t in enumerate(texts)], "id long, place long, t string").repartition(3)


def _brute_cosine(docs, queries, k, ngrams=2, min_df=2, max_df=0.9):
    def grams(t):
        w = re.findall(r"\w\w+", t.lower())
        return collections.Counter(g for n in range(1, ngrams + 1) for g in zip(*(w[i:] for i in range(n))))

    tf = {r.id: grams(r.t) for r in docs}
    df = collections.Counter(g for c in tf.values() for g in c)
    idf = {g: math.log((1 + len(tf)) / (1 + n)) + 1 for g, n in df.items() if min_df <= n <= max_df * len(tf)}

    def vector(c):
        v = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    vectors, place, out = {i: vector(c) for i, c in tf.items()}, {r.id: r.place for r in docs}, []
    for q, t in queries:
        v = vector(grams(t))
        scores = sorted((-round(sum(x * d.get(g, 0) for g, x in v.items()), 9), place[i], i) for i, d in vectors.items())
        out += [(q, i, r + 1, round(-s, 6)) for r, (s, _, i) in enumerate(x for x in scores[:k] if x[0] < 0)]
    return sorted(out)


@pytest.mark.parametrize(("docs", "postings", "lists"), [(8192, 1 << 18, 16384), (3, 1000, 7), (1000, 5, 4)])
def test_search_in_blocks(spark, monkeypatch, docs, postings, lists):
    """Blocks of any size and queries in lists of any size give the rows of brute force; ties by place, then id."""
    build, query_blocks = blocks.build, blocks.query_blocks
    monkeypatch.setattr(blocks, "build", lambda v, d, t: build(v, d, t, docs, postings))
    monkeypatch.setattr(blocks, "query_blocks", lambda v, n: query_blocks(v, n, lists))
    corpus = _corpus(spark)
    queries = [(1, "w0 w1 w2"), (2, "w24"), (3, "unknown"), (4, ""), (5, "W3 w3 w4 w5"), *((k, f"w{k % 25} w{k % 7}") for k in range(6, 20))]
    index = retrieval.TfidfIndex.fit(corpus, "id", "t", tie="place")
    got = index.search(spark.createDataFrame(queries, "q long, t string"), "q", "t", 6)
    assert sorted((r.q, r.id, r.rank, r.score) for r in got.collect()) == _brute_cosine(corpus.collect(), queries, 6)


@pytest.mark.parametrize("rare", [3, 8, 10_000])
def test_search_of_many_queries(spark, monkeypatch, rare):
    """Every document as a query gives the rows of brute force, with its own row left out; the blocks hold a few documents of each kind only."""
    kinds = ["my parcel is late", "late parcel my", "charged twice late", "no bread today at all", "bread bread late", "is late"]
    docs = [(k, k // 4, f"{kinds[k * 7 % 6]}{f' order {k // 5}' if k % 4 else ''}{' again' if k % 50 == 0 else ''}") for k in range(300)]
    docs += [(300, 0, ""), (301, 0, "nobody else"), (302, 9, "order 12 order 13"), (303, 9, "12 13 14")]
    corpus = spark.createDataFrame(docs, "id long, place long, t string")
    monkeypatch.setattr(many, "RARE", rare)
    sent, search = [], blocks.search
    monkeypatch.setattr(blocks, "search", lambda b, v, *a: sent.append((b.agg(F.sum(F.size("docs"))).first()[0], v.count())) or search(b, v, *a))
    index = retrieval.TfidfIndex.fit(corpus, "id", "t", tie="place")
    got = index.search(corpus.select(F.struct("id").alias("q"), "t", F.col("id").alias("own")), "q", "t", 6, 0.0, "own", ("place", "t"))
    rows = got.collect()
    best: dict = {}
    for q, d, _, score in sorted(_brute_cosine(corpus.collect(), [(k, t) for k, _, t in docs], 7), key=lambda x: (x[0], x[2])):
        if q != d and len(best.setdefault(q, [])) < 6:
            best[q].append((q, d, len(best[q]) + 1, score))
    assert sorted((r.q.id, r.id, r.rank, r.score) for r in rows) == sorted(x for xs in best.values() for x in xs)
    assert all((r.id, r.place, r.t) == docs[r.id] for r in rows)
    assert len(sent) == 1 and (rare != 8 or (sent[0][0] < 200 and sent[0][1] < 40))


@pytest.mark.parametrize("ngrams", [1, 2, 3])
def test_terms_tokenise_once(spark, ngrams):
    """No step of the plan makes a text's words again, least of all for each n-gram."""
    df = spark.createDataFrame([(1, "a1 b2 a1 b2"), (2, ""), (3, None), (4, "zz")], "id long, t string")
    t = retrieval.terms(df, "id", "t", ngrams)
    assert t._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    want = [(1, "a1", 2), (1, "b2", 2), (4, "zz", 1)] + [(1, "a1 b2", 2), (1, "b2 a1", 1)] * (ngrams > 1) + [(1, "a1 b2 a1", 1), (1, "b2 a1 b2", 1)] * (ngrams > 2)
    assert sorted(map(tuple, t.collect())) == sorted(want)


def test_search_moves_no_posting(spark):
    """Between the scan of the blocks and the heaps there is no exchange, and most blocks are skipped for a rare word."""
    index = retrieval.TfidfIndex.fit(_corpus(spark), "id", "t", tie="place")
    vectors = index._vectors(index.counted, index.vocabulary, ["id", "place"])
    index._blocks = index._scratch.write(blocks.build(vectors, "id", "place", 10), "small")
    q = spark.createDataFrame([(1, "w20 w21")], "q long, t string")
    plan = index.search(q, "q", "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    at = next(k for k, line in enumerate(plan.splitlines()) if "MapInArrow" in line)
    assert re.search("Relation|Scan", plan.splitlines()[at + 1])
    asked = blocks.Queries(["a"], [["w20", "w0"]], [[0.9, 0.1]], 1, 0.0)
    asked.begin()
    for b in index.blocks.toArrow().to_batches():
        for i in range(b.num_rows):
            asked.meet(blocks._read({c: b.column(c)[i] for c in b.schema.names}))
    assert asked.scanned < index.blocks.count() > 10


def test_search_adds_common_terms_once(spark, monkeypatch):
    """Queries with the same terms in the same proportion share a block's sum; what is known to be reached elsewhere leaves blocks out."""
    monkeypatch.setattr(blocks, "RARE", 0)
    made, sum_ = [], blocks._Sum
    monkeypatch.setattr(blocks, "_Sum", lambda *a: made.append(1) or sum_(*a))
    index = retrieval.TfidfIndex.fit(_corpus(spark), "id", "t", tie="place")
    rows = [{c: b.column(c)[i] for c in b.schema.names} for b in index.blocks.toArrow().to_batches() for i in range(b.num_rows)]
    asked = blocks.Queries(list(range(50)), [["w1", "w0"]] * 50, [[0.9 / k, 0.3 / k] for k in range(1, 51)], 3, 0.0)
    asked.begin()
    for r in rows:
        asked.meet(blocks._read(r))
    assert 0 < len(made) <= len(rows) and all([x[1:] for x in b] == [x[1:] for x in asked.best[0]] for b in asked.best)
    asked.begin(np.full(50, 2.0))
    for r in rows:
        asked.meet(blocks._read(r))
    assert asked.scanned == 0


@pytest.mark.parametrize("case", ["", "small blocks", "many queries", "large vocabulary", "equal hashes", "bigrams"])
def test_search_where_texts_lie(spark, monkeypatch, case):
    """An index that keeps no terms gives the rows of brute force; beyond its bounds the tables serve, with the same rows."""
    search, tables = blocks.search_texts, []
    size, ngrams = (7 if case == "small blocks" else 1 << 19), (2 if case == "bigrams" else 1)
    monkeypatch.setattr(blocks, "search_texts", lambda *a: tables.append(False) or search(*a, size))
    if case == "many queries":
        lists = blocks.query_lists
        monkeypatch.setattr(blocks, "query_lists", lambda v, *a: lists(v, 4))
    elif case == "large vocabulary":
        monkeypatch.setattr(retrieval.TfidfIndex, "MOST_WORDS", 12)
    elif case == "equal hashes":
        monkeypatch.setattr(retrieval, "_hash", lambda t: F.xxhash64(t) % 10)
    corpus = _corpus(spark).unionByName(spark.createDataFrame([(900, 1, None), (901, 1, ""), (902, 1, "w3 " * 40), (903, 0, "w3")], "id long, place long, t string"))
    queries = [(1, "w0 w1 w2"), (2, "w24"), (3, "unknown"), (4, ""), (5, "W3 w3 w4 w5"), *((k, f"w{k % 25} w{k % 7}") for k in range(6, 20))]
    index = retrieval.TfidfIndex.fit(corpus, "id", "t", tie="place", ngrams=ngrams, keep=False)
    got = index.search(spark.createDataFrame(queries, "q long, t string"), "q", "t", 6)
    docs = [r if r.t else type(r)(id=r.id, place=r.place, t="") for r in corpus.collect()]
    assert sorted((r.q, r.id, r.rank, r.score) for r in got.collect()) == _brute_cosine(docs, queries, 6, ngrams)
    assert bool(tables) == (case in ("", "small blocks", "bigrams"))


def test_search_where_texts_lie_equal_keys(spark):
    """Rows of the same key count as one document, as in an index with tables; so does the key that is missing. The empty index gives no rows."""
    rows = [(1, "w1 w2 w3"), (2, "w2 w2"), (2, "w2 w3 w9"), (3, "w3 w9"), (None, "w1 w7"), (None, "w7 w7 w8"), (4, "w8 w7 w5"), (5, "w5")]
    docs = spark.createDataFrame(rows, "id long, t string")
    q = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(10)], "q long, t string")
    fit = lambda d, **more: retrieval.TfidfIndex.fit(d, "id", "t", ngrams=1, **more)
    found = [sorted(map(repr, fit(docs, **more).search(q, "q", "t").collect())) for more in ({}, {"keep": False})]
    assert found[0] == found[1] and found[0]
    assert fit(docs.limit(0), keep=False).search(q, "q", "t").count() == 0


def test_document_search_writes_no_postings(spark, monkeypatch):
    """Only the vocabulary and the queries are written, and between the scan of the documents and the heaps there is no exchange."""
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name="t": written.append(name) or write(self, df, name))
    plan = catalog.QUERIES["document_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert set(written) == {"repeated", "frequencies", "vocabulary", "queries"}
    below = plan[plan.index("MapInArrow") :].splitlines()
    end = next(k for k, line in enumerate(below) if "Relation" in line)
    assert "doc_id" in below[end] and all("Project" in line for line in below[1:end])


def test_grown_index(spark, tmp_path):
    """An index that grew twice, saved and loaded in between, equals one of all documents; a failed save leaves the old version."""
    corpus = _corpus(spark)
    path, q = f"{tmp_path}/grown", spark.createDataFrame([(k, f"w{k} w{k + 1} w{k + 2}") for k in range(20)], "q long, t string")
    part = [corpus.where(F.col("id") % 3 == k) for k in range(3)]
    retrieval.TfidfIndex.fit(part[0], "id", "t", tie="place").save(path)
    for p in part[1:]:
        index = retrieval.TfidfIndex.load(spark, path)
        with pytest.raises(ValueError, match="same id"):
            index.add(part[0].limit(1))
        index.add(p).save(path)
    again, whole = retrieval.TfidfIndex.load(spark, path), retrieval.TfidfIndex.fit(corpus, "id", "t", tie="place")
    assert len(again.manifest["segments"]) == 3 and again.counts() == whole.counts()
    rows = lambda i: sorted(map(tuple, i.search(q, "q", "t").collect()))
    assert rows(again) == rows(whole) and sorted(map(tuple, again.vocabulary.collect())) == sorted(map(tuple, whole.vocabulary.collect()))
    more = again.add(corpus.select((F.col("id") + 1000).alias("id"), "place", "t"))
    more.metadata = None
    with pytest.raises(AttributeError):
        more.save(path)
    assert rows(retrieval.TfidfIndex.load(spark, path)) == rows(whole)


def _pairs_of(spark, t):
    return labels.label(pairs.interactions(t, messages.BRANDS).withColumn("clean", X.clean("customer_text")))


def test_audit_in_one_pass(spark):
    """The counts observed while the rows are written equal separate ones; the plan reads the pairs once."""
    p = Scratch(spark, "t").write(_pairs_of(spark, typed(messages.read(spark, SF))))
    audit = retrieval.Audit()
    rows = retrieval.index_rows(p, audit)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    kept = Scratch(spark, "t").write(rows)
    assert audit.counts() == retrieval.stage_counts(p).first().asDict() and audit.counts()["rows_after_dedupe"] == kept.count()
    index = retrieval.TfidfIndex.fit(kept.where("brand_tweet_id % 2 = 0"), "interaction_id", "customer_normalized_text", tie="brand_tweet_id")
    assert retrieval.new_rows(kept, index).where("brand_tweet_id % 2 = 0").count() == 0 and retrieval.new_rows(kept.limit(0), index).count() == 0


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_marked(spark, most):
    """Bitmaps, and the join beyond their bound: keys at the ends of ranges, repeats, nulls, none at all."""
    rng = random.Random(11)
    values = [1, 2, 8, 9, 32767, 32768, 32769, 65536, 65537, 1 << 40, *(rng.randrange(1, 200_000) for _ in range(400))]
    asked = [*values[::2], 1, 1, None, 999_999_999_999]
    rows = spark.createDataFrame([(k, v, "x") for k, v in enumerate([*values, *values[:5], None, 3])], "n long, id long, mark string")
    got = marked(rows, "id", spark.createDataFrame([(x,) for x in asked], "k long"), "there", most)
    assert got.columns == ["n", "id", "mark", "there"] and {(r.n, r.there) for r in got.collect()} == {(r.n, r.id is not None and r.id in asked) for r in rows.collect()}
    assert not marked(rows, "id", spark.createDataFrame([], "k long"), "there", most).where("there").count()


def test_parents(spark):
    """Repeated ids count once, with the largest row; texts of other messages are neither joined nor aggregated."""
    rows = [(1, "c", "True", "one", None), (2, "c", "False", "b", None), (2, "c", "True", "a", None), (3, "Brand00", "False", "r", 1), (4, "brand00", "False", "r", 2), (5, "c", "True", "five", None)]
    t = Scratch(spark, "t").write(typed(raw(spark, rows)))
    there = pairs.parents(t, spark.createDataFrame([(1,), (2,), (2,), (77,)], "p long"))
    assert sorted((r.parent, r.p_inbound, r.p_text) for r in there.collect()) == [(1, True, "one"), (2, True, "b")]
    o = pairs.outcomes(t, pairs.brand_replies(t, ["Brand00"]))
    assert sorted((r.id, r.p_text, r.outcome) for r in o.collect()) == [(3, "one", "candidate"), (4, "b", "candidate")]


def test_cycles_have_one_root(spark):
    """Cycles of every length to 100, with tails: the smallest id on the cycle, for all that lead into it."""
    rows, want, at = [], {}, 1
    for length in range(2, 101):
        ids = list(range(at + 3, at + 3 + length))
        rng = random.Random(length)
        rng.shuffle(ids)
        ring = dict(zip(ids, ids[1:] + ids[:1]))
        tail = {at: at + 1, at + 1: at + 2, at + 2: ids[length // 2]}  # smaller ids, which aren't on the cycle
        for i, up in (ring | tail).items():
            rows.append((i, up, True))
            want[i] = min(ring)
        at += 3 + length
    rows += [(at + k, at + max(0, k - 1), False) for k in range(70)]  # a chain to a root
    want |= {at + k: at for k in range(70)}
    n = spark.createDataFrame(rows, "id long, up long, inbound boolean")
    assert dict(threads.roots(n).collect()) == want


@pytest.mark.parametrize("bins", [4, 4096])
def test_percentiles(spark, monkeypatch, bins):
    """Against the built-in function: hot values, one value, nulls, halves, very large and close doubles; and no table at all."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(12)
    rows = [("a", rng.choice([1.0, 2.0, 2.5, 1e9, -3.0])) for _ in range(500)] + [("b", 7.0)] * 40 + [("c", 1.0), ("c", 2.0), (None, 5.0), (None, 6.0), ("d", None)]
    rows += [("e", 1.0 + k * 2.0**-52) for k in range(30)] + [("f", rng.random() * 10 ** rng.randrange(-3, 12)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "p100": 1.0}
    want = df.groupBy("g").agg(*(F.percentile("v", p).alias(k) for k, p in shares.items()))
    assert sorted(map(tuple, quantiles.percentiles(df, ["g"], "v", shares).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    whole = df.agg(*(F.percentile("v", p).alias(k) for k, p in shares.items())).first()
    assert quantiles.percentiles(df, [], "v", shares).first() == whole
    assert quantiles.percentiles(df.limit(0), [], "v", shares).collect() == [(None,) * 5] and quantiles.percentiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_distinct_counts_without_expand(spark):
    t = Scratch(spark, "t").write(typed(messages.read(spark, SF)))
    for metrics in (brands.customer_metrics, brands.reply_metrics):
        assert "Expand" not in metrics(t, messages.BRANDS)._jdf.queryExecution().toString()


class Client:
    model_name = "fake"

    def __init__(self, answer):
        self.answer = answer

    def generate(self, system, user):
        if self.answer is None:
            raise RuntimeError("down")
        return self.answer


def test_agent(spark, index):
    a = agent.SupportAgent(index)
    r = a.handle("My delivery has not arrived")
    assert r["intent"] == "delivery_issue" and r["intent_confidence"] == 0.88 and r["needs_human_review"] and r["mode"] == "mock"
    assert r["escalation_reason"] == "Request requires live order information." and len(r) == 16
    for bad in (None, 12345, "", "   ", "x" * 2001):
        with pytest.raises(agent.InvalidMessage):
            a.handle(bad)


class Counting:
    """Notes each prompt that it answers; at ``deadly`` its process ends, the first time."""

    model_name = "counting"

    def __init__(self, path, deadly=None):
        self.path, self.deadly = str(path), deadly

    def generate(self, system, user):
        if user == "fails":
            raise RuntimeError("down")
        if user == self.deadly and not os.path.exists(self.path + ".died"):
            open(self.path + ".died", "w").close()
            os._exit(1)
        with open(self.path, "a") as f:
            f.write(user + "\n")
        return f"{system}/{user}"


def test_each_prompt_is_asked_once(spark, tmp_path):
    """Equal prompts are one call; a task that dies costs its wave only, and answers that are kept aren't asked for again."""
    client = Counting(tmp_path / "log", "p3")
    rows = [("s", f"p{k % 4}") for k in range(20)] + [("s", None), (None, "p1"), ("s", "fails"), ("s", "fails")]
    prompts = spark.createDataFrame(rows, "a string, b string").repartition(3)
    ask = lambda: {(r.answer, r.error) for r in asking.answers(prompts, client, "a", "b", f"{tmp_path}/store", wave=1).collect()}
    with pytest.raises(Exception):  # the dead task
        ask()
    want = {(f"s/p{k}", None) for k in range(4)} | {(None, "llm_error")}
    assert ask() == ask() == want
    key = asking.prompt_key("counting", "a", "b")  # what shares the dead task's wave may be asked twice
    wave = dict(prompts.where(key.isNotNull()).select("b", F.pmod(F.xxhash64(key), F.lit(5))).distinct().collect())
    calls = collections.Counter((tmp_path / "log").read_text().split())
    assert set(calls) == {f"p{k}" for k in range(4)} and all(n == 1 for p, n in calls.items() if wave[p] != wave["p3"]) and max(calls.values()) <= 2
    r = agent.generate(spark.createDataFrame([(1, "s", "p1"), (2, "s", None), (3, "s", "fails")], "id long, system_prompt string, user_prompt string"), client, f"{tmp_path}/store")
    assert sorted((x.id, x.generated_response, x.error_type) for x in r.collect()) == [(1, "s/p1", None), (2, agent.FALLBACK, "prompt_error"), (3, agent.FALLBACK, "llm_error")]
    assert len((tmp_path / "log").read_text().split()) == sum(calls.values())


def test_agent_degrades(spark, index):
    for answer, error in ((None, "llm_error"), ("  ", "empty_response")):
        r = agent.SupportAgent(index, Client(answer)).handle("refund please")
        assert (r["generated_response"], r["error_type"], r["used_fallback"], r["mode"]) == (agent.FALLBACK, error, True, "live")
    r = agent.SupportAgent(index, Client("fine")).handle("refund please")
    assert r["generated_response"] == "fine" and r["generation_success"]


def test_agent_without_examples_or_prompt(spark, index, monkeypatch):
    def broken(*_):
        raise OSError("no index")

    r = agent.SupportAgent(None, retriever=broken).handle("refund please")
    assert r["generation_success"] and r["retrieved_count"] == 0 and r["top_similarity"] is None
    own = lambda m, key, text, k: agent.retriever_of(index)(m, key, text, 1)
    assert agent.SupportAgent(None, retriever=own).handle("refund please")["retrieved_count"] == 1
    other = lambda m: agent.classify(m).withColumn("agent_intent", F.lit("complaint"))
    assert agent.SupportAgent(index, classifier=other).handle("refund please")["intent"] == "complaint"
    monkeypatch.setattr(agent, "prompts", broken)
    for client in (None, Client("fine")):
        r = agent.SupportAgent(index, client).handle("refund please")
        assert (r["generated_response"], r["error_type"], r["used_fallback"]) == (agent.FALLBACK, "prompt_error", True) and r["retrieved_count"] == 2


def test_live_client(index):
    import http.server
    import json
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Authorization"]))
            self.send_response(500 if len(asked) == 1 else 200)
            self.end_headers()
            self.wfile.write(b'{"choices": [{"message": {"content": "hello"}}]}')

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/chat"
    client = agent.LiveClient(url, "m", "hidden")
    assert client.generate("s", "u") == "hello" and len(asked) == 2  # the first try fails, one more follows
    body, key = asked[0]
    assert (body["temperature"], body["max_tokens"], body["messages"][1]["content"], key) == (0.2, 350, "u", "Bearer hidden") and "hidden" not in repr(client)
    bot = agent.build_agent(index, io.load_settings(None, {"LLM_API_KEY": "k", "LLM_URL": url, "LLM_MODEL": "m"}), mock=False)
    assert isinstance(bot.client, agent.LiveClient) and not bot.deterministic_only and bot.client.timeout == 30.0
    server.shutdown()
    server.server_close()
    with pytest.raises(agent.ModelError):
        client.generate("s", "u")
    assert isinstance(agent.build_agent(index).client, agent.MockClient)
    for env in ({}, {"LLM_URL": url}):
        with pytest.raises(RuntimeError):
            agent.build_agent(index, io.load_settings(None, env), mock=False)


def test_parsed_answers(spark):
    raws = [None, "", "{", "[1]", 'so {"intent": "complaint", "confidence": 0.704, "evidence": "x"} !', '{"intent": "complaint", "confidence": "0.5"}',
            '{"intent": "complaint", "confidence": 7}', '{"intent": "no", "confidence": 0.7}', '{"confidence": 0.7}', '{"intent": "complaint"}',
            '{"intent": "complaint", "confidence": 1, "evidence": "' + "y" * 300 + '"}', '{"intent": "complaint", "confidence": 0.2, "evidence": ""}']
    got = [r.p for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(agent.parsed(F.col("raw")).alias("p")).collect()]
    assert [None if p is None else tuple(p) for p in got] == [agent.parse_label(r) for r in raws] and sum(p is not None for p in got) == 4


def test_model_sees_low_confidence_only(spark, index):
    rows = agent.classify(spark.createDataFrame([(1, "my delivery has not arrived"), (2, "asdf qwer")], "id long, message string"))
    told = agent.ask_model(rows, Client('{"intent": "complaint", "confidence": 0.9}'))
    assert {r.id: (r.agent_intent, r.method, r.points) for r in told.collect()} == {1: ("delivery_issue", "deterministic", 88), 2: ("complaint", "model", 90)}


def test_model_labels(spark, index):
    good = '{"intent": "complaint", "confidence": 0.7, "evidence": "x"}'
    r = agent.SupportAgent(index, Client(f"so {good}"), deterministic_only=False).handle("asdf qwer")
    assert (r["intent"], r["intent_confidence"], r["intent_method"]) == ("complaint", 0.7, "model")
    for bad in ("", "{", '{"intent": "no", "confidence": 0.7}', '{"intent": "complaint", "confidence": 7}', "[1]"):
        assert agent.parse_label(bad) is None
        r = agent.SupportAgent(index, Client(bad or "x"), deterministic_only=False).handle("asdf qwer")
        assert r["intent"] == "other_or_unclear" and r["intent_method"] == "deterministic"


def test_prompt(spark):
    q = spark.createDataFrame([(1, "help " + "y" * 700), (2, "none")], "id long, message string")
    rows = [(1, k, 1.0 / k, f"@joe asks {k}", "raw", "", f"@brand says {k}") for k in range(1, 11)]
    ex = spark.createDataFrame(rows, "id long, rank long, score double, customer_redacted_text string, customer_text string, brand_redacted_text string, brand_text string")
    p = {r.id: r for r in agent.prompts(q, "id", ex, 5).collect()}
    assert "Example 5:" in p[1].user_prompt and "Example 6:" not in p[1].user_prompt and "@" not in p[1].user_prompt
    assert p[1].retrieved_count == 5 and p[1].top_similarity == 1.0 and "…" in p[1].user_prompt
    assert "None found" in p[2].user_prompt and p[2].retrieved_count == 0 and p[2].top_similarity is None


def test_qualitative(spark):
    rows = [(f"g{k:02d}", k % 3, k / 10.0, None if k % 2 else 1, k == 1, k == 2, k == 3, k == 4) for k in range(20)]
    df = spark.createDataFrame(rows, "golden_id string, n_results long, top1_score double, first_match_rank long, is_ambiguous boolean, is_short boolean, has_url boolean, is_multi_turn boolean")
    picks = retrieval.pick_qualitative(df)
    assert len(picks) == len(dict(picks)) >= 10 and ("g19", "good_high_similarity") in picks


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,x,"two\nlines, ""q""",,NA\n2,b,False,x,ok,3,1\n3,c,True\n4,d,True,x,y,,,more\n')
    good, bad = io.read_messages(spark, f"{tmp_path}/m.csv")
    rows = {r.tweet_id: r for r in good.collect()}
    assert rows["1"].text == 'two\nlines, "q"' and rows["1"].in_response_to_tweet_id is None and set(rows) == {"1", "2"} and bad.count() == 2
    assert io.read_messages(spark, f"{tmp_path}/m.csv", ["text"])[0].columns == ["text"]
    (tmp_path / "t.csv").write_text('a,b,c,d,e,f\n1,1.5,"x\ny",2024-01-02 03:04:05,true,\n3000000000,2,z,2024-01-02,false,\n')
    assert io.sampled_types(spark, f"{tmp_path}/t.csv") == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "timestamp"), ("e", "boolean"), ("f", "string")]
    assert io.megabytes(3 * 1024 * 1024 + 52429) == 3.05 and io.size_in_bytes(spark, f"{tmp_path}/t.csv") > 70 and io.generated_at().endswith("+00:00")
    with pytest.raises(FileNotFoundError):
        io.read_messages(spark, f"{tmp_path}/none.csv")
    with pytest.raises(io.MissingColumns):
        io.require(good, ["nope"])
    assert "secret" not in repr(io.load_settings(None, {"LLM_API_KEY": "secret"}))
    with pytest.raises(RuntimeError):
        io.load_settings(None, {}).key()
    io.write_summary(spark.sql("select 1 as a, null as b"), f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").first().value == '{"a":1,"b":null}'


def test_partitioning_is_immaterial(spark):
    m = messages.read(spark, SF)
    a = profile.dataset_profile(m).first()
    assert a == profile.dataset_profile(m.repartition(7)).first()
    t = typed(m)
    key = lambda df: sorted(map(tuple, df.select("pair_id", "is_usable", "turn_in_conversation").collect()))
    assert key(pairs.interactions(t, messages.BRANDS)) == key(pairs.interactions(t.repartition(5, "text"), messages.BRANDS))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "my delivery is late"), (2, "zzz")], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    q = label_stream(stream).writeStream.format("memory").queryName("labelled_stream").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert dict(spark.table("labelled_stream").select("id", "agent_intent").collect()) == {1: "delivery_issue", 2: "other_or_unclear"}


def test_cli(spark, tmp_path, capsys):
    from threadloom import cli

    io.write_table(messages.read(spark, SF), f"{tmp_path}/m")
    names = ",".join(messages.BRANDS)
    assert cli.main(["profile", "--dataset", f"{tmp_path}/m.csv"]) == 0 and '"total_rows": 997' in capsys.readouterr().out
    assert cli.main(["build-pairs", "--dataset", f"{tmp_path}/m.csv", "--output", f"{tmp_path}/p", "--brands", names]) == 0
    assert cli.main(["golden", "--pairs", f"{tmp_path}/p.parquet", "--output", f"{tmp_path}/g"]) == 0
    assert cli.main(["index", "--pairs", f"{tmp_path}/p.parquet", "--output", f"{tmp_path}/i"]) == 0
    summary = io.read_json(spark, f"{tmp_path}/i.json") if cli.main(["index", "--pairs", f"{tmp_path}/p.parquet", "--output", f"{tmp_path}/i", "--summary", f"{tmp_path}/i.json"]) == 0 else {}
    assert summary["stages"]["rows_after_dedupe"] == summary["counts"]["documents"] and summary["settings"]["tie"] == "brand_tweet_id"
    assert cli.main(["label", "--pairs", f"{tmp_path}/p.parquet", "--output", f"{tmp_path}/l", "--report", f"{tmp_path}/l.md"]) == 0
    report = [r.value for r in spark.read.text(f"{tmp_path}/l.md").collect()]
    assert report[0] == "# Labels" and "## distribution" in report and any(x.startswith("| delivery_issue | ") for x in report)
    assert sum(io.read_json(spark, f"{tmp_path}/l")["distribution"].values()) == io.read_json(spark, f"{tmp_path}/l")["total"]
    assert cli.main(["score-brands", "--dataset", f"{tmp_path}/m.csv", "--output", f"{tmp_path}/b", "--brands", names + ",Nobody", "--summary", f"{tmp_path}/b.json"]) == 0
    assert io.read_json(spark, f"{tmp_path}/b.json")["missing"] == ["nobody"]
    capsys.readouterr()
    assert cli.main(["agent", "--index", f"{tmp_path}/i", "--mock", "--message", "My delivery has not arrived", "--json"]) == 0
    assert '"intent": "delivery_issue"' in capsys.readouterr().out
    assert cli.main(["agent", "--index", f"{tmp_path}/i", "--mock", "--message", " "]) == 2
    assert cli.main(["agent", "--index", f"{tmp_path}/i", "--message", "refund"]) == 2  # no endpoint, no key
    assert cli.main(["search", "--index", f"{tmp_path}/none", "--query", "x"]) == 2
    assert cli.main(["evaluate", "--index", f"{tmp_path}/i", "--golden", f"{tmp_path}/g.parquet", "--mock", "--output", f"{tmp_path}/e", "--report", f"{tmp_path}/e.md"]) == 0
    valid = io.read_table(spark, f"{tmp_path}/g.parquet").where(agent.validation("customer_text").isNull())
    assert io.read_table(spark, f"{tmp_path}/e.parquet").count() == valid.count() > 80
