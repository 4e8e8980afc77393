"""Columns of any name beside the operators' own: results are the same, and the columns come back as they were."""

import random

import pytest

import corpus_pipeline
from threadloom.llm import common, line_dedup, substrings

from pyspark.sql import functions as F

NAMES = ["a.b", "a`b", "__h", "__word", "__bits", "__d", "__t", "__lines", "__removed", "__clean", "__n_lines", "h", "word", "bits", "d", "t", "row", "removed", "found", "text.x", "kept", "n", "Text2"]


def _docs(spark):
    rng = random.Random(3)
    footer = "all rights of this long footer line are kept by those who wrote it " * 4
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(60)) for _ in range(12)]
    texts += [texts[0], texts[0], None, "", "123"] + [f"{t}\n{footer}" for t in texts[:4]]
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *("`" + n.replace("`", "``") + "` string" for n in NAMES)])
    return spark.createDataFrame(rows, schema).repartition(2)


def _plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, tmp_path, stage):
    docs = _docs(spark)
    spark.createDataFrame([(1, "alpha1 beta2 gamma3 delta4 alpha5 beta6")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = corpus_pipeline.STAGES[stage][1]
    got, want = run(spark, docs, str(tmp_path)), run(spark, _plain(docs), str(tmp_path))
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = got.collect()
    assert sorted(r[:5] for r in rows) == sorted(tuple(r) for r in want.collect()) if stage else len(rows) == want.count()
    assert all(r[5 + k] == f"{n}{r.doc_id}" for r in rows for k, n in enumerate(NAMES))


def test_line_dedup(spark):
    docs = _docs(spark)
    got = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    want = line_dedup.dedup_lines(_plain(docs)).orderBy("doc_id").collect()
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g["__removed"], g["__clean"], g["__n_lines"]) == (w.doc_id, w["__removed"], w["__clean"], w["__n_lines"])
        assert g["__h"] == f"__h{g.doc_id}" and g["a.b"] == f"a.b{g.doc_id}"
    assert any(g["__removed"] for g in got)


def test_substrings(spark):
    rows = substrings.dedup_substrings(_docs(spark)).collect()
    assert any(r.n_removed for r in rows) and all(r.row["a`b"] == f"a`b{r.row.doc_id}" for r in rows)


def test_split_by(spark):
    docs = _docs(spark)
    plain, maybe = common.split_by(docs, F.xxhash64("doc_id"), spark.range(5).select(F.xxhash64("id").alias("h")))
    assert plain.columns == maybe.columns == docs.columns and plain.count() + maybe.count() == docs.count() and maybe.count() >= 5
