"""A search of many queries, by joins: no query meets a document that it shares nothing rare with, but for a few of each kind.

A document's terms are rare (in ``RARE`` documents of the index at most) or frequent. Queries and documents that share a rare term meet
by a join on it, whose rows are bounded by the queries' rare terms. All others score by their frequent terms alone. There, documents
whose frequent terms weigh the same (a group) differ by tie only, so the first k of each group stand for it; queries whose
frequent terms weigh the same share one search among these. The best of both are the best of all: what a group's list
leaves out has k documents before it, whose scores can only be higher by rare terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import Scratch
from . import blocks

#: Documents of a rare term, at most.
RARE = 32
#: Weights are equal if they are after this scaling: sums of doubles depend on their order. A group that falls apart by it is only more work.
SCALE = 1e13


def _frequent(c: str):
    return F.slice(c, F.lit(1), F.col("often"))


def _grouped(vectors: DataFrame) -> DataFrame:
    """With ``group``, equal where the frequent terms and their weights are; null without a frequent term."""
    weights = F.transform(_frequent("weights"), lambda w: F.floor(w * SCALE + 0.5).cast("string"))
    key = F.md5(F.concat_ws("\n", F.array_join(_frequent("terms"), "\n"), F.lit(""), F.array_join(weights, " ")))
    return vectors.withColumn("group", F.when(F.col("often") > 0, key))


def _rare(vectors: DataFrame, *names) -> DataFrame:
    """names, term, weight: a row for each rare term."""
    rest = lambda c: F.slice(c, F.col("often") + 1, F.size(c) - F.col("often")).alias(c)
    each = vectors.where(F.size("terms") > F.col("often")).select(*names, F.arrays_zip(rest("terms"), rest("weights")).alias("p"))
    return each.select("*", F.explode("p").alias("e")).select(*each.drop("p").columns, F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))


def _dot(a: str, b: str):
    """The product of two sparse vectors of structs terms, weights."""
    at = lambda c, t: F.element_at(F.col(f"{c}.weights"), F.array_position(F.col(f"{c}.terms"), t).cast("int"))
    return F.aggregate(F.array_intersect(f"{a}.terms", f"{b}.terms"), F.lit(0.0), lambda s, t: s + at(a, t) * at(b, t))


def _first(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def search(docs: DataFrame, queries: DataFrame, name: str, k: int, min_score: float, scratch: Scratch) -> DataFrame:
    """name, best: of each query its k best documents (down, tie, doc, shown), in order; ``down`` is the negative score. Queries without one have none.

    docs: doc, tie, shown (what comes along), terms (most frequent first), weights, often (how many of them are frequent). queries: name, terms, weights, often.
    """
    docs = scratch.write(_grouped(docs), "grouped")
    queries = scratch.write(_grouped(queries), "asked")
    one = lambda df: df.where("group is not null").select("group", _frequent("terms").alias("terms"), _frequent("weights").alias("weights")).dropDuplicates(["group"])
    kinds, asked = scratch.write(one(docs), "kinds"), scratch.write(one(queries), "asked-kinds")
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "tie", "doc", "shown")))

    # those that share a rare term, in full
    left, right = _rare(queries, name, F.col("group").alias("of")), _rare(docs, "doc", "tie", "shown", "group")
    met = left.withColumnRenamed("weight", "w").join(right, "term").repartition(name)
    met = scratch.write(met.groupBy(name, "of", "doc", "tie", "shown", "group").agg(F.sum(F.col("w") * F.col("weight")).alias("rare")), "met")
    vector = lambda c: F.struct("terms", "weights").alias(c)
    pairs = met.where("of is not null and group is not null").select("of", "group").distinct()
    pairs = pairs.join(asked.select(F.col("group").alias("of"), vector("a")), "of").join(kinds.select("group", vector("b")), "group")
    pairs = scratch.write(pairs.select("of", "group", _dot("a", "b").alias("common")), "pairs")
    score = F.round(F.col("rare") + F.coalesce("common", F.lit(0.0)), blocks.DIGITS).alias("score")
    near = met.join(pairs, ["of", "group"], "left").select(name, score, "tie", "doc", "shown").where(F.col("score") > min_score)
    near = _first(near, name, k, F.desc("score"), "tie", "doc").groupBy(name).agg(best.alias("near"))

    # the others, group by group
    heads = _first(docs.where("group is not null").select("group", "tie", "doc", "shown"), "group", k, "tie", "doc")
    heads = scratch.write(heads, "heads")
    built = scratch.write(blocks.build(heads.join(kinds, "group").select("doc", "tie", "terms", "weights"), "doc", "tie"), "blocks")
    found = blocks.search(built, asked, "group", k, min_score, lambda rows: scratch.write(rows, "found"))
    head = heads.select(F.struct("tie", "doc").alias("head"), "shown")
    found = _first(found, "group", k, F.desc("score"), "tie", "doc").join(head, F.struct("tie", "doc").eqNullSafe(F.col("head")))
    far = scratch.write(found.groupBy("group").agg(best.alias("far")), "far")

    out = queries.select(name, "group").join(near, name, "left").join(far, "group", "left")
    near, far = (F.coalesce(c, F.array().cast(far.schema["far"].dataType)) for c in ("near", "far"))
    keys = F.transform(near, lambda x: F.struct(x.tie, x.doc))
    both = F.concat(near, F.filter(far, lambda x: ~F.array_contains(keys, F.struct(x.tie, x.doc))))
    return out.select(name, F.slice(F.array_sort(both), 1, k).alias("best")).where(F.size("best") > 0)
