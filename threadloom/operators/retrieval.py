"""TF-IDF index and search over DataFrames: blocks of postings that queries come to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..plans.staging import Scratch
from ..sources.io import exists, generated_at, require
from . import blocks, many

METADATA = ["interaction_id", "conversation_id", "brand_tweet_id", "customer_text", "customer_redacted_text", "customer_normalized_text",
            "brand_text", "brand_redacted_text", "intent"]


class Audit:
    """How many pairs each stage before the index leaves, observed while they pass; ``counts`` once the rows have been written.

    Where an executor is lost meanwhile, rows that pass twice may count twice; ``stage_counts`` counts in a pass of its own.
    """

    def __init__(self):
        self.before, self.after = Observation(), Observation()

    def counts(self) -> dict[str, int]:
        out = self.before.get | self.after.get
        return out | {"duplicate_text_rows_removed": out["rows_nonempty_text"] - out["rows_after_dedupe"]}


def index_rows(pairs: DataFrame, audit: Audit | None = None) -> DataFrame:
    """The pairs to be indexed: usable, not empty, and of equal texts (with case) the one with the smallest reply id. One pass, one shuffle."""
    t = F.col("customer_normalized_text")
    usable = F.coalesce("is_usable", F.lit(False))
    named = usable & (F.length(F.trim(F.coalesce(t, F.lit("")))) > 0)
    if audit:
        pairs = pairs.observe(
            audit.before, F.count(F.lit(1)).alias("rows_total"), F.count_if(usable).alias("rows_usable"), F.count_if(named).alias("rows_nonempty_text")
        )
    rest = ["conversation_id", "customer_text", "customer_redacted_text", "brand_text", "brand_redacted_text", "intent", "is_generic_reply", "turn_in_conversation", "brand"]
    low = pairs.where(named).groupBy("customer_normalized_text").agg(F.min(F.struct("brand_tweet_id", "pair_id", *rest)).alias("first"))
    if audit:
        low = low.observe(audit.after, F.count(F.lit(1)).alias("rows_after_dedupe"))
    return low.select("customer_normalized_text", "first.*").select(
        F.col("pair_id").alias("interaction_id"), "conversation_id", "brand_tweet_id", "customer_text", "customer_redacted_text",
        "customer_normalized_text", "brand_text", "brand_redacted_text", "intent", "is_generic_reply", "turn_in_conversation", "brand",
    )


def new_rows(rows: DataFrame, index: "TfidfIndex") -> DataFrame:
    """Of the rows to be indexed those that an index of earlier ones lacks: neither key nor text is there."""
    key, text = index.manifest["key"], index.manifest["text"]
    return rows.join(index.metadata.select(key), key, "left_anti").join(index.metadata.select(text), text, "left_anti").select(*rows.columns)


RULES = {"usable": "is_usable", "text": "customer_normalized_text is not blank", "duplicates": "of equal texts, with case, the smallest brand_tweet_id stays"}


def stage_counts(pairs: DataFrame) -> DataFrame:
    """One row: how many pairs each stage before the index leaves."""
    text = F.coalesce(F.col("customer_normalized_text"), F.lit(""))
    usable, named = F.coalesce("is_usable", F.lit(False)), F.length(F.trim(text)) > 0
    out = pairs.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(usable).alias("rows_usable"), F.count_if(usable & named).alias("rows_nonempty_text"),
        F.count_distinct(F.when(usable & named, text)).alias("rows_after_dedupe"),
    )
    return out.withColumn("duplicate_text_rows_removed", F.col("rows_nonempty_text") - F.col("rows_after_dedupe"))


def _gram(t, n: int):
    return lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")


def _keys(key: str, tie: str | None) -> list[str]:
    return [key, tie] if tie and tie != key else [key]


def _grams(df: DataFrame, keys: list[str], text: str, ngrams: int) -> DataFrame:
    """keys, t: a document's words and word n-grams, with repeats."""
    t = F.col("t")
    parts = [t]
    for n in range(2, ngrams + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), _gram(t, n))
        parts.append(F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>")))
    return df.select(*keys, X.index_tokens(text).alias("t")).select(*keys, F.concat(*parts).alias("t"))


def _each(df: DataFrame, keys: list[str], t) -> DataFrame:
    """keys, term: a row for each of the list ``t``. From a plain explode Spark infers a filter that makes the list anew, and the words for every n-gram."""
    return df.select(*keys, F.explode_outer(t).alias("term")).where("term is not null")


def terms(df: DataFrame, key: str, text: str, ngrams: int = V.NGRAMS, tie: str | None = None) -> DataFrame:
    """key, tie (if named), term, tf: words and word n-grams."""
    keys = _keys(key, tie)
    return _each(_grams(df, keys, text, ngrams), keys, F.col("t")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def _hash(term):
    return F.xxhash64(term)


def _best(scored: DataFrame, key: str, ties: list[str], k: int) -> DataFrame:
    """The k best documents of each key, with ``rank``; of equal scores the smallest ``ties`` first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), *ties))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value) if exists(spark, f"{path}/manifest") else {}


class TfidfIndex:
    """frequencies (term, df), vocabulary (term, df, idf), postings (doc, term, weight), metadata, and the blocks that a search reads.

    Documents without a term keep their metadata. ``counted`` (doc, tie, term, tf) has the terms of all segments: of the documents that the
    index began with, and of those that have been added. Postings and blocks are made when they are first asked for; so is
    ``counted`` of an index that doesn't keep its terms.
    """

    #: An index that doesn't keep its terms sends its vocabulary to the tasks up to this size: 12 bytes a term.
    MOST_WORDS = 96 << 20
    #: Queries meet the documents by joins if there are more than one for so many documents.
    MANY = 4

    def __init__(self, counted: DataFrame | None, frequencies: DataFrame, vocabulary: DataFrame, metadata: DataFrame, manifest: dict, blocks_: DataFrame | None = None):
        self._counted, self.frequencies, self.vocabulary, self.metadata, self.manifest = counted, frequencies, vocabulary, metadata, manifest
        self._blocks, self._scratch = blocks_, Scratch(metadata.sparkSession, "tfidf")
        self._parts: tuple = ()

    @classmethod
    def fit(
        cls, docs: DataFrame, key: str, text: str, min_df: int = V.MIN_DF, max_df: float = V.MAX_DF, ngrams: int = V.NGRAMS,
        tie: str | None = None, rules: dict | None = None, keep: bool = True,
    ) -> "TfidfIndex":
        """Sublinear tf, smoothed idf, L2 norm. ``key`` must be unique; documents of equal score rank by ``tie`` (a column), then key.

        Terms are counted once, into a scratch table that the vocabulary and the blocks read. ``rules``: how ``docs``
        came about, for the manifest.

        Without ``keep`` only df is counted, and the vocabulary is all that is written. A search of few queries then reads ``docs`` once more
        and weighs them where they lie; anything else makes the tables as usual. For few searches in many texts that lie in files.
        """
        manifest = {"min_df": min_df, "max_df": max_df, "ngrams": ngrams, "key": key, "tie": tie or key, "text": text, "rules": rules or {}, "n": 0}
        return cls._grown(docs, manifest, None, keep)

    def add(self, docs: DataFrame) -> "TfidfIndex":
        """The index with more documents: only their terms are counted; df is merged, and what rests on it is made anew.

        It equals one of all documents. A key that is there already raises ValueError; the columns must be those of the metadata.
        """
        key = self.manifest["key"]
        if docs.select(key).join(self.metadata.select(key), key, "left_semi").limit(1).count():
            raise ValueError(f"a document of the same {key} is in the index")
        return self._grown(docs, self.manifest, self)

    @classmethod
    def _grown(cls, docs: DataFrame, manifest: dict, before: "TfidfIndex | None", keep: bool = True) -> "TfidfIndex":
        scratch = Scratch(docs.sparkSession, "tfidf")
        how, keys, counted, parts = (manifest["text"], manifest["ngrams"]), _keys(manifest["key"], manifest["tie"]), None, ()
        if keep:
            counted = scratch.write(terms(docs, manifest["key"], *how, manifest["tie"]), "terms")
            each = counted.select("term")
        else:
            lone, again = parts = cls._parted(docs, keys, scratch)
            each = _each(_grams(lone, keys, *how), [], F.array_distinct("t"))
            if again is not None:
                each = each.unionByName(terms(again, manifest["key"], *how, manifest["tie"]).select("term"))
        df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if before:
            df = df.unionByName(before.frequencies).groupBy("term").agg(F.sum("df").alias("df"))
            counted, metadata = before.counted.unionByName(counted), before.metadata.unionByName(docs.select(before.metadata.columns))
        n = manifest["n"] + docs.count()
        frequencies = scratch.write(df, "frequencies")
        kept = frequencies.where((F.col("df") >= manifest["min_df"]) & (F.col("df") <= manifest["max_df"] * F.lit(n)))
        vocabulary = scratch.write(kept.select("term", "df", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "vocabulary")
        out = cls(counted, frequencies, vocabulary, metadata if before else docs, manifest | {"n": n})
        out._parts = parts
        return out

    @staticmethod
    def _parted(docs: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
        """Rows whose key is theirs alone, and the others (None: there are none), whose texts are counted together. Only keys move where none repeats."""
        twice = scratch.write(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "repeated")
        if twice.isEmpty():
            return docs, None
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return docs.join(twice, same, "left_anti"), docs.join(twice, same, "left_semi")

    @property
    def counted(self) -> DataFrame:
        if self._counted is None:
            m = self.manifest
            self._counted = self._scratch.write(terms(self.metadata, m["key"], m["text"], m["ngrams"], m["tie"]), "terms")
        return self._counted

    def _words(self) -> blocks.Words | None:
        """The vocabulary for the tasks. None if it is too large, or if two terms of the documents share a hash (the tables then serve)."""
        size = self.vocabulary.count()
        if size * 12 > self.MOST_WORDS:
            return None
        if not self.frequencies.groupBy(_hash("term").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return None
        n = self.manifest["n"]
        t = self.vocabulary.select(_hash("term").alias("h"), F.col("df").cast("int" if n < 1 << 31 else "long").alias("df")).orderBy("h").toArrow()
        return blocks.Words(t["h"].to_numpy(), t["df"].to_numpy(), n)

    def _texts(self) -> DataFrame:
        """doc, tie, terms (hashes, with repeats), times: the documents for a search where they lie."""
        m, (lone, again) = self.manifest, self._parts
        names = [F.col(m["key"]).alias("doc"), F.col(m["tie"]).alias("tie")]
        out = _grams(lone, self._keys(), m["text"], m["ngrams"]).select(
            *names, F.transform("t", _hash).alias("terms"), F.lit(None).cast("array<long>").alias("times")
        )
        if again is not None:  # of equal keys one row, no longer than the different terms
            t = terms(again, m["key"], m["text"], m["ngrams"], m["tie"])
            t = t.groupBy(*self._keys()).agg(F.collect_list(F.struct(_hash("term").alias("h"), "tf")).alias("v"))
            out = out.unionByName(t.select(*names, F.col("v.h").alias("terms"), F.col("v.tf").alias("times")))
        return out

    @staticmethod
    def _vectors(counted: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
        """keys, terms (most frequent first), weights, often (how many of the terms are not rare): a row per document."""
        w = counted.join(vocabulary, "term").select(*keys, "term", "df", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
        each = F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("often"), "term", "w")))  # a document's terms
        v = w.groupBy(*keys).agg(each.alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        often = F.size(F.filter("v", lambda x: -x.often > many.RARE)).alias("often")
        return v.select(*keys, F.col("v.term").alias("terms"), F.transform("v.w", lambda x: x / F.col("norm")).alias("weights"), often)

    def _keys(self) -> list[str]:
        return _keys(self.manifest["key"], self.manifest["tie"])

    @property
    def postings(self) -> DataFrame:
        """doc, tie, term, weight."""
        each = self._vectors(self.counted, self.vocabulary, self._keys()).select(*self._keys(), F.explode(F.arrays_zip("terms", "weights")).alias("p"))
        return each.select(*self._keys(), F.col("p.terms").alias("term"), F.col("p.weights").alias("weight"))

    @property
    def blocks(self) -> DataFrame:
        if self._blocks is None:
            made = blocks.build(self._vectors(self.counted, self.vocabulary, self._keys()), self.manifest["key"], self.manifest["tie"])
            self._blocks = self._scratch.write(made, "blocks")
        return self._blocks

    def search(
        self, queries: DataFrame, key: str, text: str, top_k: int = V.TOP_K, min_score: float = 0.0, exclude: str | None = None, show: tuple[str, ...] = ()
    ) -> DataFrame:
        """key, doc, rank, score, and the metadata's columns ``show``: the best documents of each query by cosine, ties as the index says.

        Queries travel in a list of bounded size to the blocks, whose postings don't move; more than one list of queries, or more than a
        quarter as many as documents, meet them by joins instead. A query without a known term gives no rows; so
        does top_k < 1. Scores are ranked after rounding to nine digits, since sums of doubles depend on their order.
        """
        doc, tie = self.manifest["key"], self.manifest["tie"]
        ties = [doc] if tie == doc else [tie, doc]
        same = F.md5(F.array_join(X.index_tokens(text), " ")).alias("_same")  # equal token lists share one search
        asked = queries.select(key, same, *([F.col(exclude).alias("own")] if exclude else []))
        counted = terms(queries.select(same, text).dropDuplicates(["_same"]), "_same", text, self.manifest["ngrams"])
        # a query leaves out one document at most, so one more than top_k is enough
        most = top_k + 1 if exclude else top_k
        wanted = self._vectors(counted, self.vocabulary, ["_same"])
        wanted = self._scratch.write(wanted if top_k > 0 else wanted.limit(0), "queries")
        one_list = blocks.query_lists(wanted) <= 1
        if one_list and self._counted is None and self._blocks is None and (words := self._words()):
            asked_for = wanted.withColumn("terms", F.transform("terms", _hash))
            s = blocks.search_texts(self._texts(), words, asked_for, "_same", max(most, 1), min_score)
        elif not one_list or wanted.count() * self.MANY > self.manifest["n"]:
            return self._search_many(wanted, asked, key, max(most, 1), top_k, min_score, show)
        else:
            s = blocks.search(self.blocks, wanted, "_same", max(most, 1), min_score, lambda found: self._scratch.write(found, "found"))
        s = s.select("_same", F.col("doc").alias(doc), *([F.col("tie").alias(tie)] if tie != doc else []), "score")
        s = _best(s, "_same", ties, most).join(asked, "_same")
        if exclude:
            s = s.where(~F.coalesce(F.col("own") == F.col(doc), F.lit(False)))
        s = _best(s, key, ties, top_k).select(F.col(key), doc, "rank", F.round("score", 6).alias("score"))
        return self._shown(s, doc, show).select(*s.columns, "_shown.*") if show else s

    def _shown(self, rows: DataFrame, doc: str, show: tuple[str, ...]) -> DataFrame:
        """With ``_shown``, a struct of the metadata's columns ``show``."""
        if not show:
            return rows.withColumn("_shown", F.struct(F.lit(0)))
        more = self.metadata.select(F.col(self.manifest["key"]).alias("_doc"), F.struct(*show).alias("_shown")).dropDuplicates(["_doc"])
        return rows.join(more, F.col(doc).eqNullSafe(F.col("_doc"))).drop("_doc")

    def _search_many(self, wanted: DataFrame, asked: DataFrame, key: str, most: int, top_k: int, min_score: float, show: tuple[str, ...]) -> DataFrame:
        doc, tie = self.manifest["key"], self.manifest["tie"]
        rows = self._vectors(self.counted, self.vocabulary, self._keys()).select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), "terms", "weights", "often")
        found = many.search(self._shown(rows, "doc", show).withColumnRenamed("_shown", "shown"), wanted, "_same", most, min_score, self._scratch)
        best = F.col("best")
        if "own" in asked.columns:
            best = F.filter(best, lambda x: ~F.coalesce(x.doc == F.col("own"), F.lit(False)))
        each = found.join(asked, "_same").select(key, F.posexplode(F.slice(best, 1, top_k)).alias("at", "x"))
        return each.select(
            key, F.col("x.doc").alias(doc), (F.col("at") + 1).cast("long").alias("rank"), F.round(-F.col("x.down"), 6).alias("score"),
            *(F.col(f"x.shown.{c}").alias(c) for c in show),
        )

    def counts(self) -> dict[str, int]:
        """Rows of the index, documents with a term, and the size of the vocabulary."""
        with_terms = self.blocks.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
        return {"documents": self.metadata.count(), "documents_with_terms": with_terms, "vocabulary_size": self.vocabulary.count()}

    def save(self, path: str) -> None:
        """The tables of one version, and the manifest with settings, rules and row counts, written last.

        An index that was loaded from ``path`` and has grown is written beside the version that is read, which stays valid until
        the manifest names the new one; counted terms and metadata of earlier segments stay where they are.
        """
        spark = self.metadata.sparkSession
        old = _manifest(spark, path)
        grows = self.manifest.get("path") == path and old.get("version") == self.manifest.get("version") is not None
        segments = list(old["segments"]) if grows else []
        version = uuid.uuid4().hex[:12]
        for name in ("frequencies", "vocabulary", "blocks"):
            getattr(self, name).write.parquet(f"{path}/{name}-{version}")
        for name in ("counted", "metadata"):
            rows = getattr(self, name)
            if grows:  # what the last version doesn't have
                key = self.manifest["key"]
                had = spark.read.parquet(*(f"{path}/metadata/{s}" for s in segments)).select(key)
                rows = rows.join(had, key, "left_anti")
            rows.write.parquet(f"{path}/{name}/{version}")
        said = {k: v for k, v in self.manifest.items() if k not in ("counts", "generated_at", "path")}
        said |= {"version": version, "segments": [*segments, version], "counts": self.counts(), "generated_at": generated_at()}
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TfidfIndex":
        """The saved index; FileNotFoundError without a table, ValueError where columns or row counts are not those of the manifest."""
        manifest = _manifest(spark, path)
        if not manifest:
            raise FileNotFoundError(f"{path}/manifest")
        places = {name: [f"{path}/{name}-{manifest['version']}"] for name in ("frequencies", "vocabulary", "blocks")}
        places |= {name: [f"{path}/{name}/{s}" for s in manifest["segments"]] for name in ("counted", "metadata")}
        for p in (p for ps in places.values() for p in ps):
            if not exists(spark, p):
                raise FileNotFoundError(p)
        tables = {name: spark.read.parquet(*ps) for name, ps in places.items()}
        require(tables["vocabulary"], ["term", "df", "idf"], "index vocabulary")
        require(tables["counted"], [manifest["key"], manifest["tie"], "term", "tf"], "index terms")
        # an index of conversations needs all that its readers show; one of other documents its key only
        require(tables["metadata"], METADATA if manifest["key"] == "interaction_id" else [manifest["key"]], "index metadata")
        out = cls(*(tables[k] for k in ("counted", "frequencies", "vocabulary", "metadata")), manifest | {"path": path}, tables["blocks"])
        if (counts := out.counts()) != manifest["counts"]:
            raise ValueError(f"the index at {path} has {counts}, its manifest says {manifest['counts']}")
        return out

    def retrieve(self, query: str | None, top_k: int = V.TOP_K, exclude_interaction_id: str | None = None, min_score: float = 0.0) -> list[dict]:
        """One query; an empty or missing one gives an empty list."""
        if query is None or not str(query).strip() or top_k < 1:
            return []
        spark = self.metadata.sparkSession
        q = spark.createDataFrame([(0, str(query), exclude_interaction_id)], "qid long, q string, own string")
        found = self.search(q, "qid", "q", top_k, min_score, "own").join(self.metadata, self.manifest["key"]).orderBy("rank")
        return [r.asDict() for r in found.withColumnRenamed("score", "retrieval_score").drop("qid").limit(top_k).collect()]


def evaluate(index: TfidfIndex, golden: DataFrame, top_k: int = 10) -> DataFrame:
    """One row per golden row with text: golden_id, intent, n_results, top1_score, first_match_rank. Its own message is left out of the results."""
    doc = index.manifest["key"]
    known = index.metadata.select("customer_normalized_text", F.col(doc).alias("own"))
    q = golden.withColumn("customer_normalized_text", X.normalize("customer_text")).where("customer_normalized_text <> ''")
    q = q.join(known, "customer_normalized_text", "left").select(F.struct("golden_id", "intent").alias("golden"), "customer_text", "own")
    found = index.search(q, "golden", "customer_text", top_k, 0.0, "own", ("intent",))
    per = found.groupBy("golden").agg(
        F.count(F.lit(1)).alias("n_results"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"),
        F.min(F.when(F.col("intent") == F.col("golden.intent"), F.col("rank"))).alias("first_match_rank"),
    )
    out = q.select("golden.*").join(per.withColumn("golden_id", F.col("golden.golden_id")).drop("golden"), "golden_id", "left")
    return out.fillna(0, ["n_results"]).fillna(0.0, ["top1_score"])


def metrics(per_query: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: evaluated, no_result, hit rates, mrr, mean_top1."""
    r = F.col("first_match_rank")
    n = F.count(F.lit(1))
    rate = lambda c: F.coalesce(X.rounded(F.avg(c), 4), F.lit(0.0))
    return per_query.agg(
        n.alias("evaluated"), F.count_if(F.col("n_results") == 0).alias("no_result"),
        *(rate(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"hit_rate_{k}") for k in ks),
        rate(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), rate("top1_score").alias("mean_top1"),
    )


def pick_qualitative(per_query: DataFrame, least: int = 10) -> list[tuple[str, str]]:
    """(golden_id, category): quotas by category, the first category that takes a row keeps it.

    per_query: golden_id, n_results, top1_score, first_match_rank, is_ambiguous, is_short, has_url, is_multi_turn.
    A golden set has at most MOST_GOLDEN rows, so it may be collected; larger ones are refused.
    """
    rows = per_query.orderBy("golden_id").limit(V.MOST_GOLDEN + 1).collect()
    if len(rows) > V.MOST_GOLDEN:
        raise ValueError(f"a golden set has at most {V.MOST_GOLDEN} rows")
    hit = [r for r in rows if r.n_results > 0]
    lists = {
        "good_high_similarity": sorted(hit, key=lambda r: (-r.top1_score, r.golden_id)),
        "weak_low_similarity": sorted(hit, key=lambda r: (r.top1_score, r.golden_id)),
        "weak_no_intent_match": [r for r in hit if r.first_match_rank is None],
        "ambiguous_query": [r for r in rows if r.is_ambiguous],
        "short_query": [r for r in rows if r.is_short],
        "url_bearing_query": [r for r in rows if r.has_url],
        "multi_turn_query": [r for r in rows if r.is_multi_turn],
        "no_result_query": [r for r in rows if r.n_results == 0],
    }
    chosen: dict[str, str] = {}
    for category, quota in V.QUALITATIVE:
        free = [r.golden_id for r in lists[category] if r.golden_id not in chosen]
        chosen |= dict.fromkeys(free[:quota], category)
    free = [r.golden_id for r in hit if r.golden_id not in chosen]
    chosen |= dict.fromkeys(free[: max(0, least - len(chosen))], "additional")
    return sorted(chosen.items())


def assessment(n_results, top1, first_match):
    """A sentence on one query's results, as a Column."""
    return (
        F.when(n_results == 0, "nothing in the index shares a term")
        .when((first_match == 1) & (top1 >= V.STRONG_MATCH), "strong match of the same intent")
        .when(first_match == 1, "the same intent first, at modest similarity")
        .when(first_match.isNotNull(), F.concat(F.lit("the same intent at rank "), first_match.cast("string")))
        .otherwise("no result of the same intent")
    )
