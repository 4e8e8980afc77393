"""Query name -> Spark function, and query name -> the same in DuckDB SQL.

Every query runs over whole tables. Integers are BIGINT, doubles are rounded alike on both sides, lists are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .operators import agent, brands, labels, pairs, profile, quantiles, retrieval, sampling, threads
from .operators.typed import typed
from .plans import oracle as O
from .plans.oracle import sql
from .plans.staging import Scratch
from .sources import io, messages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BRANDS = messages.BRANDS


def query(oracle: str | None = None, *needs: str):
    """Register a function under its name; ``oracle`` is its SELECT, ``needs`` the CTEs that it reads."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *needs)
        return f

    return register


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return messages.read(spark, d)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return typed(_raw(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("inbound")


def _said(spark: SparkSession, d: str) -> DataFrame:
    return pairs.brand_replies(_typed(spark, d), BRANDS)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return labels.label(_asked(spark, d))


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    return labels.assess(_labelled(spark, d))


def _graph(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = threads.nodes(t)
    r = threads.roots(n)
    return n, r, threads.sizes(n, r)


def _interactions(spark: SparkSession, d: str) -> DataFrame:
    """Messages and pairs are written once each: several branches of a plan read them."""
    scratch = Scratch(spark, "interactions")
    t = scratch.write(_typed(spark, d), "typed")
    _, r, s = _graph(t)
    return scratch.write(pairs.interactions(t, BRANDS, r, s), "interactions")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return labels.label(_interactions(spark, d).withColumn("clean", X.clean("customer_text")))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# ---- text ----
@query(f"SELECT id, {O.norm('text')} AS normalized FROM typed", "typed")
def text_normalize(spark, d):
    return _typed(spark, d).select("id", X.normalize("text").alias("normalized"))


@query("SELECT id, clean FROM typed", "typed")
def text_clean(spark, d):
    return _typed(spark, d).select("id", "clean")


@query(f"SELECT doc_id, md5({O.clean('text')}) AS clean_md5 FROM documents")
def text_clean_documents(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(X.clean("text")).alias("clean_md5"))


@query(f"SELECT id, array_to_string({O.urls('text')}, ' | ') AS urls FROM typed", "typed")
def url_extract(spark, d):
    return _typed(spark, d).select("id", F.array_join(X.urls("text"), " | ").alias("urls"))


@query(f"SELECT page_id, CAST(len({O.urls('html')}) AS BIGINT) AS n_urls FROM pages")
def url_extract_pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.size(X.urls("html")).cast("long").alias("n_urls"))


@query(f"SELECT id, CAST({O.words('clean')} AS BIGINT) AS n_words FROM typed", "typed")
def word_count(spark, d):
    return _typed(spark, d).select("id", X.words(F.col("clean")).alias("n_words"))


@query(f"SELECT id, {O.content('clean')} AS has_content FROM typed", "typed")
def has_content_flags(spark, d):
    return _typed(spark, d).select("id", X.has_content(F.col("clean")).alias("has_content"))


@query("SELECT id, " + ", ".join(f"{e} AS {k}" for k, e in O.signals("text", "clean").items()) + " FROM replies", "replies")
def generic_reply_signals(spark, d):
    return _said(spark, d).select("id", X.reply_signals("text", "clean").alias("s")).select("id", "s.*")


_RED = "red, n_url, n_email, n_phone, n_number"


def _redacted(df: DataFrame, key: str, column: str) -> DataFrame:
    r = df.select(key, X.redact(column).alias("r"))
    return r.select(key, F.col("r.text").alias("red"), *(F.col(f"r.{k}").alias(f"n_{k}") for k in X.KINDS))


@query(f"SELECT id, {_RED} FROM ({O.redaction('typed', 'text', 'id')})", "typed")
def pii_redaction(spark, d):
    return _redacted(_typed(spark, d), "id", "text")


@query(f"SELECT doc_id, md5(red) AS red_md5, n_url, n_email, n_phone, n_number FROM ({O.redaction('documents', 'text', 'doc_id')})")
def pii_redaction_documents(spark, d):
    r = _redacted(_documents(spark, d), "doc_id", "text")
    return r.select("doc_id", F.md5("red").alias("red_md5"), *(f"n_{k}" for k in X.KINDS))


@query(
    "SELECT " + ", ".join(f"CAST(sum(c.n_{k} + b.n_{k}) AS BIGINT) AS n_{k}" for k in X.KINDS)
    + ", count(*) FILTER (" + " + ".join(f"c.n_{k} + b.n_{k}" for k in X.KINDS) + " > 0) AS pairs_with_redaction FROM cred c JOIN bred b USING (id)",
    "cred", "bred",
)
def redaction_totals(spark, d):
    t = _typed(spark, d)
    c = pairs.outcomes(t, pairs.brand_replies(t, BRANDS)).where("outcome = 'candidate'").select(X.redact("p_text").alias("c"), X.redact("text").alias("b"))
    n = {k: F.col(f"c.{k}") + F.col(f"b.{k}") for k in X.KINDS}
    return c.agg(*(F.sum(v).alias(f"n_{k}") for k, v in n.items()), F.count_if(sum(n.values(), F.lit(0)) > 0).alias("pairs_with_redaction"))


# ---- intents ----
@query("SELECT id, matched FROM labelled", "labelled")
def intent_matches(spark, d):
    return _labelled(spark, d).select("id", F.array_join("matched", ", ").alias("matched"))


@query(
    f"SELECT id, intent, n_matched >= 2 AS is_ambiguous, CASE WHEN n_matched = 0 THEN 'no keyword rule matched' ELSE 'keyword rule ''' || intent || '''' || "
    f"CASE WHEN n_matched >= 2 THEN '; also matched ' || {O.joined(', ', 'intent')} ELSE '' END END AS label_rule FROM labelled",
    "labelled",
)
def intent_label(spark, d):
    return _labelled(spark, d).select("id", "intent", "is_ambiguous", "label_rule")


@query("SELECT id, agent_intent FROM labelled", "labelled")
def intent_label_agent(spark, d):
    return _labelled(spark, d).select("id", "agent_intent")


_VOCABULARY = "(VALUES " + ", ".join(
    f"({k}, " + ", ".join(map(O.q, (n, V.LABELS[n], *V.SCOPE[n]))) + ")" for k, n in enumerate(V.TAXONOMY_ORDER)
) + ") AS v(place, intent, definition, includes, excludes, expected_reply)"


@query(f"SELECT v.intent, count(l.id) AS n FROM {_VOCABULARY} LEFT JOIN labelled l USING (intent) GROUP BY v.intent", "labelled")
def intent_distribution(spark, d):
    return labels.distribution(_labelled(spark, d))


@query(
    "SELECT intent, n FROM (" + " UNION ALL ".join(f"SELECT {O.q(n)} AS intent, count(*) FILTER ({h}) AS n FROM labelled" for n, h in O.HIT.items()) + ") WHERE n > 0",
    "labelled",
)
def rule_coverage(spark, d):
    return labels.coverage(_labelled(spark, d))


@query(f"SELECT CAST(place AS BIGINT) AS place, intent, definition, includes, excludes, expected_reply FROM {_VOCABULARY}")
def label_dimension(spark, d):
    return labels.dimension(spark)


@query("SELECT id, agent_intent, points, points / 100.0::DOUBLE AS confidence, band, evidence FROM assessed", "assessed")
def intent_confidence(spark, d):
    return _assessed(spark, d).select("id", "agent_intent", "points", "confidence", "band", "evidence")


@query("SELECT band, count(*) AS n FROM assessed GROUP BY band", "assessed")
def confidence_bands(spark, d):
    return _assessed(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, escalation, escalation <> 'none' AS needs_review, {O.REASON} AS reason FROM assessed", "assessed")
def escalation(spark, d):
    return _assessed(spark, d).select("id", "escalation", "needs_review", "reason")


SAMPLES = ["My delivery has not arrived", "half my items were missing from my order", "I was charged twice for my order", "my clubcard points are missing",
           "is the gluten free bread back in stock", "huge queue at the till in your store", "asdfghjkl qwerty zzz", "I cannot log into my account",
           "I want to speak to a human", "Is bread available?"]
_SAMPLES = "(SELECT CAST(k AS BIGINT) AS id, t AS text FROM (VALUES " + ", ".join(f"({k}, {O.q(s)})" for k, s in enumerate(SAMPLES)) + ") AS v(k, t))"


@query(
    f"SELECT id, agent_intent, points, escalation FROM ({O.assessed('(' + O.labelled(f'(SELECT *, {O.clean('text')} AS clean FROM {_SAMPLES})') + ')')})"
)
def sample_messages(spark, d):
    s = spark.createDataFrame(list(enumerate(SAMPLES)), "id long, text string")
    return labels.assess(labels.label(s.withColumn("clean", X.clean("text")))).select("id", "agent_intent", "points", "escalation")


# ---- profile ----
@query(
    """SELECT count(*) AS total_rows, count(*) FILTER (inbound = 'True') AS inbound_true, count(*) FILTER (inbound = 'False') AS inbound_false,
  count(*) FILTER (coalesce(inbound, '') NOT IN ('True', 'False')) AS inbound_other, count(DISTINCT author_id) AS unique_authors,
  count(DISTINCT author_id) FILTER (inbound = 'False') AS unique_brands, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text FROM messages""",
    "messages",
)
def dataset_profile(spark, d):
    return profile.dataset_profile(_raw(spark, d))


@query(
    """SELECT count(response_tweet_id) AS has_response, count(in_response_to_tweet_id) AS has_in_response_to,
  count(*) FILTER (in_response_to_tweet_id IS NULL) AS roots, count(*) FILTER (response_tweet_id IS NOT NULL AND in_response_to_tweet_id IS NOT NULL) AS mid_thread,
  count(*) FILTER (contains(response_tweet_id, ',')) AS branching FROM messages""",
    "messages",
)
def threading_signals(spark, d):
    return profile.threading_signals(_raw(spark, d))


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM messages" for c in messages.RAW_COLUMNS), "messages"
)
def null_counts(spark, d):
    return profile.null_counts(_raw(spark, d).select(*messages.RAW_COLUMNS))


@query("SELECT author_id, count(*) AS replies FROM messages WHERE inbound = 'False' GROUP BY 1 ORDER BY replies DESC, author_id LIMIT 20", "messages")
def top_authors(spark, d):
    return profile.brand_volume(_raw(spark, d))


@query(
    f"SELECT min(nullif(i, '')) AS first, max(nullif(i, '')) AS last, count(*) FILTER (i = '') AS bad_dates FROM (SELECT {O.ISO('created_at')} AS i FROM messages)",
    "messages",
)
def time_range(spark, d):
    return profile.time_range(_raw(spark, d))


@query(
    """SELECT tweet_id, author_id, inbound, created_at, CASE WHEN length(x) > 160 THEN substr(x, 1, 159) || '…' ELSE x END AS text, response_tweet_id, in_response_to_tweet_id
  FROM (SELECT *, trim(replace(text, chr(10), ' ')) AS x FROM messages) ORDER BY CAST(tweet_id AS BIGINT) LIMIT 5""",
    "messages",
)
def example_rows(spark, d):
    return profile.examples(_raw(spark, d))


# ---- threads and pairs ----
@query("SELECT id, parent, brand, p_text AS customer_text, p_author AS customer_author, outcome FROM outcomes", "outcomes")
def reply_parent_join(spark, d):
    t = _typed(spark, d)
    o = pairs.outcomes(t, pairs.brand_replies(t, BRANDS))
    return o.select("id", "parent", "brand", F.col("p_text").alias("customer_text"), F.col("p_author").alias("customer_author"), "outcome")


@query("SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome", "outcomes")
def relationship_outcomes(spark, d):
    t = _typed(spark, d)
    return pairs.outcomes(t, pairs.brand_replies(t, BRANDS)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT id, p_inbound IS NOT NULL AS parent_exists, coalesce(p_inbound, false) AS parent_inbound, coalesce(p_clean <> '', false) AS parent_has_text FROM outcomes",
    "outcomes",
)
def existence_flags(spark, d):
    t = _typed(spark, d)
    o = pairs.outcomes(t, pairs.brand_replies(t, BRANDS))
    false = F.lit(False)
    return o.select(
        "id", F.col("p_inbound").isNotNull().alias("parent_exists"), F.coalesce("p_inbound", false).alias("parent_inbound"),
        F.coalesce(F.col("p_clean") != "", false).alias("parent_has_text"),
    )


@query("SELECT id, root FROM roots", "roots")
def thread_roots(spark, d):
    return threads.roots(threads.nodes(_typed(spark, d)))


@query("SELECT root, size, n_inbound, n_outbound, is_multi_turn FROM sizes", "sizes")
def thread_sizes(spark, d):
    return _graph(_typed(spark, d))[2]


@query("SELECT count(*) AS threads, count(*) FILTER (is_multi_turn) AS multi_turn FROM sizes", "sizes")
def multi_turn(spark, d):
    return _graph(_typed(spark, d))[2].agg(F.count(F.lit(1)).alias("threads"), F.count_if("is_multi_turn").alias("multi_turn"))


def _dist(c: str, source: str) -> str:
    at = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    ps = ", ".join(f'CAST(floor(quantile_cont({c}, {v})) AS BIGINT) AS "{k}"' for k, v in at.items())
    return f'SELECT count({c}) AS "count", round(1e-9 + avg({c}), 3) AS mean, CAST(min({c}) AS BIGINT) AS "min", {ps}, CAST(max({c}) AS BIGINT) AS "max" FROM {source}'


@query(_dist("size", "sizes"), "sizes")
def length_stats(spark, d):
    return threads.distribution(_graph(_typed(spark, d))[2], "size")


def _hist(c: str, source: str) -> str:
    b = ", ".join(f"('{b}')" for b in threads.BUCKETS)
    return (
        f"SELECT bucket, count(b) AS n FROM (VALUES {b}) AS v(bucket) LEFT JOIN (SELECT CASE WHEN {c} <= 5 THEN CAST({c} AS VARCHAR) WHEN {c} <= 10 THEN '6-10' "
        f"ELSE '11+' END AS b FROM {source}) ON b = bucket GROUP BY bucket"
    )


@query(_hist("size", "sizes"), "sizes")
def length_histogram(spark, d):
    return threads.histogram(_graph(_typed(spark, d))[2], "size")


_TALK = "(SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)"


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query(_dist("turns", _TALK))
def conversation_lengths(spark, d):
    return threads.distribution(_turns(spark, d), "turns")


@query(_hist("turns", _TALK))
def conversation_histogram(spark, d):
    return threads.histogram(_turns(spark, d), "turns")


@query("SELECT * FROM interactions", "interactions")
def interactions(spark, d):
    t = _typed(spark, d)
    _, r, s = _graph(t)
    return pairs.interactions(t, BRANDS, r, s)


@query("SELECT unusable_reason, count(*) AS n FROM interactions WHERE NOT is_usable GROUP BY 1", "interactions")
def unusable_reasons(spark, d):
    return interactions(spark, d).where("not is_usable").groupBy("unusable_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pair_id, is_duplicate FROM interactions", "interactions")
def duplicate_flags(spark, d):
    return interactions(spark, d).select("pair_id", "is_duplicate")


@query("SELECT pair_id, conversation_id, turn_in_conversation FROM interactions", "interactions")
def turn_numbers(spark, d):
    return interactions(spark, d).select("pair_id", "conversation_id", "turn_in_conversation")


@query(
    """SELECT o.*, usable, duplicates, generic_usable, conversations_with_usable, bad_reply_dates,
  CASE WHEN usable > 0 THEN round(1e-9 + 100.0 * CAST(generic_usable AS DOUBLE) / usable, 2) ELSE 0.0 END AS generic_usable_percentage
  FROM (SELECT brand, count(*) AS replies, count(*) FILTER (outcome = 'no_parent_id') AS no_parent_id, count(*) FILTER (outcome = 'parent_not_in_data') AS parent_not_in_data,
      count(*) FILTER (outcome = 'reply_to_non_customer') AS reply_to_non_customer, count(*) FILTER (outcome = 'candidate') AS candidate FROM outcomes GROUP BY brand) o
  JOIN (SELECT brand, count(*) FILTER (is_usable) AS usable, count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (is_usable AND is_generic_reply) AS generic_usable,
      count(DISTINCT conversation_id) FILTER (is_usable) AS conversations_with_usable, count(*) FILTER (brand_created_at = '') AS bad_reply_dates
    FROM interactions GROUP BY brand) p USING (brand)""",
    "outcomes", "interactions",
)
def corpus_summary(spark, d):
    return pairs.summary(_typed(spark, d), interactions(spark, d), BRANDS)


@query(_dist("n", f"(SELECT {O.words('c')} AS n FROM (SELECT {O.clean('customer_text')} AS c FROM interactions WHERE is_usable))"), "interactions")
def message_length_stats(spark, d):
    usable = interactions(spark, d).where("is_usable")
    return threads.distribution(usable.select(X.words(X.clean("customer_text")).alias("n")), "n")


# ---- brands ----
@query("SELECT * FROM customers", "customers")
def brand_customer_metrics(spark, d):
    return brands.customer_metrics(_typed(spark, d), BRANDS)


@query("SELECT * FROM brand_replies", "brand_replies")
def brand_reply_metrics(spark, d):
    return brands.reply_metrics(_typed(spark, d), BRANDS)


@query("SELECT * FROM talks", "talks")
def brand_conversations(spark, d):
    t = _typed(spark, d)
    _, r, s = _graph(t)
    return brands.conversation_metrics(t, BRANDS, r, s)


@query("SELECT * FROM entropy", "entropy")
def brand_entropy(spark, d):
    return brands.entropy(brands.customer_metrics(_typed(spark, d), BRANDS))


def _scores(spark, d):
    t = _typed(spark, d)
    _, r, s = _graph(t)
    return brands.scores(brands.reply_metrics(t, BRANDS), brands.customer_metrics(t, BRANDS), brands.conversation_metrics(t, BRANDS, r, s))


@query("SELECT * FROM scores", "scores")
def brand_scores(spark, d):
    return _scores(spark, d)


_ALL = ", ".join(f"('{b.lower()}')" for b in [*BRANDS, "Nobody"])


@query(f"SELECT brand FROM (VALUES {_ALL}) AS v(brand) WHERE brand NOT IN (SELECT lower(author) FROM typed WHERE NOT inbound)", "typed")
def missing_brands(spark, d):
    return brands.missing(_typed(spark, d), [*BRANDS, "Nobody"])


@query(
    """SELECT s.brand, CASE WHEN len(r) = 0 THEN 'lower overall score' ELSE array_to_string(r[1:2], '; ') END AS reasons FROM (
  SELECT s.brand, list_filter([
    CASE WHEN s.meaningful_percentage < w.meaningful_percentage - 3 THEN 'fewer meaningful replies' END,
    CASE WHEN s.s_reproducibility < 0.9 THEN 'large corpus' END,
    CASE WHEN s.diversity < w.diversity - 0.05 THEN 'narrower issue mix' END,
    CASE WHEN s.multi_turn_conversations / greatest(s.conversations, 1) < w.multi_turn_conversations / greatest(w.conversations, 1) - 0.1 THEN 'fewer multi-turn conversations' END,
    CASE WHEN s.usable_pairs < w.usable_pairs * 0.5 THEN 'fewer usable pairs (' || s.usable_pairs || ')' END], lambda x: x IS NOT NULL) AS r
  FROM scores s, (SELECT * FROM scores ORDER BY selection_score DESC, brand LIMIT 1) w WHERE s.brand <> w.brand) s""",
    "scores",
)
def rejection_reasons(spark, d):
    return brands.rejections(_scores(spark, d))


@query(
    """SELECT brand, selection_score, meaningful_percentage || '% meaningful replies; ' || usable_pairs || ' usable pairs; diversity ' || diversity || ' over '
    || active_categories || ' active categories' AS reasons FROM scores ORDER BY selection_score DESC, brand LIMIT 1""",
    "scores",
)
def winning_brand(spark, d):
    return brands.selection_reasons(_scores(spark, d))


# ---- words ----
_STOP = ", ".join(O.q(w) for w in V.STOPWORDS)


def _unigram(source: str) -> str:
    return (
        f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(clean, '[a-z'']{{2,}}')) AS token FROM {source}) WHERE token NOT IN ({_STOP}) "
        "GROUP BY token ORDER BY n DESC, token LIMIT 50"
    )


@query(_unigram("asked"), "asked")
def unigram_top(spark, d):
    return labels.top(labels.unigrams(_asked(spark, d)), ["token"], 50)


@query(_unigram(f"(SELECT {O.clean('text')} AS clean FROM documents)"))
def unigram_documents(spark, d):
    return labels.top(labels.unigrams(_documents(spark, d).select(X.clean("text").alias("clean"))), ["token"], 50)


@query(
    """SELECT first, second, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: {'first': t[i], 'second': t[i + 1]}), recursive := true)
  FROM (SELECT regexp_extract_all(clean, '[a-z'']{2,}') AS t FROM asked)) GROUP BY ALL ORDER BY n DESC, first, second LIMIT 50""",
    "asked",
)
def bigram_top(spark, d):
    return labels.top(labels.bigrams(_asked(spark, d)), ["first", "second"], 50)


@query(
    f"""SELECT intent, place, example FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY brand_tweet_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY intent, substr(lower(example), 1, 80) ORDER BY brand_tweet_id) AS k
  FROM (SELECT intent, brand_tweet_id, {O.norm('customer_redacted_text')} AS example FROM pairs WHERE is_usable)
  WHERE length(example) BETWEEN 1 AND 160) WHERE k = 1) WHERE place <= 6""",
    "pairs",
)
def intent_examples(spark, d):
    return labels.examples(_pairs(spark, d).where("is_usable"))


# ---- retrieval ----
def _index(spark, d) -> retrieval.TfidfIndex:
    return _index_of(spark, _pairs(spark, d))


def _index_of(spark, pairs_) -> retrieval.TfidfIndex:
    rows = Scratch(spark, "index").write(retrieval.index_rows(pairs_), "rows")
    return retrieval.TfidfIndex.fit(rows, "interaction_id", "customer_normalized_text", tie="brand_tweet_id")


@query(
    """SELECT *, rows_nonempty_text - rows_after_dedupe AS duplicate_text_rows_removed FROM (SELECT count(*) AS rows_total, count(*) FILTER (is_usable) AS rows_usable,
    count(*) FILTER (is_usable AND trim(customer_normalized_text) <> '') AS rows_nonempty_text,
    count(DISTINCT customer_normalized_text) FILTER (is_usable AND trim(customer_normalized_text) <> '') AS rows_after_dedupe FROM interactions)""",
    "interactions",
)
def index_stages(spark, d):
    """How many pairs each stage before the index leaves, observed in the pass that writes the rows to index."""
    audit = retrieval.Audit()
    Scratch(spark, "index").write(retrieval.index_rows(_pairs(spark, d), audit), "rows")
    return spark.createDataFrame([audit.counts()], ", ".join(f"{k} long" for k in audit.counts()))


@query("SELECT pair_id AS interaction_id, customer_normalized_text FROM indexed", "indexed")
def retrieval_dedupe(spark, d):
    return retrieval.index_rows(_pairs(spark, d)).select("interaction_id", "customer_normalized_text")


@query("SELECT term, df, round(idf, 6) AS idf FROM df", "df")
def tfidf_df(spark, d):
    return _index(spark, d).vocabulary.select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT pair_id AS interaction_id, term, round(weight, 6) AS weight FROM postings", "postings")
def tfidf_weights(spark, d):
    return _index(spark, d).postings.select("interaction_id", "term", F.round("weight", 6).alias("weight"))


def _search(queries: str, key: str, text: str, k: int, own: str = "false") -> str:
    return f"""SELECT {key}, pair_id AS interaction_id, "rank", round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, brand_tweet_id) AS "rank" FROM (
    SELECT {key}, pair_id, brand_tweet_id, round(sum(q.weight * p.weight), 9) AS score
    FROM ({O.weights('(' + O.grams(queries, key, text) + ')', 'df', key)}) q JOIN postings p USING (term) JOIN (SELECT pair_id, brand_tweet_id FROM indexed) USING (pair_id) GROUP BY ALL) s
  WHERE score > 0 AND NOT {own}) WHERE "rank" <= {k}"""


@query(_search(_SAMPLES, "id", "text", 5), "postings")
def tfidf_search_topk(spark, d):
    q = spark.createDataFrame(list(enumerate(SAMPLES)), "id long, text string")
    return _index(spark, d).search(q, "id", "text")


@query(_search(_SAMPLES, "id", "text", 5), "postings")
def index_grown(spark, d):
    """The same search in a saved index that began with every other reply and then grew by the rest."""
    rows = Scratch(spark, "index").write(retrieval.index_rows(_pairs(spark, d)), "rows")
    path, odd = f"{Scratch(spark, 'saved').root}/index", F.col("brand_tweet_id") % 2 == 1
    retrieval.TfidfIndex.fit(rows.where(odd), "interaction_id", "customer_normalized_text", tie="brand_tweet_id").save(path)
    retrieval.TfidfIndex.load(spark, path).add(rows.where(~odd)).save(path)
    q = spark.createDataFrame(list(enumerate(SAMPLES)), "id long, text string")
    return retrieval.TfidfIndex.load(spark, path).search(q, "id", "text")


@query(
    "SELECT (SELECT count(*) FROM indexed) AS documents, (SELECT count(DISTINCT pair_id) FROM postings) AS documents_with_terms, (SELECT count(*) FROM df) AS vocabulary_size",
    "indexed", "df", "postings",
)
def index_manifest(spark, d):
    """The row counts that a saved index states, and that loading it has compared with its tables."""
    path = f"{Scratch(spark, 'saved').root}/index"
    _index(spark, d).save(path)
    return spark.createDataFrame([retrieval.TfidfIndex.load(spark, path).manifest["counts"]], "documents long, documents_with_terms long, vocabulary_size long")


def _document_index(spark, d):
    docs = _documents(spark, d).select("doc_id", "text")
    return retrieval.TfidfIndex.fit(docs, "doc_id", "text", ngrams=1, keep=False)


@query(
    f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({O.tokens('text')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n FROM documents)
  WHERE df >= 2 AND df <= 0.9 * n),
p AS ({O.weights('tf', 'df', 'doc_id')}),
q AS ({O.weights('(SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(' + O.tokens('text') + ') AS term FROM benchmark) GROUP BY ALL)', 'df', 'item_id')})
SELECT item_id, doc_id, "rank", round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS "rank" FROM (
  SELECT item_id, doc_id, round(sum(q.weight * p.weight), 9) AS score FROM q JOIN p USING (term) GROUP BY ALL) WHERE score > 0) WHERE "rank" <= 5"""
)
def document_search(spark, d):
    """Every benchmark item against all documents."""
    return _document_index(spark, d).search(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")


def _golden(spark, d) -> tuple[DataFrame, DataFrame]:
    p = _pairs(spark, d)
    return p, Scratch(spark, "golden").write(sampling.golden(Scratch(spark, "pool").write(sampling.pool(p), "pool")), "golden")


# every indexed pair as its own query
_EVALUATED = f"""SELECT golden_id, g.intent, coalesce(n_results, 0) AS n_results, coalesce(top1_score, 0.0) AS top1_score, first_match_rank
  FROM (SELECT pair_id AS golden_id, intent FROM indexed) g LEFT JOIN (
    SELECT golden_id, count(*) AS n_results, max(score) FILTER ("rank" = 1) AS top1_score, min("rank") FILTER (i.intent = q.intent) AS first_match_rank
    FROM ({_search('(SELECT pair_id AS golden_id, customer_text AS text FROM indexed)', 'golden_id', 'text', 10, '(golden_id = pair_id)')}) r
    JOIN (SELECT pair_id AS interaction_id, intent FROM indexed) i USING (interaction_id) JOIN (SELECT pair_id AS golden_id, intent FROM indexed) q USING (golden_id)
    GROUP BY golden_id) USING (golden_id)"""


@query(_EVALUATED, "postings", "indexed")
def retrieval_eval(spark, d):
    index = _index(spark, d)
    return retrieval.evaluate(index, index.metadata.select(F.col("interaction_id").alias("golden_id"), "intent", "customer_text"))


@query(
    f"""SELECT golden_id, CASE WHEN n_results = 0 THEN 'nothing in the index shares a term' WHEN first_match_rank = 1 AND top1_score >= {V.STRONG_MATCH} THEN 'strong match of the same intent'
    WHEN first_match_rank = 1 THEN 'the same intent first, at modest similarity' WHEN first_match_rank IS NOT NULL THEN 'the same intent at rank ' || first_match_rank
    ELSE 'no result of the same intent' END AS assessment FROM ({_EVALUATED})""",
    "postings", "indexed",
)
def retrieval_assessment(spark, d):
    return retrieval_eval(spark, d).select("golden_id", retrieval.assessment(F.col("n_results"), F.col("top1_score"), F.col("first_match_rank")).alias("assessment"))


_OWN = f"(SELECT golden_id, g.customer_text AS text, g.intent AS golden_intent, i.pair_id AS own FROM (SELECT *, {O.norm('customer_text')} AS key FROM golden) g LEFT JOIN indexed i ON key = customer_normalized_text WHERE key <> '')"
_HITS = _search(_OWN, "golden_id", "text", 10, f"coalesce(pair_id = (SELECT any_value(own) FROM {_OWN} o WHERE o.golden_id = s.golden_id), false)")
_RATES = ", ".join(f'round(1e-9 + avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 4) AS hit_rate_{k}' for k in (1, 3, 5, 10))


@query(
    f"""SELECT count(*) AS evaluated, count(*) FILTER (n = 0) AS no_result, {_RATES}, round(1e-9 + avg(coalesce(1.0 / first, 0.0)), 4) AS mrr, round(1e-9 + avg(top), 4) AS mean_top1
  FROM (SELECT o.golden_id, count(pair_id) AS n, coalesce(max(score) FILTER ("rank" = 1), 0.0) AS top, min("rank") FILTER (intent = golden_intent) AS first
    FROM {_OWN} o LEFT JOIN (SELECT r.golden_id, pair_id, "rank", score, intent FROM ({_HITS.replace('pair_id AS interaction_id', 'pair_id')}) r JOIN indexed USING (pair_id)) USING (golden_id)
    GROUP BY o.golden_id)""",
    "golden", "postings",
)
def retrieval_metrics(spark, d):
    p, g = _golden(spark, d)
    return retrieval.metrics(retrieval.evaluate(_index_of(spark, p), g))


# ---- golden set ----
@query("SELECT brand_tweet_id, conversation_id, intent, is_short, is_multi_turn, is_ambiguous, has_url FROM pool", "pool")
def golden_pool(spark, d):
    return sampling.pool(_pairs(spark, d)).select("brand_tweet_id", "conversation_id", "intent", "is_short", "is_multi_turn", "is_ambiguous", "has_url")


@query("SELECT * FROM golden", "golden")
def golden_sample(spark, d):
    return _golden(spark, d)[1]


_COUNTED = [(f"intent:{n}", f"intent = {O.q(n)}") for n in V.TAXONOMY_ORDER] + [(f"flag:{c}", c) for c in (*sampling.FLAGS.values(), "is_generic_reply")]


@query(" UNION ALL ".join(f"SELECT {O.q(n)} AS name, count(*) FILTER ({c}) AS n FROM golden" for n, c in _COUNTED), "golden")
def golden_summary(spark, d):
    return sampling.golden_summary(_golden(spark, d)[1])


# ---- agent ----
def _prompts(spark, d):
    q = spark.createDataFrame(list(enumerate(SAMPLES)), "id long, message string")
    index = _index(spark, d)
    found = index.search(q, "id", "message").join(index.metadata, "interaction_id")
    return agent.prompts(q, "id", found)


_EXAMPLE = lambda a: f"(CASE WHEN length({a}) > 240 THEN rtrim(substr({a}, 1, 239)) || '…' ELSE {a} END)"
_SCRUB = lambda a: f"trim(regexp_replace(regexp_replace({a}, '@{O.WORD}+', ' ', 'g'), '{O.WS}+', ' ', 'g'))"
_ELSE = lambda a, b: f"CASE WHEN {a} <> '' THEN {a} ELSE {b} END"


@query(
    f"""SELECT s.id, {O.q(agent.SYSTEM)} AS system_prompt, concat_ws(chr(10), 'CUSTOMER MESSAGE:', s.text, '', 'RETRIEVED HISTORICAL EXAMPLES:', {O.q(agent.WARNING)},
    coalesce(body, '- None found. Answer with care and invent no details.'), '', 'RESPONSE REQUIREMENTS:',
    {', '.join(O.q('- ' + r) for r in agent.REQUIREMENTS)}) AS user_prompt, coalesce(n, 0) AS retrieved_count, top AS top_similarity
  FROM {_SAMPLES} s LEFT JOIN (SELECT id, count(*) AS n, max(score) FILTER ("rank" = 1) AS top,
      string_agg('Example ' || "rank" || ':' || chr(10) || '- Customer asked: ' || {_EXAMPLE('c')} || chr(10) || '- The shop replied: ' || {_EXAMPLE('b')}, chr(10) ORDER BY "rank") AS body
    FROM (SELECT r.*, {_SCRUB(_ELSE('customer_redacted_text', 'customer_text'))} AS c, {_SCRUB(_ELSE('brand_redacted_text', 'brand_text'))} AS b
      FROM ({_search(_SAMPLES, 'id', 'text', 5)}) r JOIN indexed ON pair_id = interaction_id) GROUP BY id) USING (id)""",
    "postings", "indexed",
)
def prompt_build(spark, d):
    return _prompts(spark, d)


@query(
    f"SELECT id, {O.q(V.MOCK_REPLY)} AS generated_response, true AS generation_success, false AS used_fallback, CAST(NULL AS VARCHAR) AS error_type, 'mock' AS model_name FROM {_SAMPLES}"
)
def mock_generation(spark, d):
    g = agent.generate(_prompts(spark, d))
    return g.select("id", "generated_response", "generation_success", "used_fallback", "error_type", "model_name")


_VALID = f"(SELECT * FROM (SELECT id, trim(text) AS text, {O.clean('trim(text)')} AS clean FROM asked) WHERE text <> '' AND length(text) <= {V.MAX_MESSAGE})"
_CLASSED = O.assessed("(" + O.labelled(_VALID) + ")")


@query(
    f"""SELECT id, text AS customer_message, agent_intent AS intent, points / 100.0::DOUBLE AS intent_confidence, 'deterministic' AS intent_method, evidence AS intent_evidence,
    coalesce(n_found, 0) AS retrieved_count, top AS top_similarity, {O.q(V.MOCK_REPLY)} AS generated_response, true AS generation_success, false AS used_fallback,
    CAST(NULL AS VARCHAR) AS error_type, escalation <> 'none' AS needs_human_review, {O.REASON} AS escalation_reason, 'mock' AS model_name, 'mock' AS mode,
    {O.q(','.join(V.STEPS))} AS workflow_steps
  FROM ({_CLASSED}) LEFT JOIN (SELECT id, count(*) AS n_found, max(score) FILTER ("rank" = 1) AS top FROM ({_search(_VALID, 'id', 'text', 5)}) GROUP BY id) USING (id)""",
    "asked", "postings",
)
def agent_run(spark, d):
    """The whole agent, in mock mode, over every inbound message."""
    out = agent.SupportAgent(_index(spark, d)).transform(_asked(spark, d).select("id", "text"), "id", "text")
    return out.withColumn("workflow_steps", F.array_join("workflow_steps", ","))


@query(f"SELECT id, 'blank' AS validation_error FROM asked WHERE trim(text) = '' UNION ALL SELECT id, 'too_long' FROM asked WHERE length(trim(text)) > {V.MAX_MESSAGE}", "asked")
def validation_errors(spark, d):
    return _asked(spark, d).select("id", agent.validation("text").alias("validation_error")).where("validation_error is not null")


def _compared(spark, d):
    """The taxonomy's label as expected, the agent's as predicted, for every usable pair."""
    return _pairs(spark, d).where("is_usable").select("pair_id", F.col("intent").alias("expected"), F.col("agent_intent").alias("predicted"))


_PAIRED = "(SELECT pair_id, intent AS expected, agent_intent AS predicted FROM pairs WHERE is_usable)"


@query(f"SELECT expected, predicted, count(*) AS n FROM {_PAIRED} WHERE expected <> predicted GROUP BY ALL ORDER BY n DESC, expected, predicted LIMIT 10", "pairs")
def confusion_pairs(spark, d):
    return agent.confusion(_compared(spark, d))


@query(f"SELECT expected, count(*) AS total, round(1e-9 + avg(CAST(expected = predicted AS DOUBLE)), 3) AS accuracy FROM {_PAIRED} GROUP BY expected", "pairs")
def class_accuracy(spark, d):
    return agent.class_accuracy(_compared(spark, d))


_GOLD = f"(SELECT * FROM (SELECT golden_id AS id, intent AS expected, trim(customer_text) AS text, {O.clean('trim(customer_text)')} AS clean FROM golden) WHERE text <> '' AND length(text) <= {V.MAX_MESSAGE})"


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (agent_intent = expected) AS correct, round(1e-9 + avg(CAST(agent_intent = expected AS DOUBLE)), 4) AS accuracy,
    count(*) FILTER (escalation <> 'none') AS escalated, round(1e-9 + avg(CAST(escalation <> 'none' AS DOUBLE)), 4) AS escalation_rate,
    count(*) AS successful, round(1e-9 + 1.0, 4) AS success_rate, round(1e-9 + avg(CAST(coalesce(n_found, 0) AS DOUBLE)), 3) AS average_retrieved
  FROM ({O.assessed("(" + O.labelled(_GOLD) + ")")}) LEFT JOIN (SELECT id, count(*) AS n_found FROM ({_search(_GOLD, 'id', 'text', 5)}) GROUP BY id) USING (id)""",
    "golden", "postings",
)
def agent_eval(spark, d):
    p, g = _golden(spark, d)
    results = agent.SupportAgent(_index_of(spark, p)).transform(g.select("golden_id", "customer_text"), "golden_id", "customer_text")
    return agent.evaluate(results, g, "golden_id")


@query(
    "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'good' ELSE 'other' END AS class, count(*) AS n, round(1e-9 + avg(n_chars), 3) AS mean_chars "
    "FROM labels JOIN documents USING (doc_id) GROUP BY 1"
)
def labelled_documents(spark, d):
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").otherwise("other")
    j = spark.read.parquet(f"{d}/labels.parquet").join(_documents(spark, d).select("doc_id", "n_chars"), "doc_id")
    return j.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"), X.rounded(F.avg("n_chars"), 3).alias("mean_chars"))


# ---- order statistics ----
_SHARES = {"p1": 0.01, "p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}


@query("SELECT source, " + ", ".join(f"round(1e-9 + quantile_cont(length(coalesce(text, ''))::DOUBLE, {p}), 3) AS {k}" for k, p in _SHARES.items()) + " FROM documents GROUP BY source")
def document_length_percentiles(spark, d):
    """Exact percentiles of the documents' lengths by source."""
    lengths = _documents(spark, d).select("source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return quantiles.percentiles(lengths, ["source"], "n", _SHARES).select("source", *(X.rounded(k, 3).alias(k) for k in _SHARES))


# ---- sources and sinks ----
def _in_eight(spark, dump: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The dump written as CSV, as its tasks have it, and read again in eight splits or more, of bounded size."""
    path = f"{Scratch(spark, 'csv').root}/messages"
    io.write_table(dump, path)
    return io.read_messages(spark, f"{path}.csv", columns, max(1, io.size_in_bytes(spark, f"{path}.csv") // 8))[0]


@query("SELECT * FROM messages", "messages")
def csv_round_trip(spark, d):
    """The dump written as CSV and scanned again, all columns as strings."""
    return _in_eight(spark, _raw(spark, d))


@query(r"""SELECT tweet_id, coalesce(text, '') || chr(10) || '"' || tweet_id || '",' || chr(10) || chr(10) || text AS text FROM messages""", "messages")
def csv_line_breaks(spark, d):
    """Texts with line breaks, quotes and commas, written and scanned again."""
    broken = F.concat(F.coalesce("text", F.lit("")), F.lit('\n"'), "tweet_id", F.lit('",\n\n'), "text")
    return _in_eight(spark, _raw(spark, d).withColumn("text", broken), ["tweet_id", "text"])


@query("SELECT tweet_id || ',too,short' AS record FROM messages WHERE CAST(tweet_id AS BIGINT) % 10 = 0", "messages")
def csv_malformed(spark, d):
    """The malformed records of a dump of good files and one with records that are too short."""
    path = f"{Scratch(spark, 'csv').root}/messages"
    dump = Scratch(spark, "csv").write(_raw(spark, d), "dump")
    io.write_table(dump, path)
    short = dump.where("cast(tweet_id as long) % 10 = 0").select(F.concat("tweet_id", F.lit(",too,short")).alias("value"))
    header = spark.createDataFrame([(",".join(messages.RAW_COLUMNS),)], "value string").coalesce(1)
    header.unionByName(short).coalesce(1).write.mode("append").text(f"{path}.csv")
    return io.read_messages(spark, f"{path}.csv")[1].select(F.col(io.CORRUPT).alias("record"))


@query("SELECT tweet_id, text FROM messages", "messages")
def csv_columns(spark, d):
    """Two columns of the dump written as CSV, in many files."""
    path = f"{Scratch(spark, 'csv').root}/messages"
    io.write_table(_raw(spark, d), path)
    return io.read_messages(spark, f"{path}.csv", ["tweet_id", "text"])[0]


@query("SELECT pair_id, customer_text, is_usable FROM interactions", "interactions")
def parquet_round_trip(spark, d):
    path = f"{Scratch(spark, 'sink').root}/interactions"
    io.write_table(interactions(spark, d), path)
    return io.read_table(spark, f"{path}.parquet").select("pair_id", "customer_text", "is_usable")
