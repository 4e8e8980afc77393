"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, fixity, importance, language_id, lexical, line_dedup, packing, pii, secrets, simhash, spelling, substrings


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents; nulls, ties and repeated rows as in ``decontamination.find_leaks``."""
    return decontamination.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers removed from each document and the digest of what stays; nulls, ties and repeated rows as in ``line_dedup.line_results``."""
    out = line_dedup.line_results(_read(spark, sf_dir, "documents"))
    return out.select(
        "row.doc_id", "n_lines", F.size("removed").alias("n_removed"), line_dedup.ranges(F.col("removed")).alias("removed"),
        F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; nulls, ties and repeated rows as in ``exact_dedup.exact_dedup``."""
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets; nulls and repeated rows as in ``secrets.find_secrets``."""
    return secrets.secret_digest(secrets.find_secrets(_read(spark, sf_dir, "documents")))


def _aged(page_id: Column) -> Column:
    return F.substring(F.sha2(page_id.cast("string").cast("binary"), 256), 1, 2)


def replica_of(records: DataFrame) -> DataFrame:
    """A second copy of the records: of 256 about three have a changed first byte, two are lost, one is there twice, and one more under another id."""
    age, record = _aged(F.col("page_id")), F.col("record")
    kept = records.withColumn("record", F.when(age < "03", F.overlay("record", F.lit("?"), F.lit(1))).otherwise(record)).where(~age.between("03", "04"))
    twice = records.where(age == "05")
    stray = records.where(age == "06").select((F.col("page_id") + 1_000_000_000).alias("page_id"), (F.col("volume") + 1_000_000).alias("volume"), "record")
    return kept.unionByName(twice).unionByName(stray)


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the pages' records against ``replica_of`` them; nulls and repeated rows as in ``fixity.audit``."""
    records = fixity.warc_records(_read(spark, sf_dir, "pages"))
    return fixity.audit(records, replica_of(records))


OP5_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1024 AS volume, substr(sha256(page_id::VARCHAR), 1, 2) AS age,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
all_rows AS (
  SELECT page_id, volume,
         row_number() OVER w - 1 AS place,
         CAST(coalesce(sum(strlen(record)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
         CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256,
         CASE WHEN age < '03' THEN 'corrupt' WHEN age <= '04' THEN 'missing' ELSE 'intact' END AS status
  FROM r WINDOW w AS (PARTITION BY volume ORDER BY page_id)
  UNION ALL
  SELECT page_id, volume, NULL, NULL, CAST(strlen(record) AS BIGINT), sha256(record), 'extra' FROM r WHERE age = '05'
  UNION ALL
  SELECT page_id + 1000000000, volume + 1000000, NULL, NULL, CAST(strlen(record) AS BIGINT), sha256(record), 'extra' FROM r WHERE age = '06')
SELECT *, status = 'intact' AS intact FROM all_rows
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components; nulls, ties and repeated rows as in ``simhash.simhash_components``."""
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data; nulls and repeated rows as in ``pii.find_pii``."""
    return pii.pii_digest(pii.find_pii(_read(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; nulls and repeated rows as in ``packing.pack``."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and the draw; nulls, ties and repeated rows as in ``importance.importance_resample``."""
    return importance.importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and scores; nulls and repeated rows as in ``language_id.identify``."""
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item; nulls, ties and repeated rows as in ``lexical.search``."""
    return lexical.search(lexical.build_index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, their near words, forms and roots; nulls, ties and repeated rows as in ``spelling.spelling_variants``."""
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"), every=31)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words without later copies of 20 or more; nulls, ties and repeated rows as in ``substrings.dedup_substrings``."""
    out = substrings.dedup_substrings(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_line_dedup, op3_exact_dedup, op4_secrets, op5_fixity, op6_simhash, op7_pii,
              op8_packing, op9_importance, op10_language_id, op11_lexical, op12_spelling, op13_substrings, pipeline)
}

ORACLE_SQL = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op5_fixity": OP5_SQL, "op11_lexical": lexical.ORACLE_SQL, "op12_spelling": spelling.ORACLE_SQL,
              "op13_substrings": substrings.ORACLE_SQL}
