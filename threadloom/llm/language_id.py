"""Language ID by string kernels: blended-spectrum presence kernel, Nystroem landmarks, kernel ridge regression.

The kernel of two texts counts the character n-grams (lengths 1 to 3, hashed) that occur in
both, divided by the geometric mean of the numbers in each. A bounded sample of labelled
documents gives the landmarks and the training rows; one-versus-rest kernel ridge regression
is solved on the Nystroem features. Scoring folds landmarks and weights into one matrix with
a row per n-gram, so a batch of documents is scored by one product with its presence matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batches, beside_text, column, text_of, trim, tune, with_text

HASH_BITS = 17
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Grams:
    """The hashed n-grams that are present in a text, each once."""

    def __init__(self):
        self.seen = np.zeros(1 << HASH_BITS, bool)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = codes * _MULTIPLIERS[0]
        self.seen[mixed >> np.uint32(32 - HASH_BITS)] = True
        for n in (1, 2):
            if len(codes) > n:
                mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _MULTIPLIERS[n] + codes[n:] * _MULTIPLIERS[0]
                self.seen[mixed >> np.uint32(32 - HASH_BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


class Model:
    """labels, and a matrix with a row for each hashed n-gram and a column for each label."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray):
        self.labels, self.weights, self.bias = labels, weights, bias

    def scores(self, texts: list[str], grams: Grams) -> np.ndarray:
        """One batch: the presence rows end to end, times the weights, summed for each text."""
        found = [grams(t) for t in texts]
        out = np.zeros((len(texts), len(self.labels)), np.float32)
        sizes = np.array([len(f) for f in found])
        full = np.flatnonzero(sizes)
        for k in range(0, len(full), 256):  # bounds the memory of a product
            rows = full[k : k + 256]
            starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            out[rows] = np.add.reduceat(self.weights[np.concatenate([found[r] for r in rows])], starts, axis=0)
            out[rows] /= np.sqrt(sizes[rows])[:, None]
        return out + self.bias


def fit(texts: list[str], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression of +1/-1 targets on Nystroem features. texts come in a random order."""
    grams = Grams()
    names = sorted(set(labels))
    rows = [grams(t) for t in texts]
    size = np.sqrt(np.array([max(1, len(r)) for r in rows], np.float32))
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # landmarks: as many of each label, in the order given
    turn = np.zeros(len(labels), int)
    for n in names:
        at = [k for k, x in enumerate(labels) if x == n]
        turn[at] = np.arange(len(at))
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    # one text's presence at a time, looked up under the landmarks' n-grams: no dense matrix of landmarks
    found = np.concatenate([rows[c] for c in chosen])
    counts = np.array([len(rows[c]) for c in chosen])
    owner = np.repeat(np.arange(len(chosen)), counts)
    here = np.zeros(1 << HASH_BITS, bool)
    kernel = np.zeros((len(rows), len(chosen)))
    for k, r in enumerate(rows):
        here[r] = True
        kernel[k] = np.bincount(owner, weights=here[found], minlength=len(chosen)) / (size[chosen] * size[k])
        here[r] = False
    value, vector = np.linalg.eigh(kernel[chosen])
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    z = kernel @ whiten
    mean, middle = z.mean(axis=0), y.mean(axis=0)
    zc = z - mean
    w = np.linalg.solve(zc.T @ zc + ridge * np.eye(zc.shape[1]), zc.T @ (y - middle))
    weights = np.zeros((1 << HASH_BITS, len(names)), np.float32)
    for c, share in zip(chosen, whiten @ w):
        weights[rows[c]] += share / size[c]
    return Model(names, weights, (middle - mean @ w).astype(np.float32))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_label: int, most_rows: int) -> tuple[list[str], list[str]]:
    """Labelled documents picked by a hash of the id: ``per_label`` of each label, fewer where they would be more than ``most_rows``.

    A document is never learnt from where crc32 of its id as text leaves 2 when divided by 4.
    """
    spark, key = docs.sparkSession, column(id_col)
    known = docs.where(column(lang_col).isNotNull() & key.isNotNull() & (F.crc32(key.cast("string")) % 4 != 2))
    narrow = known.select(key.alias("i"), column(lang_col).cast("string").alias("lang")).where(F.col("lang") != UNDETERMINED)
    counts = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each label
    if not counts:
        return [], []
    per_label = max(1, min(per_label, most_rows // len(counts)))
    # a hash below 8 x per_label / n leaves about 8 x per_label rows of a label, whatever the corpus
    shares = spark.createDataFrame([(r.lang, min(1.0, 8 * per_label / r.n)) for r in counts], "lang string, share double")
    chance = F.shiftrightunsigned(F.xxhash64("i"), 1) / F.lit(float(1 << 63))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("i"), "i")
    few = narrow.join(F.broadcast(shares), "lang").where(chance < F.col("share")).withColumn("k", F.row_number().over(by)).where(F.col("k") <= per_label)
    few = few.select("i").distinct()
    taken = (
        known.select(key.alias("i"), column(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
        .where((F.col("lang") != UNDETERMINED) & F.col("text").rlike(r"\p{L}"))
        .join(F.broadcast(few), "i")
        .orderBy(F.xxhash64("i"), "i", "text")
        .limit(2 * per_label * len(counts))
        .collect()
    )
    return [r.text for r in taken], [r.lang for r in taken]


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_label: int = 300,
    landmarks: int = 240,
    ridge: float = 0.1,
    most_rows: int = 19_200,
) -> Model | None:
    """The model; None if no document can be learnt from.

    Every label is learnt, from ``per_label`` documents, or from as many as keep all within ``most_rows``. The
    landmarks are at least ``landmarks``, and two for each label. The weights take half a megabyte for each label.
    """
    texts, labels = training_rows(docs, id_col, text_col, lang_col, per_label, most_rows)
    return fit(texts, labels, max(landmarks, 2 * len(set(labels))), ridge) if texts else None


def _predict(model: Model | None, texts: list[str | None], grams: Grams) -> tuple[list[str], np.ndarray]:
    names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    ask = [k for k, t in enumerate(texts) if has_letter(t)]
    if model and ask:
        s = model.scores([texts[k] for k in ask], grams)
        best = s.argmax(axis=1)
        for k, b, v in zip(ask, best, s.max(axis=1)):
            names[k], score[k] = model.labels[b], min(1.0, max(0.0, (float(v) + 1) / 2))
    return names, score


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1).

    ``und`` with score 0 for null texts, texts without a letter, and all texts if nothing can be
    learnt. held_out: crc32 of the id as text leaves 2 when divided by 4 (false for a null id).
    Ties go to the first label by name. Rows that repeat an id are predicted each on its own. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, **bounds))
    key = column(id_col)
    narrow = docs.select(
        key.alias("doc_id"),
        F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        column(text_col).cast("string").alias("text"),
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    target, arrow = arrow_schema(spark, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

    def run(batches):
        grams = Grams()
        for b in batches:
            if b.num_rows:
                names, score = _predict(sent.value, b.column(2).to_pylist(), grams)
                yield from as_batches(
                    {"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": names, "score": pa.array(score)}, arrow
                )

    return narrow.mapInArrow(run, target)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """``docs`` with all its columns, without the documents whose language is ``und``.

    If nothing can be learnt, only null texts and texts without a letter go. Rows that repeat an id count each on
    its own; an empty table stays empty. Other columns may have any names.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col, **bounds))

    def run(batches):
        grams = Grams()
        for b in batches:
            if b.num_rows:
                texts = b.column(1).to_pylist()
                if sent.value is None:
                    keep = [has_letter(t) for t in texts]
                else:
                    keep = [n != UNDETERMINED for n in _predict(sent.value, texts, grams)[0]]
                yield b.filter(pa.array(keep))
        trim()

    rows = beside_text(docs, text_col)
    return with_text(rows.mapInArrow(run, rows.schema), docs.columns, text_col)
