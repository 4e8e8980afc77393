"""Personal data: high-recall generators, gradient-boosted trees on format and context, calibrated thresholds.

Generators propose overlapping spans: the four base kinds, and looser forms that they miss
(digits inside a longer run, national telephone numbers, spelled-out addresses, account
numbers). Each candidate has binary features of its format and context. The trees learn from
them where candidates pass the strict check of their kind (Luhn, mod 97, numbering rules), which
itself is no feature. Where most candidates pass they are genuine; where as many pass as would by
chance they are look-alikes, and those that pass are not taken. As all features are binary, the
corpus is summed up exactly by a table of feature vectors with their counts, whose size doesn't
depend on the corpus; the driver boosts depth-two trees on that table. From the passes and
failures of a fold the trees haven't seen and the chance of a look-alike to pass follows the
precision above each score, and from that each kind's threshold. A candidate that fails its check
is never taken: no genuine one does. Scoring is a sum of CASE expressions: no Python runs on the executors.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, text_of
from .spans import apart, found, joined, let, scan

# The base kinds' patterns. The possessive forms and the starts that only follow
# another character class match the same spans in linear time and without recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser generators.
DIGITS = r"(?:(?<![0-9])|\G)[0-9]{13,19}+(?![0-9])"
GROUPED = r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])"
NATIONAL = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Z0-9])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{2,63}+ ?[\[(]dot[\])] ?[A-Za-z]{2,12}"
GENERATORS = [("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("digits", DIGITS), ("grouped", GROUPED), ("national", NATIONAL),
              ("social", SOCIAL), ("iban", IBAN), ("spelled", SPELLED)]
KINDS = [name for name, _ in GENERATORS]
BASE = 4
#: The chance that a look-alike of a loose kind passes the strict check. Spelled addresses all pass: there the pattern alone decides.
CHANCE = {"digits": 1 / 10, "grouped": 1 / 10, "national": 0.8 * 0.8, "social": 0.898 * 0.99 * 0.9999, "iban": 1 / 97}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    double = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.transform(values, lambda v, i: F.when(i % 2 == 1, double(v)).otherwise(v)), F.lit(0), lambda s, v: s + v)
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """The check digits of an account number: letters count as 10 to 35, remainder 1."""
    turned = F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))
    step = lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def octets(m: Column) -> Column:
    bare = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def strict(kind: int, m: Column) -> Column:
    """The check of a kind; for base kinds the contract's."""
    d = _digits(m)
    n = F.length(d)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: octets(m),
        "card": lambda: n.between(16, 19) & luhn(d),
        "phone": lambda: n.between(8, 15),
        "digits": lambda: luhn(d),
        "grouped": lambda: luhn(d),
        "national": lambda: d.rlike("^[2-9][0-9]{2}[2-9]"),
        "social": lambda: ~d.rlike("^(000|666|9)|^...00|0000$"),
        "iban": lambda: mod97(m),
        "spelled": lambda: F.lit(True),
    }[KINDS[kind]]()


#: Binary features of a candidate x (struct of kind, start, end, m, pre, post) by name; none tells whether it passes.
FEATURES = {
    **{f"is_{name}": (lambda x, k=k: x["kind"] == k) for k, name in enumerate(KINDS)},
    "separated": lambda x: x["m"].rlike(r"[ .()-]"),
    "one_digit_repeated": lambda x: F.length(F.replace(_digits(x["m"]), F.substring(_digits(x["m"]), 1, 1), F.lit(""))) == 0,
    "card_prefix": lambda x: x["m"].rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6)"),
    "sixteen": lambda x: F.length(_digits(x["m"])) == 16,
    "after_word": lambda x: x["pre"].rlike(r"[A-Za-z0-9_/=-]$"),
    "before_word": lambda x: x["post"].rlike(r"[A-Za-z0-9_/=-]"),
    "cue_contact": lambda x: x["pre"].rlike(r"(?i)(mail|phone|tel|call|fax|mobile|contact|reach)"),
    "cue_account": lambda x: x["pre"].rlike(r"(?i)(card|visa|account|iban|bank|ssn|social|payment)"),
    "cue_id": lambda x: x["pre"].rlike(r"(?i)(order|invoice|ref|serial|isbn|version|id)[^a-z]{0,3}$"),
}
NAMES = list(FEATURES)


def scan_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, candidates: (kind, start, end, ok, f), f a bit mask of the features."""
    text = text_of(text_col)
    digit = text.rlike("[0-9]")
    quick = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "spelled": text.rlike(r"[\[(]dot[\])]")}

    def candidate(kind: int):
        def of(x: Column) -> Column:
            y = {**{k: x[k] for k in ("start", "end", "m", "pre", "post")}, "kind": F.lit(kind)}
            bits = None
            for k, f in enumerate(FEATURES.values()):
                bit = F.when(f(y), 1 << k).otherwise(0)
                bits = bit if bits is None else bits + bit
            return F.struct(y["kind"].alias("kind"), y["start"].alias("start"), y["end"].alias("end"), strict(kind, x["m"]).alias("ok"), bits.alias("f"))

        return of

    parts = [F.transform(found(text, p, 24, quick.get(name, digit)), candidate(k)) for k, (name, p) in enumerate(GENERATORS)]
    return docs.select(column(id_col).alias("doc_id"), F.concat(*parts).alias("candidates"))


class Boosted:
    """Depth-two trees on binary features, boosted for logistic loss on a table of weighted feature vectors."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> "Boosted":
        """x: 0/1 rows; positive, negative: how often each row has either label."""
        n = positive + negative
        self.base = float(np.log((positive.sum() + 1) / (negative.sum() + 1)))
        score = np.full(len(x), self.base)

        def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
            a, b, xs = g[rows], h[rows], x[rows]
            g1, h1 = a @ xs, b @ xs
            g0, h0 = a.sum() - g1, b.sum() - h1
            gain = g1**2 / (h1 + self.ridge) + g0**2 / (h0 + self.ridge)
            return float(gain.max()), int(gain.argmax())

        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = positive - n * p, n * p * (1 - p)
            every = np.ones(len(x), bool)
            _, root = best(every, g, h)
            leaves = []
            for side in (0, 1):
                rows = x[:, root] == side
                at = best(rows, g, h)[1] if rows.any() else root
                for low in (0, 1):
                    here = rows & (x[:, at] == low)
                    leaves.append((at, self.rate * float(g[here].sum() / (h[here].sum() + self.ridge))))
                    score[here] += leaves[-1][1]
            self.trees.append((root, leaves))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for root, leaves in self.trees:
            for side in (0, 1):
                at = leaves[2 * side][0]
                out += np.where(x[:, root] == side, np.where(x[:, at] == 1, leaves[2 * side + 1][1], leaves[2 * side][1]), 0)
        return out

    def expression(self, f: Column) -> Column:
        """The score as SQL; f: the bit mask."""
        on = lambda k: f.bitwiseAND(F.lit(1 << k)) != 0
        out = F.lit(self.base)
        for root, ((a, a0), (_, a1), (b, b0), (_, b1)) in self.trees:
            out = out + F.when(on(root), F.when(on(b), b1).otherwise(b0)).otherwise(F.when(on(a), a1).otherwise(a0))
        return out


def calibrated(
    kinds: np.ndarray, score: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float
) -> list[tuple[float, float]]:
    """For each kind the lowest score from which on the precision holds, infinity if there is none, and that precision.

    Of p that pass and n that fail, n c / (1 - c) passed by chance, c being the kind's chance; the others are genuine.
    The limit lies midway to the next lower score, and at minus infinity if there is none.
    """
    out = []
    for k, name in enumerate(KINDS):
        mine = kinds == k
        order = np.argsort(-score[mine], kind="stable")
        s, p, n = score[mine][order], positive[mine][order].cumsum(), negative[mine][order].cumsum()
        last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores stand or fall together
        lucky = n * CHANCE.get(name, 0.0) / (1 - CHANCE.get(name, 0.0))
        good = np.flatnonzero(last & (p - lucky >= precision * p) & (p > 0))
        if not len(good):
            out.append((float("inf"), 0.0))
        else:
            g = good[-1]
            out.append((float("-inf") if g == len(s) - 1 else float((s[g] + s[g + 1]) / 2), float((p[g] - lucky[g]) / p[g])))
    return out


def train(scanned: DataFrame, precision: float) -> tuple[Boosted, list[tuple[float, float]]]:
    """The trees, and each kind's threshold and precision. The collected table has a row per feature vector that occurs, not per document."""
    rows = (
        scanned.select(F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold"), F.explode("candidates").alias("x"))
        .groupBy("x.kind", "x.f", (F.col("fold") == 0).alias("held"))
        .agg(F.count_if(F.col("x.ok")).alias("p"), F.count_if(~F.col("x.ok")).alias("n"))
        .orderBy("kind", "f", "held")
        .collect()
    )
    if not rows:
        return Boosted(0), [(float("inf"), 0.0)] * len(KINDS)
    x = np.array([[r.f >> k & 1 for k in range(len(NAMES))] for r in rows], float)
    p, n = (np.array([r[name] for r in rows], float) for name in ("p", "n"))
    held, kinds = np.array([r.held for r in rows]), np.array([r.kind for r in rows])
    fit = ~held if (~held).any() and held.any() else np.ones(len(rows), bool)
    model = Boosted().fit(x[fit], p[fit], n[fit])
    score = np.round(model.scores(x), 9)
    test = held if held.any() else np.ones(len(rows), bool)
    # a kind that the held-out fold lacks is calibrated on all of it
    own = calibrated(kinds[test], score[test], p[test], n[test], precision)
    every = calibrated(kinds, score, p, n, precision)
    return model, [e if not (kinds[test] == k).any() else o for k, (o, e) in enumerate(zip(own, every))]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """One row per input row: doc_id, base and spans, arrays of (kind, start, end) in the order of kind, then start.

    kind is a number, a place in KINDS. base holds what the four base kinds find; spans also holds
    candidates of the looser kinds that pass their check, have a score of format and context above their
    kind's threshold (at least ``precision`` of those that pass are held to be genuine) and overlap no base
    span and no candidate of a kind whose precision is higher (of equal ones the first in KINDS). Places are
    code points, end exclusive. Null text counts as empty; rows that repeat an id are scanned each on its
    own. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.write(scan_candidates(docs, id_col, text_col), "scanned")
    model, limits = train(scanned, precision)
    limit = F.array(*(F.lit(x) for x, _ in limits))
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("candidates", lambda x: (x["kind"] < BASE) & x["ok"]), place)
    good = lambda x: F.round(model.expression(x["f"]), 9) >= F.element_at(limit, x["kind"] + 1)
    loose = F.transform(F.filter("candidates", lambda x: (x["kind"] >= BASE) & x["ok"] & good(x)), place)

    out = scanned.select("doc_id", base.alias("base"), loose.alias("loose")).withColumn("spans", F.col("base"))
    kinds = [k for k in range(BASE, len(KINDS)) if limits[k][0] < float("inf")]
    for kind in sorted(kinds, key=lambda k: (-limits[k][1], k)):
        mine = F.filter("loose", partial(_is, kind))
        out = out.withColumn("spans", F.when(F.exists("loose", partial(_is, kind)), F.concat("spans", apart(mine, F.col("spans")))).otherwise(F.col("spans")))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort("spans").alias("spans"))


def _is(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def redact(docs_text: Column, spans: Column) -> Column:
    """The text with spans replaced by their kind in brackets; spans that overlap go as one, under the name of the first."""
    name = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"])))

    def put(y: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            before = F.element_at(y["before"], k + 1)
            kept = F.array_join(F.slice(y["chars"], before + 1, x["start"] - before), "")
            return F.when(x["start"] >= before, F.concat(kept, F.lit("["), F.upper(F.element_at(name, x["kind"] + 1)), F.lit("]"))).otherwise(F.lit(""))

        rest = F.array_join(F.slice(y["chars"], F.array_max(F.transform(y["order"], lambda x: x["end"])) + 1, F.size(y["chars"])), "")
        return F.concat(F.array_join(F.transform(y["order"], piece), ""), rest)

    with_ends = lambda o: F.struct(
        F.split(docs_text, "").alias("chars"), o.alias("order"), scan(F.transform(o, lambda x: x["end"]), 0, F.greatest).alias("before")
    )
    return F.when(F.size(spans) == 0, docs_text).otherwise(let(let(order, with_ends), put))


def pii_digest(pii: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return pii.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])),
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
    )
