"""Intent rules, labels, confidence and escalation as Column expressions over cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import contains_any


def hits(cleaned: Column) -> dict[str, Column]:
    return {name: cleaned.rlike(rule) for name, rule in V.RULES.items()}


def matched(cleaned: Column) -> Column:
    """Labels whose rule matches, in taxonomy order."""
    return F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in hits(cleaned).items())))


def first_of(found: Column, order: list[str]) -> Column:
    """The first label of ``order`` in the array, else the fallback."""
    return F.coalesce(*(F.when(F.array_contains(found, n), F.lit(n)) for n in order if n != V.OTHER), F.lit(V.OTHER))


def label_rule(found: Column, label: Column) -> Column:
    others = F.array_join(F.array_remove(found, label), ", ")
    head = F.concat(F.lit("keyword rule '"), label, F.lit("'"))
    return (
        F.when(F.size(found) == 0, F.lit("no keyword rule matched"))
        .when(F.size(found) >= 2, F.concat(head, F.lit("; also matched "), others))
        .otherwise(head)
    )


def by_label(label: Column, make, otherwise: Column) -> Column:
    """A CASE over the labels that have a rule."""
    out = None
    for n in V.RULES:
        out = F.when(label == n, make(n)) if out is None else out.when(label == n, make(n))
    return out.otherwise(otherwise)


def confidence_points(cleaned: Column, found: Column, label: Column) -> Column:
    """Confidence in hundredths, exact integers."""
    n = F.greatest(by_label(label, lambda k: F.regexp_count(cleaned, F.lit(V.RULES[k])), F.lit(0)), F.lit(1))
    base = 72 + 8 * F.least(n - 1, F.lit(2))
    base = F.when(strong(cleaned, label), F.greatest(base, F.lit(88))).otherwise(base)
    base = base - 6 * F.least(F.size(found) - 1, F.lit(3))
    return F.when(F.size(found) == 0, F.lit(30)).otherwise(F.least(F.greatest(base, F.lit(35)), F.lit(98)))


def strong(cleaned: Column, label: Column) -> Column:
    return by_label(label, lambda k: contains_any(cleaned, V.STRONG_PHRASES[k]), F.lit(False))


def evidence(cleaned: Column, found: Column, label: Column) -> Column:
    others = F.array_join(F.array_remove(found, label), ", ")
    full = F.concat_ws(
        "; ",
        F.concat(F.lit("matched taxonomy rule for '"), label, F.lit("'")),
        F.when(strong(cleaned, label), F.lit("strong phrase match")),
        F.when(F.size(found) >= 2, F.concat(F.lit("also matched: "), others)),
    )
    return F.when(F.size(found) == 0, F.lit("no keyword rule matched")).otherwise(full)


def band(points: Column) -> Column:
    return F.when(points >= V.HIGH, "high").when(points >= V.MEDIUM, "medium").otherwise("low")


def escalation(cleaned: Column, label: Column, points: Column) -> Column:
    """The reason's key; the first rule that holds. "none" means that no review is recommended."""
    return (
        F.when(contains_any(cleaned, V.HUMAN_REQUEST), "human")
        .when(contains_any(cleaned, V.LEGAL), "legal")
        .when((label == "refund_or_payment") | contains_any(cleaned, V.PAYMENT), "payment")
        .when((label == "account_or_technical_issue") & contains_any(cleaned, V.ACCOUNT), "account")
        .when(contains_any(cleaned, V.UNRESOLVED), "unresolved")
        .when(label.isin(V.LIVE_ORDER), "live")
        .when((label == V.OTHER) | (points < V.MEDIUM), "unclear")
        .otherwise("none")
    )


def reason_text(key: Column) -> Column:
    out = None
    for k, t in V.REASONS.items():
        out = F.when(key == k, t) if out is None else out.when(key == k, t)
    return out
