"""Summaries of small collected figures, as nested dicts, and Markdown reports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.io import generated_at, megabytes
from . import brands, labels, pairs, profile, retrieval, sampling

#: A report shows tables of bounded size only.
MOST_ROWS = 100


def _rows(df: DataFrame) -> list[dict]:
    """The first rows of a table; those summed up here have a row per label, brand or flag."""
    return [r.asDict(recursive=True) for r in df.limit(MOST_ROWS).collect()]


def _one(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def dataset(messages: DataFrame, n_bytes: int | None = None, malformed: int = 0, top: int = 20) -> dict:
    """A raw dump: counts, signals of threads, nulls, volumes and times."""
    return {
        "generated_at": generated_at(),
        "size_mb": None if n_bytes is None else megabytes(n_bytes),
        "malformed_rows": malformed,
        "counts": _one(profile.dataset_profile(messages)),
        "threading": _one(profile.threading_signals(messages)),
        "time_range": _one(profile.time_range(messages)),
        "nulls": _rows(profile.null_counts(messages)),
        "brand_volume": _rows(profile.brand_volume(messages, top)),
    }


def corpus(typed: DataFrame, interactions: DataFrame, names: list[str]) -> dict:
    """The pairs of some brands: outcomes, quality, and what each stage before the index leaves."""
    return {
        "generated_at": generated_at(),
        "brands": _rows(pairs.summary(typed, interactions, names)),
        "unusable": _rows(interactions.where("not is_usable").groupBy("unusable_reason").agg(F.count(F.lit(1)).alias("n")).orderBy("unusable_reason")),
        "stages": _one(retrieval.stage_counts(interactions)),
    }


def brand_selection(scores: DataFrame, missing: DataFrame) -> dict:
    """The scores of candidates, the winner with its reasons, and why the others lost."""
    return {
        "generated_at": generated_at(),
        "candidates": _rows(scores.orderBy(F.desc("selection_score"), "brand")),
        "winner": _one(brands.selection_reasons(scores)),
        "rejected": _rows(brands.rejections(scores).orderBy("brand")),
        "missing": [r["brand"] for r in _rows(missing.orderBy("brand"))],
        "weights": dict(V.WEIGHTS),
    }


def intents(labelled: DataFrame) -> dict:
    """Labels over usable pairs: distribution, rule coverage, ambiguity, words and examples."""
    return {
        "generated_at": generated_at(),
        "total": labelled.count(),
        "ambiguous": labelled.where("is_ambiguous").count(),
        "distribution": {r["intent"]: r["n"] for r in _rows(labels.distribution(labelled))},
        "coverage": {r["intent"]: r["n"] for r in _rows(labels.coverage(labelled))},
        "words": _rows(labels.top(labels.unigrams(labelled), ["token"], 30)),
        "pairs_of_words": _rows(labels.top(labels.bigrams(labelled), ["first", "second"], 30)),
        "examples": _rows(labels.examples(labelled).orderBy("intent", "place")),
    }


def golden(rows: DataFrame, seed: int) -> dict:
    counts = {r["name"]: r["n"] for r in _rows(sampling.golden_summary(rows))}
    part = lambda head: {k.removeprefix(head): n for k, n in counts.items() if k.startswith(head)}
    return {"generated_at": generated_at(), "seed": seed, "total": rows.count(), "by_intent": part("intent:"), "by_flag": part("flag:"), "status": "pending"}


def index(built: retrieval.TfidfIndex, stages: dict | None = None) -> dict:
    return {"generated_at": generated_at(), "settings": built.manifest, "counts": built.counts(), "stages": stages or {}}


def evaluation(retrieved: DataFrame, answered: DataFrame, mode: str = "mock") -> dict:
    """retrieved: of ``retrieval.metrics``; answered: of ``agent.evaluate``."""
    return {"generated_at": generated_at(), "mode": mode, "retrieval": _one(retrieved), "agent": _one(answered)}


def markdown(title: str, summary: dict) -> str:
    """A summary as Markdown: figures as a list, dicts and lists of dicts as tables, each under a heading of its own."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    name = lambda k: str(k).replace("_", " ")
    row = lambda xs: "| " + " | ".join(map(cell, xs)) + " |"
    lines = [f"# {title}", ""]
    lines += [f"- {name(k)}: {cell(v)}" for k, v in summary.items() if not isinstance(v, (dict, list))]
    for k, v in summary.items():
        if isinstance(v, dict):
            lines += ["", f"## {name(k)}", "", row(["", "value"]), row(["-", "-"])] + [row([name(a), b]) for a, b in v.items()]
        elif isinstance(v, list):
            lines += ["", f"## {name(k)}", ""]
            if v and isinstance(v[0], dict):
                lines += [row(map(name, v[0])), row(["-"] * len(v[0]))] + [row(x.values()) for x in v]
            else:
                lines += [f"- {cell(x)}" for x in v] or ["none"]
    return "\n".join(lines) + "\n"
