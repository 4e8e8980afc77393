"""spark-submit entry: ``python -m threadloom.cli COMMAND ...``. Exit code 2 means bad input or configuration."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import values as V
from .operators import agent, brands, labels, pairs, reports, retrieval, sampling, threads
from .operators.typed import typed
from .plans.staging import Scratch
from .sources import io


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple, **options) -> None:
        c = sub.add_parser(name, help=options.get("help"))
        for flag, kw in arguments:
            c.add_argument(flag, **kw)
        if name not in ("search", "agent"):
            c.add_argument("--summary", help="where to write the figures as JSON")
            c.add_argument("--report", help="where to write them as Markdown")

    data, out = ("--dataset", {"required": True}), ("--output", {"required": True})
    names = ("--brands", {"required": True, "help": "comma-separated handles"})
    index, top_k = ("--index", {"required": True}), ("--top-k", {"type": int, "default": V.TOP_K})
    model = (
        ("--mock", {"action": "store_true", "help": "never call a model"}), ("--deterministic-only", {"action": "store_true", "help": "no model for labels"}),
        ("--settings", {"help": "a JSON file with model and url; the key comes from LLM_API_KEY"}),
    )
    add("profile", data, ("--top", {"type": int, "default": 20}), help="counts, nulls, volumes and times of a dump")
    add("score-brands", data, out, names, help="metrics, scores and reasons of candidate brands")
    add("build-pairs", data, out, names, help="customer-to-brand pairs with quality flags")
    add("label", ("--pairs", {"required": True}), out, help="label distribution, words and examples")
    add("golden", ("--pairs", {"required": True}), out, ("--seed", {"type": int, "default": 42}), help="the stratified golden set")
    add("index", ("--pairs", {"required": True}), out, ("--min-df", {"type": int, "default": V.MIN_DF}), ("--max-df", {"type": float, "default": V.MAX_DF}),
        ("--ngram-max", {"type": int, "default": V.NGRAMS}), ("--grow", {"action": "store_true", "help": "add what the index there lacks"}), help="the TF-IDF index")
    add("search", index, ("--query", {"required": True}), top_k, help="one query against an index")
    add("evaluate", index, ("--golden", {"required": True}), top_k, *model, ("--output", {"help": "where to write the row of each golden message"}), help="retrieval and agent metrics on a golden set")
    add("agent", index, ("--message", {}), ("--interactive", {"action": "store_true"}), ("--json", {"action": "store_true"}), top_k, *model, help="answer messages")
    return p


def _show(row: dict, as_json: bool) -> None:
    print(json.dumps(row, ensure_ascii=False, indent=2, default=str) if as_json else "\n".join(f"{k}: {v}" for k, v in row.items()))


def _labelled(spark: SparkSession, path: str):
    return labels.label(io.require(io.read_table(spark, path), ["customer_text", "is_usable"], "pairs").withColumn("clean", X.clean("customer_text")))


def _agent(found: retrieval.TfidfIndex, a: argparse.Namespace) -> agent.SupportAgent:
    return agent.build_agent(found, io.load_settings(a.settings), a.mock, a.deterministic_only, a.top_k)


def _sum_up(spark: SparkSession, a: argparse.Namespace, title: str, make) -> None:
    """Print the summary that ``make`` returns, and write it where the flags say."""
    summary = make()
    _show(summary, True)
    if a.summary:
        io.write_json(spark, summary, a.summary)
    if a.report:
        io.write_report(spark, reports.markdown(title, summary), a.report)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "profile":
        m, bad = io.read_messages(spark, a.dataset)
        _sum_up(spark, a, "Dataset", lambda: reports.dataset(m, io.size_in_bytes(spark, a.dataset), bad.count(), a.top))
    elif a.command in ("score-brands", "build-pairs"):
        t, names = typed(io.read_messages(spark, a.dataset)[0]), a.brands.split(",")
        n = threads.nodes(t)
        roots = threads.roots(n)
        sizes = threads.sizes(n, roots)
        if a.command == "build-pairs":
            _show(io.write_table(pairs.interactions(t, names, roots, sizes), a.output), True)
            _sum_up(spark, a, "Pairs", lambda: reports.corpus(t, io.read_table(spark, f"{a.output}.parquet"), names))
        else:
            s = brands.scores(brands.reply_metrics(t, names), brands.customer_metrics(t, names), brands.conversation_metrics(t, names, roots, sizes))
            io.write_table(s, a.output)
            _sum_up(spark, a, "Brands", lambda: reports.brand_selection(io.read_table(spark, f"{a.output}.parquet"), brands.missing(t, names)))
    elif a.command == "label":
        p = _labelled(spark, a.pairs).where("is_usable")
        summary = reports.intents(p)
        io.write_json(spark, summary, a.output)
        _sum_up(spark, a, "Labels", lambda: summary)
    elif a.command == "golden":
        g = sampling.golden(sampling.pool(_labelled(spark, a.pairs)), a.seed)
        _show(io.write_table(g, a.output), True)
        _sum_up(spark, a, "Golden set", lambda: reports.golden(io.read_table(spark, f"{a.output}.parquet"), a.seed))
    elif a.command == "index":
        p = _labelled(spark, a.pairs)
        p = p if "brand" in p.columns else p.withColumn("brand", F.lit(""))
        audit = retrieval.Audit()
        rows = Scratch(spark, "index").write(retrieval.index_rows(p, audit), "rows")
        stages = audit.counts()
        if a.grow:
            built = retrieval.TfidfIndex.load(spark, a.output)
            built = built.add(retrieval.new_rows(rows, built))
        else:
            built = retrieval.TfidfIndex.fit(
                rows, "interaction_id", "customer_normalized_text", a.min_df, a.max_df, a.ngram_max, "brand_tweet_id",
                retrieval.RULES | {"stages": stages},
            )
        built.save(a.output)
        _sum_up(spark, a, "Index", lambda: reports.index(built, stages))
    else:
        found = retrieval.TfidfIndex.load(spark, a.index)
        if a.command == "search":
            for r in found.retrieve(a.query, a.top_k):
                _show(r, False)
        elif a.command == "evaluate":
            g, bot = io.read_table(spark, a.golden), _agent(found, a)
            results = Scratch(spark, "evaluate").write(bot.transform(g.select("golden_id", "customer_text"), "golden_id", "customer_text"), "results")
            if a.output:
                io.write_table(results.withColumn("workflow_steps", F.array_join("workflow_steps", ",")), a.output)
            rates = retrieval.metrics(retrieval.evaluate(found, g, max(a.top_k, 10)))
            _sum_up(spark, a, "Evaluation", lambda: reports.evaluation(rates, agent.evaluate(results, g, "golden_id"), "mock" if a.mock else "live"))
        else:
            bot = _agent(found, a)
            if a.message is not None:
                _show(bot.handle(a.message), a.json)
            while a.interactive:
                try:
                    line = input("> ").strip()
                except EOFError:
                    break
                if line in ("", "quit", "exit"):
                    break
                _show(bot.handle(line), a.json)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a)
    except (FileNotFoundError, io.MissingColumns, agent.InvalidMessage, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
