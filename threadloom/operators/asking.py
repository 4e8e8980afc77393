"""Model calls: each distinct prompt once, in waves whose answers are kept in a table under the prompts' hashes."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.staging import Scratch
from ..sources.io import exists

#: Prompts of a wave, of a task, and calls that a task makes at a time.
WAVE, TASK, WIDTH = 4096, 64, 8


def prompt_key(model: str, system: str, user: str) -> Column:
    """The address of an answer; null where there is no prompt. system, user: columns."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), F.col(system), F.lit("\0"), F.col(user)), 256)


def answers(prompts: DataFrame, client, system: str, user: str, store: str | None = None, wave: int = WAVE, width: int = WIDTH) -> DataFrame:
    """key, answer, error: of every distinct prompt; error is "llm_error" where the client raised, and the answer is null there.

    Prompts that ``store``, a folder, has an answer to aren't asked. The others are asked in waves of about ``wave``, each written to the
    store when it is done: what fails costs its wave at most, and a later call goes on from there; what reads the answers never asks.
    Failed calls are asked again by a later call only. Without a store the answers last as long as the scratch tables do. Null prompts have no row.
    """
    spark = prompts.sparkSession
    ship(spark)
    scratch = Scratch(spark, "answers")
    path = f"{store or scratch.root}/answers"
    key = prompt_key(client.model_name, system, user)
    asked = prompts.select(key.alias("key"), F.col(system).alias("system"), F.col(user).alias("user")).where("key is not null")
    asked = scratch.write(asked.dropDuplicates(["key"]), "asked")
    schema = "key string, answer string, error string"
    known = lambda: spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    todo = scratch.write(asked.join(known().where("error is null"), "key", "left_anti"), "todo")
    count = todo.count()
    waves = -(-count // wave)

    def run(frames) -> Iterator:
        def ask(pair: tuple[str, str]) -> tuple[str | None, str | None]:
            try:
                return client.generate(*pair) or "", None
            except Exception:  # whatever a client raises is an answer that failed
                return None, "llm_error"

        with ThreadPoolExecutor(width) as pool:
            for f in frames:
                got = list(pool.map(ask, zip(f["system"], f["user"])))
                f = f[["key"]].copy()
                f["answer"], f["error"] = [a for a, _ in got], [e for _, e in got]
                yield f

    failed = spark.createDataFrame([], schema)
    for k in range(waves):
        mine = todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == k).repartition(max(1, -(-min(wave, count) // TASK)), "key")
        told = scratch.write(mine.mapInPandas(run, schema), "told")
        told.where("error is null").write.mode("append").parquet(path)
        failed = failed.unionByName(told.where("error is not null"))
    good = known().where("error is null").dropDuplicates(["key"]).join(asked.select("key"), "key", "left_semi")
    return good.unionByName(failed)
