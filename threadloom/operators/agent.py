"""The support agent as one batch job: validation, labels, escalation, retrieval, prompt, generation."""

from __future__ import annotations

import json
import re
import urllib.request
import warnings
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import intents as I
from ..functions import text as X
from ..functions import values as V
from ..plans.staging import Scratch
from ..sources.io import Settings
from . import asking, labels
from .retrieval import TfidfIndex

WARNING = "The examples are past conversations, not current policy. Use them as context only and never as a rule."
SYSTEM = (
    "You write short, polite replies to a shop's customers. Answer the question and name a next step. Do not invent policies, prices, dates or the "
    "state of an order; do not say that an account was checked or an action was taken; do not repeat personal data from the examples; do not ask "
    f"for passwords, codes or card numbers. If you cannot tell, ask or point to the official channel. {WARNING} Return the reply only."
)
REQUIREMENTS = ["Reply to the message above.", "Stay polite and brief, with a next step where there is one.", "Invent no facts and claim no actions.",
                "Ask only for what is needed.", "Return the reply only."]
FALLBACK = "Sorry, we can't give a full answer just now. Please try again later or contact customer support through the official channel."


class Client(Protocol):
    """A language model: returns a text or raises."""

    model_name: str

    def generate(self, system: str, user: str) -> str: ...


class MockClient:
    model_name = "mock"

    def generate(self, system: str, user: str) -> str:
        return V.MOCK_REPLY


class RetrievalError(RuntimeError):
    """A retriever or a prompt's making failed, and its message can go on without examples."""


#: What an agent goes on without; faults of Spark itself, such as a lost cluster, aren't among them.
FORGIVEN = (RetrievalError, OSError)


class ModelError(RuntimeError):
    """A language model gave no usable answer. Its text holds no key."""


class LiveClient:
    """A model behind an HTTP endpoint that takes chat messages as JSON; bounded in length, time and tries. The key is kept out of its text."""

    def __init__(self, url: str, model_name: str, api_key: str, temperature: float = V.TEMPERATURE, max_tokens: int = V.MAX_TOKENS,
                 timeout: float = V.TIMEOUT_SECONDS, retries: int = V.RETRIES):
        self.url, self.model_name, self._key = url, model_name, api_key
        self.temperature, self.max_tokens, self.timeout, self.retries = temperature, max_tokens, timeout, retries

    def __repr__(self) -> str:
        return f"LiveClient({self.model_name})"

    def request(self, system: str, user: str) -> urllib.request.Request:
        body = {
            "model": self.model_name, "temperature": self.temperature, "max_tokens": self.max_tokens,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
        }
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self._key}"}
        return urllib.request.Request(self.url, json.dumps(body).encode(), head, method="POST")

    def generate(self, system: str, user: str) -> str:
        fault = "no try"
        for _ in range(1 + self.retries):
            try:
                with urllib.request.urlopen(self.request(system, user), timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"] or ""
            except (OSError, ValueError, LookupError, TypeError) as e:
                fault = type(e).__name__
        raise ModelError(f"the model failed ({fault})")


class InvalidMessage(ValueError):
    """A message that can't be answered."""


def validation(c: str) -> Column:
    """Why a message is invalid: "missing", "blank", "too_long"; null if it is valid."""
    t = F.regexp_replace(F.col(c), f"^{X.SPACE}+|{X.SPACE}+$", "")
    return F.when(F.col(c).isNull(), "missing").when(t == "", "blank").when(F.length(t) > V.MAX_MESSAGE, "too_long")


def prompts(messages: DataFrame, key: str, examples: DataFrame, most: int = V.TOP_K) -> DataFrame:
    """key, system_prompt, user_prompt, retrieved_count, top_similarity.

    messages: key, message. examples: key, rank, score, customer_redacted_text, customer_text,
    brand_redacted_text, brand_text; no id or handle of theirs enters the prompt.
    """
    either = lambda a, b: F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a)).otherwise(F.col(b))
    shown = examples.where(F.col("rank") <= most).select(
        key, F.struct("rank", "score", X.example_text(either("customer_redacted_text", "customer_text")).alias("c"),
                      X.example_text(either("brand_redacted_text", "brand_text")).alias("b")).alias("x"),
    )
    gathered = shown.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    line = lambda x, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\n- Customer asked: "), x["c"], F.lit("\n- The shop replied: "), x["b"]
    )
    body = F.when(F.size("xs") > 0, F.array_join(F.transform("xs", line), "\n")).otherwise("- None found. Answer with care and invent no details.")
    user = F.concat_ws(
        "\n", F.lit("CUSTOMER MESSAGE:"), X.capped(F.col("message"), V.MAX_PROMPT_MESSAGE, V.MAX_PROMPT_MESSAGE), F.lit(""),
        F.lit("RETRIEVED HISTORICAL EXAMPLES:"), F.lit(WARNING), body, F.lit(""), F.lit("RESPONSE REQUIREMENTS:"),
        F.lit("\n".join(f"- {r}" for r in REQUIREMENTS)),
    )
    joined = messages.join(gathered, key, "left").withColumn("xs", F.coalesce("xs", F.array().cast(gathered.schema["xs"].dataType)))
    return joined.select(
        key, F.lit(SYSTEM).alias("system_prompt"), user.alias("user_prompt"), F.size("xs").cast("long").alias("retrieved_count"),
        F.when(F.size("xs") > 0, F.element_at("xs", 1)["score"]).alias("top_similarity"),
    )


def generate(prompted: DataFrame, client: Client | None = None, store: str | None = None) -> DataFrame:
    """Adds generated_response, generation_success, used_fallback, error_type, model_name.

    Without a client the mock reply, as a constant. A client runs at once, for each distinct prompt (``asking.answers``, with ``store``), in the
    tasks; its errors and blank answers become the fallback text, and so does a prompt that is null. Speculation should be off.
    """
    if client is None or isinstance(client, MockClient):
        ok = F.col("user_prompt").isNotNull()
        return prompted.select(
            "*", F.when(ok, V.MOCK_REPLY).otherwise(FALLBACK).alias("generated_response"), ok.alias("generation_success"), (~ok).alias("used_fallback"),
            F.when(~ok, "prompt_error").alias("error_type"), F.lit("mock").alias("model_name"),
        )

    prompted = Scratch(prompted.sparkSession, "prompts").write(prompted, "prompts")
    key = asking.prompt_key(client.model_name, "system_prompt", "user_prompt")
    told = asking.answers(prompted, client, "system_prompt", "user_prompt", store)
    said = F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), f"^{X.SPACE}+|{X.SPACE}+$", ""))
    error = F.when(F.col("user_prompt").isNull(), "prompt_error").otherwise(F.coalesce("error", F.when(said == "", "empty_response")))
    out = prompted.withColumn("_key", key).join(told.withColumnRenamed("key", "_key"), "_key", "left")
    return out.withColumn("_error", error).select(
        *prompted.columns, F.when(F.col("_error").isNull(), said).otherwise(FALLBACK).alias("generated_response"), F.col("_error").isNull().alias("generation_success"),
        F.col("_error").isNotNull().alias("used_fallback"), F.col("_error").alias("error_type"), F.lit(client.model_name).alias("model_name"),
    )


def parse_label(raw: str | None) -> tuple[str, float, str] | None:
    """(intent, confidence, evidence) from a model's answer; None if anything about it is wrong."""
    found = re.search(r"\{.*\}", raw or "", re.DOTALL)
    try:
        data = json.loads(found[0])
        confidence = float(data["confidence"])
        if data["intent"] not in V.TAXONOMY_ORDER or not 0.0 <= confidence <= 1.0:
            return None
        return data["intent"], round(confidence, 2), str(data.get("evidence", ""))[:200] or "classified by the model"
    except (TypeError, KeyError, ValueError, AttributeError):
        return None


def parsed(raw: Column) -> Column:
    """struct(intent, confidence, evidence) of ``parse_label``, natively; null if anything about the answer is wrong."""
    x = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "intent string, confidence string, evidence string")
    sure = x["confidence"].try_cast("double")
    told = F.substring(F.coalesce(x["evidence"], F.lit("")), 1, 200)
    fields = F.struct(
        x["intent"].alias("intent"), F.round(sure, 2).alias("confidence"), F.when(told == "", "classified by the model").otherwise(told).alias("evidence")
    )
    return F.when(x["intent"].isin(V.TAXONOMY_ORDER) & sure.between(0.0, 1.0), fields)


def ask_model(assessed: DataFrame, client: Client, text: str = "message", store: str | None = None) -> DataFrame:
    """Replaces agent_intent, confidence, points and evidence of low-confidence rows by the client's answer where it is valid; adds method.

    Only the distinct texts of low confidence reach Python, each once (``asking.answers``, with ``store``); answers are parsed natively.
    """
    system = "Label the message with one of: " + ", ".join(V.TAXONOMY_ORDER) + '. Answer with JSON only: {"intent": ..., "confidence": 0 to 1, "evidence": ...}.'

    sure = assessed.where(F.col("points") >= V.MEDIUM).withColumn("method", F.lit("deterministic"))
    unsure = assessed.where(~(F.col("points") >= V.MEDIUM))
    unsure = Scratch(assessed.sparkSession, "unsure").write(unsure.withColumn("_system", F.lit(system)), "unsure")
    key = asking.prompt_key(client.model_name, "_system", text)
    told = asking.answers(unsure, client, "_system", text, store).select(F.col("key").alias("_key"), parsed(F.col("answer")).alias("_got"))
    told = unsure.withColumn("_key", key).join(told, "_key", "left")
    got = F.col("_got")
    told = told.select(
        *(c for c in assessed.columns if c not in ("agent_intent", "confidence", "evidence", "points")),
        F.coalesce(got["intent"], "agent_intent").alias("agent_intent"), F.coalesce(got["confidence"], "confidence").alias("confidence"),
        F.coalesce(got["evidence"], "evidence").alias("evidence"), F.coalesce(F.round(got["confidence"] * 100).cast("long"), "points").alias("points"),
        F.when(got.isNotNull(), "model").otherwise("deterministic").alias("method"),
    )
    return sure.unionByName(told)


Retriever = Callable[[DataFrame, str, str, int], DataFrame]
Classifier = Callable[[DataFrame], DataFrame]


def retriever_of(index: TfidfIndex) -> Retriever:
    """messages, key, text, top_k -> key, rank, score and the examples' texts."""
    return lambda m, key, text, top_k: index.search(m, key, text, top_k).join(index.metadata, index.manifest["key"])


def classify(messages: DataFrame) -> DataFrame:
    """The rules' classifier: adds what ``labels.assess`` does to messages with a column ``message``."""
    return labels.assess(labels.label(messages.withColumn("clean", X.clean("message"))))


class SupportAgent:
    """messages -> the 16 result fields, for all messages in one job.

    ``index`` may be None where a ``retriever`` is given. Retriever, classifier and client can be replaced; a
    retriever that fails with one of FORGIVEN leaves the prompts without examples, and a prompt that does becomes the fallback text; a
    warning tells. Any other fault ends the job. ``answers`` is a folder that keeps a model's answers from call to call.
    """

    def __init__(self, index: TfidfIndex | None, client: Client | None = None, deterministic_only: bool = True, top_k: int = V.TOP_K,
                 retriever: Retriever | None = None, classifier: Classifier = classify, answers: str | None = None):
        self.answers = answers
        self.index, self.client, self.deterministic_only, self.top_k = index, client or MockClient(), deterministic_only, top_k
        self.retriever, self.classifier = retriever or retriever_of(index), classifier

    def _examples(self, m: DataFrame, key: str) -> DataFrame:
        """The examples, written once, so that a failure shows here."""
        shown = ["customer_redacted_text", "customer_text", "brand_redacted_text", "brand_text"]
        spark = m.sparkSession
        try:
            found = self.retriever(m, key, "message", self.top_k).select(key, "rank", "score", *shown)
            return Scratch(spark, "examples").write(found, "examples")
        except FORGIVEN as e:
            warnings.warn(f"no examples: {type(e).__name__}", stacklevel=2)
            none = StructType([m.schema[key], *spark.createDataFrame([], "rank long, score double, " + ", ".join(f"{c} string" for c in shown)).schema])
            return spark.createDataFrame([], none)

    def _prompts(self, m: DataFrame, key: str, found: DataFrame) -> DataFrame:
        try:
            return prompts(m, key, found, self.top_k)
        except FORGIVEN as e:
            warnings.warn(f"no prompts: {type(e).__name__}", stacklevel=2)
            counted = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_similarity"))
            empty = F.lit(None).cast("string")
            return m.join(counted, key, "left").select(
                key, empty.alias("system_prompt"), empty.alias("user_prompt"), F.coalesce("n", F.lit(0)).alias("retrieved_count"), "top_similarity"
            )

    def transform(self, messages: DataFrame, key: str, text: str) -> DataFrame:
        """One row per valid message; ``key`` must be unique. Invalid ones are those of ``rejected``."""
        mock = isinstance(self.client, MockClient)
        m = messages.where(validation(text).isNull()).select(key, F.regexp_replace(F.col(text), f"^{X.SPACE}+|{X.SPACE}+$", "").alias("message"))
        a = self.classifier(m)
        if mock or self.deterministic_only:
            a = a.withColumn("method", F.lit("deterministic"))
        else:
            a = ask_model(a, self.client, store=self.answers)
            a = a.withColumn("escalation", I.escalation(F.col("clean"), F.col("agent_intent"), F.col("points")))
            a = a.withColumn("needs_review", F.col("escalation") != "none").withColumn("reason", I.reason_text(F.col("escalation")))
        g = generate(self._prompts(m, key, self._examples(m, key)), self.client, self.answers)
        return a.join(g, key).select(
            key, F.col("message").alias("customer_message"), F.col("agent_intent").alias("intent"), F.col("confidence").alias("intent_confidence"),
            F.col("method").alias("intent_method"), F.col("evidence").alias("intent_evidence"), "retrieved_count", "top_similarity", "generated_response",
            "generation_success", "used_fallback", "error_type", F.col("needs_review").alias("needs_human_review"), F.col("reason").alias("escalation_reason"),
            "model_name", F.lit("mock" if mock else "live").alias("mode"), F.array(*map(F.lit, V.STEPS)).alias("workflow_steps"),
        )

    def rejected(self, messages: DataFrame, key: str, text: str) -> DataFrame:
        return messages.select(key, validation(text).alias("validation_error")).where("validation_error is not null")

    def handle(self, message) -> dict:
        """One message; raises InvalidMessage."""
        if not isinstance(message, str):
            raise InvalidMessage("a message must be a string")
        spark = SparkSession.active()
        one = spark.createDataFrame([(0, message)], "mid long, message string")
        bad = self.rejected(one, "mid", "message").first()
        if bad:
            raise InvalidMessage(bad.validation_error)
        return {k: v for k, v in self.transform(one, "mid", "message").first().asDict().items() if k != "mid"}


def build_agent(index: TfidfIndex, settings: Settings | None = None, mock: bool = True, deterministic_only: bool = False, top_k: int = V.TOP_K) -> SupportAgent:
    """The agent of some settings. With ``mock`` no model is called at all; with ``deterministic_only`` none for labels.

    A live agent needs the settings' endpoint and key and raises RuntimeError without them.
    """
    if mock:
        return SupportAgent(index, MockClient(), True, top_k)
    settings = settings or Settings()
    if not settings.url:
        raise RuntimeError("no model endpoint is set; use the mock client")
    return SupportAgent(index, LiveClient(settings.url, settings.model, settings.key()), deterministic_only, top_k)


def evaluate(results: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    """One row of rates. golden: key, intent."""
    j = results.select(key, F.col("intent").alias("predicted"), "needs_human_review", "generation_success", "used_fallback", "retrieved_count")
    j = j.join(golden.select(key, F.col("intent").alias("expected")), key)
    right, good = F.col("predicted") == F.col("expected"), F.col("generation_success") & ~F.col("used_fallback")
    rate = lambda c, d=4: F.coalesce(X.rounded(F.avg(c.cast("double")), d), F.lit(0.0))
    return j.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"), rate(right).alias("accuracy"), F.count_if("needs_human_review").alias("escalated"),
        rate(F.col("needs_human_review")).alias("escalation_rate"), F.count_if(good).alias("successful"), rate(good).alias("success_rate"),
        rate(F.col("retrieved_count"), 3).alias("average_retrieved"),
    )


def confusion(pairs: DataFrame, most: int = 10) -> DataFrame:
    """expected, predicted, n of the most frequent errors; ties by name."""
    wrong = pairs.where("expected <> predicted").groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "expected", "predicted").limit(most)


def class_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("expected").agg(
        F.count(F.lit(1)).alias("total"), X.rounded(F.avg((F.col("expected") == F.col("predicted")).cast("double")), 3).alias("accuracy")
    )
