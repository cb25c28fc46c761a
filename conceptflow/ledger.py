"""Content-addressed ledger of model calls: cached results are joined, misses run in Arrow partitions with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.session import cut


class ChatModel(Protocol):
    """Answers a prompt; raises on failure."""

    def __call__(self, prompt: str) -> str: ...


class NoModel:
    """No provider is configured: every call fails."""

    def __call__(self, prompt: str) -> str:
        raise RuntimeError("no model provider is configured")


class Scripted:
    """Fixed answers by prompt, for tests and replays; an unknown prompt fails."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = dict(answers)

    def __call__(self, prompt: str) -> str:
        return self.answers[prompt]


def payload(template: str, **columns: Column) -> Column:
    """A prompt column: ``template`` with {name} replaced by the columns; null ones are empty."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def keyed(units: DataFrame, stage: str, prompt_version: str, settings: Column) -> DataFrame:
    """``units`` (label, payload) with stage and key: the content of all that changes an answer - stage, prompt, model and its settings, payload."""
    parts = F.col("payload").alias("payload"), F.lit(prompt_version).alias("prompt_version"), settings.alias("settings"), F.lit(stage).alias("stage")
    return units.withColumn("stage", F.lit(stage)).withColumn("key", tx.unit_key(*parts))


def plan(ledger: DataFrame, units: DataFrame) -> DataFrame:
    """Units (key, label, payload) that the ledger doesn't have as done."""
    return units.dropDuplicates(["key"]).join(ledger.where("status = 'done'"), "key", "left_anti")


def run(ledger: DataFrame, units: DataFrame, worker: Callable[[str], str], retries: int = 3, abort_rate: float = 0.10, backoff: float = 0.0) -> DataFrame:
    """Ledger rows (key, label, status, attempts, result) after the units have run; too many failures raise.

    A failed call is tried again after ``backoff`` seconds, then twice as many, and so on.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                status, result, attempt = "failed", None, 0
                while status == "failed" and attempt < retries:
                    attempt += 1
                    try:
                        status, result = "done", worker(row.payload)
                    except Exception as error:  # noqa: BLE001  a worker's failure is a result of its unit
                        result = str(error)
                        if backoff and attempt < retries:
                            time.sleep(backoff * 2 ** (attempt - 1))
                out.append((row.key, row.label, status, attempt, result))
            yield pd.DataFrame(out, columns=["key", "label", "status", "attempts", "result"])

    done = cut(plan(ledger, units).select("key", "label", "payload").mapInPandas(call, "key string, label string, status string, attempts int, result string"))
    n = done.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("bad")).first()
    if n["n"] and n["bad"] / n["n"] > abort_rate:
        raise RuntimeError(f"{n['bad']} of {n['n']} units failed")
    return ledger.join(done, "key", "left_anti").unionByName(done)


def report(units: DataFrame) -> DataFrame:
    """(stage, units, done, failed, in_tokens, out_tokens)."""
    return units.groupBy("stage").agg(
        F.count("*").alias("units"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.coalesce("in_tokens", F.lit(0))).alias("in_tokens"),
        F.sum(F.coalesce("out_tokens", F.lit(0))).alias("out_tokens"),
    )


def barrier(units: DataFrame) -> DataFrame:
    """(stage, clear): no unit of the stage is pending or running."""
    return units.groupBy("stage").agg((F.count_if(F.col("status").isin("pending", "running")) == 0).alias("clear"))


def pending(ledger: DataFrame, units: DataFrame) -> DataFrame:
    """The ledger with units (key, label) that it lacks as pending rows; what it has stays as it is."""
    rows = units.select("key", "label").dropDuplicates(["key"]).join(ledger, "key", "left_anti")
    return ledger.unionByName(rows.select("key", "label", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("result")))


def model_stage(
    ledger: DataFrame, units: DataFrame, model: ChatModel, parse: Callable[[Column], Column], stage: str, prompt_version: str, settings: Column, **how: float
) -> tuple[DataFrame, DataFrame]:
    """(ledger, (label, status, parsed)): one stage over units (label, payload), cached answers joined, misses asked.

    ``parse`` turns an answer into a value; null there means that the answer can't be read.
    """
    own = keyed(units, stage, prompt_version, settings)
    after = cut(run(ledger, own, model, **how))
    answers = own.select("key", "label").join(after.select("key", "status", "result"), "key")
    parsed = F.when(F.col("status") == "done", parse(F.col("result")))
    status = F.when((F.col("status") == "done") & parsed.isNull(), "unreadable").otherwise(F.col("status"))
    return after, answers.select("label", status.alias("status"), parsed.alias("parsed"))


def split_batches(items: DataFrame, worker: Callable[[list[str]], list[str]], size: int) -> DataFrame:
    """(item, result) of distinct items in batches; a batch that fails or comes back mangled is asked again in halves.

    An item that fails alone has a null result. Rounds are as many as a batch can be halved.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for held in batch["items"]:
                try:
                    results = list(worker(list(held)))
                    good = len(results) == len(held)
                except Exception:  # noqa: BLE001  a failed batch is asked again in halves
                    results, good = [], False
                out.append((list(held), results if good else None))
            yield pd.DataFrame(out, columns=["items", "results"])

    named = items.select(F.col(items.columns[0]).cast("string").alias("item")).where("item is not null").distinct()
    groups = F.pmod(F.xxhash64("item"), F.ceil(F.lit(max(1, named.count())) / size))
    todo = named.groupBy(groups.alias("g")).agg(F.sort_array(F.collect_list("item")).alias("items")).select("items")
    # A hash deals sizes out unevenly: longer lists are cut at ``size``.
    todo = todo.select(F.explode(F.expr(f"transform(sequence(0, (size(items) - 1) div {size}), k -> slice(items, k * {size} + 1, {size}))")).alias("items"))
    parts: list[DataFrame] = []
    while True:
        asked = cut(todo.mapInPandas(ask, "items array<string>, results array<string>"))
        done = asked.where("results is not null or size(items) = 1")
        pairs = F.arrays_zip(F.col("items").alias("item"), F.coalesce("results", F.array(F.lit(None).cast("string"))).alias("result"))
        parts.append(done.select(F.inline(pairs)))
        failed = asked.where("results is null and size(items) > 1")
        if failed.isEmpty():
            break
        half = F.expr("size(items) div 2")
        todo = failed.select(F.explode(F.array(F.slice("items", 1, half), F.slice("items", half + 1, F.size("items")))).alias("items"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
