"""Asking a resolver for answers: requests, retries, bounded concurrency, batch jobs and their results.

The service is behind two small protocols, so that the engine holds no client of its own: Answering for single requests,
Batches for jobs. Tests use made-up ones.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import DONE, FAILED

#: Requests at a time; tries, first delay in seconds and its factor, of single requests, new jobs and status calls.
CONCURRENCY = 3
ASKING, CREATING, LOOKING = (5, 2.0, 2.0), (3, 5.0, 2.0), (5, 5.0, 2.0)
#: Seconds between looks at a job.
INTERVAL = 10.0
ANSWERS = "answers array<struct<id: int, c: int, cf: double, s: boolean>>"


class Answering(Protocol):
    def __call__(self, request: str) -> str:
        """The answer to a request, as text."""


class Batches(Protocol):
    def create(self, requests: list[dict]) -> dict: ...
    def status(self, batch_id: str) -> dict: ...
    def cancel(self, batch_id: str) -> dict: ...
    def results(self, batch_id: str) -> Iterator[dict]: ...


def with_retries(call: Callable[[], Any], plan: tuple[int, float, float], on: tuple[type[Exception], ...] = (Exception,), jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's value; after each failure it waits longer, and the last failure is raised."""
    tries, delay, factor = plan
    for k in range(1, tries + 1):
        try:
            return call()
        except on:
            if k == tries:
                raise
            sleep(delay + random.uniform(0, jitter))
            delay *= factor


def clean_json(text: str) -> str:
    """What is from the first opening to the last closing brace, without code fences."""
    first, last = text.find("{"), text.rfind("}")
    return text[first : last + 1] if 0 <= first < last else text.strip()


def answers(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, c, cf, s) out of answers' texts; a text that isn't such JSON gives none. Missing confidence is 0, a missing search false."""
    body = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    rows = texts.select(F.explode(F.from_json(body, ANSWERS)["answers"]).alias("a")).where("a.id is not null and a.c is not null")
    cf = F.coalesce(F.col("a.cf"), F.lit(0.0))
    return rows.select("a.id", "a.c", F.when(cf < 0, 0.0).when(cf > 1, 1.0).otherwise(F.round(cf, 2)).alias("cf"), F.coalesce("a.s", F.lit(False)).alias("s"))


def resolve_chunks(chunks: DataFrame, ask: Answering, concurrency: int = CONCURRENCY, plan: tuple[int, float, float] = ASKING, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(chunk_id, text, warning) of chunks (chunk_id, request): as many requests at a time as there are partitions. A chunk that fails to the last has no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk, request in zip(frame["chunk_id"], frame["request"], strict=True):
                try:
                    rows.append((chunk, with_retries(lambda r=request: json.dumps(json.loads(clean_json(ask(r)))), plan, jitter=1.0, sleep=sleep), None))
                except Exception as e:  # noqa: BLE001  one chunk's failure leaves the others alone
                    rows.append((chunk, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["chunk_id", "text", "warning"])

    return chunks.select("chunk_id", "request").repartition(concurrency).mapInPandas(run, "chunk_id long, text string, warning string")


def create_job(requests: list[dict], client: Batches, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A new job of one request for each chunk; only lost connections are tried again."""
    named = [{"custom_id": f"chunk-{k}", "params": r} for k, r in enumerate(requests, 1)]
    job = with_retries(lambda: client.create(named), CREATING, (ConnectionError, TimeoutError), sleep=sleep)
    return {"batch_id": job["id"], "status": job["processing_status"], "total_requests": len(named)} | _counts(job)


def _counts(job: dict) -> dict:
    return {f"{k}_count": job.get("request_counts", {}).get(k, 0) for k in ("processing", "succeeded", "errored", "canceled", "expired")}


def job_status(batch_id: str, client: Batches, sleep: Callable[[float], None] = time.sleep) -> dict:
    job = with_retries(lambda: client.status(batch_id), LOOKING, (TimeoutError,), sleep=sleep)
    return {"batch_id": job["id"], "status": job["processing_status"]} | _counts(job)


def cancel_job(batch_id: str, client: Batches) -> dict:
    job = client.cancel(batch_id)
    return {"batch_id": job["id"], "status": job["processing_status"]}


def share_done(status: dict) -> float:
    """Ended requests of all, 0 where there are none."""
    ended = sum(status[f"{k}_count"] for k in ("succeeded", "errored", "canceled", "expired"))
    total = ended + status["processing_count"]
    return ended / total if total else 0.0


def await_job(batch_id: str, client: Batches, interval: float = INTERVAL, told: Callable[[float], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The results of a job, once it has ended well; otherwise RuntimeError."""
    while True:
        status = job_status(batch_id, client, sleep)
        if told:
            told(share_done(status))
        if status["status"].lower() in DONE:
            return list(client.results(batch_id))
        if status["status"].lower() in FAILED:
            raise RuntimeError(f"the job ended as {status['status']}")
        sleep(interval)


#: A line of a job's results: how a request ended, why the answer stopped, what it cost, and its blocks.
RESULT = "custom_id string, result struct<type: string, message: struct<stop_reason: string, usage: struct<input_tokens: long, output_tokens: long>, content: array<struct<type: string, text: string, name: string>>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, type, stop_reason, tokens, searches, text) of result files of one JSON object a line; text joins the text blocks."""
    r = spark.read.schema(RESULT).json(path)
    content = "result.message.content"
    return r.selectExpr(
        "custom_id", "result.type as type", "result.message.stop_reason as stop_reason", "result.message.usage.input_tokens as in_tokens", "result.message.usage.output_tokens as out_tokens",
        f"coalesce(size(filter({content}, b -> b.type = 'server_tool_use' and b.name = 'web_search')), 0) as searches",
        f"trim(array_join(transform(filter({content}, b -> b.type = 'text'), b -> b.text), '')) as text",
    )


def totals(results: DataFrame) -> DataFrame:
    """One row: tokens and searches of requests that succeeded, refused ones included in tokens; refused and failed requests."""
    good = "type = 'succeeded'"
    return results.selectExpr(
        f"coalesce(sum(if({good}, in_tokens, 0)), 0) as in_tokens", f"coalesce(sum(if({good}, out_tokens, 0)), 0) as out_tokens",
        f"coalesce(sum(if({good} and stop_reason <> 'refusal', searches, 0)), 0) as searches",
        f"count_if({good} and stop_reason = 'refusal') as refused", f"count_if(not {good}) as failed",
    )


def job_answers(results: DataFrame) -> DataFrame:
    """Answers of requests that succeeded and weren't refused."""
    return answers(results.where("type = 'succeeded' and coalesce(stop_reason, '') <> 'refusal'"))
