"""Batch model calls: one call per row inside ``mapInPandas``, the client is injected.

The number of partitions is the number of concurrent clients; each gets an equal part of
the request rate. A failed row carries its error and does not stop the job. Answers are
not repeatable, so write the result (``session.materialize``) before using it twice.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.prompts import DEFAULT_TEXTS
from ..functions.verdicts import response_problem

USAGE_KEYS = ("prompt_tokens_total", "completion_tokens", "total_tokens")
RESULT_SCHEMA = (
    "response string, finish_reason string, model string, usage map<string,bigint>, "
    "attempts int, error string"
)
MAX_BACKOFF_SECONDS = 16
JITTER_SECONDS = 0.5


@dataclass
class Reply:
    """What a client returns for one prompt."""

    response: str
    model: str = ""
    finish_reason: str | None = None
    prompt_tokens_total: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0


class RetryableError(RuntimeError):
    """Raised by a client for a failure that may pass (timeout, rate limit, server error)."""


# A client takes (system prompt, user prompt) and returns a Reply.
Client = Callable[[str, str], Reply]
ClientFactory = Callable[[], Client]


@dataclass(frozen=True)
class CallPolicy:
    requests_per_minute: float = 0.0
    max_retries: int = 5
    response_max_retries: int = 1
    partitions: int | None = None  # of the input, unless a number is named
    sleep: Callable[[float], None] = time.sleep

    def min_interval(self, partitions: int) -> float:
        """Seconds between two calls of one of ``partitions`` tasks that share the rate."""
        return 60.0 * partitions / self.requests_per_minute if self.requests_per_minute > 0 else 0.0


class _Caller:
    """One client with its pacing and transport retries."""

    def __init__(self, factory: ClientFactory, policy: CallPolicy, interval: float):
        self.client, self.policy, self.interval, self.next_at = factory(), policy, interval, 0.0

    def _pace(self) -> None:
        wait = self.next_at - time.monotonic()
        if wait > 0:
            self.policy.sleep(wait)
        self.next_at = time.monotonic() + self.interval

    def call(self, system: str, user: str) -> Reply:
        for retry in range(self.policy.max_retries + 1):
            self._pace()
            try:
                return self.client(system, user)
            except (RetryableError, TimeoutError, ConnectionError):
                if retry == self.policy.max_retries:
                    raise
                self.policy.sleep(min(2**retry, MAX_BACKOFF_SECONDS) + random.uniform(0, JITTER_SECONDS))
        raise AssertionError("unreachable")


def _result(replies: list[Reply], error: str | None) -> dict:
    last = replies[-1] if replies else None
    return {
        "response": last.response.strip() if last else None,
        "finish_reason": last.finish_reason if last else None,
        "model": last.model if last else None,
        "usage": {k: sum(getattr(r, k) for r in replies) for k in USAGE_KEYS},
        "attempts": len(replies),
        "error": error,
    }


def _ask(caller: _Caller, system: str, user: str, problem_of, retries: int, hint: str) -> dict:
    """Call until the answer is acceptable; all answers count towards the usage."""
    replies, problem = [], None
    for attempt in range(retries + 1):
        try:
            reply = caller.call(system, user if attempt == 0 else user + hint)
        except Exception as failure:  # the row carries the failure
            return _result(replies, f"{type(failure).__name__}: {failure}")
        replies.append(reply)
        problem = problem_of(reply)
        if problem is None:
            break
    return _result(replies, problem)


def _map_calls(df: DataFrame, factory: ClientFactory, policy: CallPolicy, system: str, prompt: str, problem_of, retries, hint):
    columns, tasks = df.columns, policy.partitions
    if tasks is None and policy.requests_per_minute > 0:  # all tasks run at once, each with its part of the rate
        tasks = df.sparkSession.sparkContext.defaultParallelism
    interval = policy.min_interval(tasks or 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller(factory, policy, interval)
        for batch in batches:
            answers = [_ask(caller, system, user, problem_of, retries, hint) for user in batch[prompt]]
            frame = pd.DataFrame(answers, columns=["response", "finish_reason", "model", "usage", "attempts", "error"])
            yield pd.concat([batch[columns].reset_index(drop=True), frame], axis=1)

    return (df.repartition(tasks) if tasks else df).mapInPandas(run, f"{schema}, {RESULT_SCHEMA}")


def _accept_anything(reply: Reply) -> str | None:
    return None


def batch_infer(
    df: DataFrame, factory: ClientFactory, policy: CallPolicy = CallPolicy(), system: str = "", prompt: str = "prompt"
) -> DataFrame:
    """Answer the ``prompt`` column of every row."""
    return _map_calls(df, factory, policy, system, prompt, _accept_anything, 0, "")


def judge_infer(
    df: DataFrame,
    factory: ClientFactory,
    benchmark: str,
    policy: CallPolicy = CallPolicy(),
    prompt: str = "prompt",
    texts=DEFAULT_TEXTS,
) -> DataFrame:
    """Judge every row; incomplete or unreadable answers are asked again with a hint."""

    def problem_of(reply: Reply) -> str | None:
        if reply.finish_reason not in (None, "stop"):
            return f"incomplete response ({reply.finish_reason})"
        return response_problem(reply.response, benchmark)

    return _map_calls(
        df, factory, policy, texts.judge_system, prompt, problem_of, policy.response_max_retries, texts.judge_retry
    )
