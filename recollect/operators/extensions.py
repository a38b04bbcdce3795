"""Extension points: evaluators, prediction readers, retrievers, model clients."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from . import ablation, retrieval, scoring
from .inference import CallPolicy, ClientFactory, batch_infer, judge_infer


class Retriever(Protocol):
    """Finds records for queries inside the query's own unit.

    In: queries (unit_id, query_id, ...), records (unit_id, record_id, ...).
    Out: (unit_id, query_id, record_id, score, rank).
    """

    def retrieve(self, queries: DataFrame, records: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class VectorRetriever:
    k: int
    threshold: float | None = None

    def retrieve(self, queries: DataFrame, records: DataFrame) -> DataFrame:
        found = retrieval.vector_topk(queries, records, self.k)
        return found if self.threshold is None else retrieval.distance_filter(found, self.threshold)


@dataclass(frozen=True)
class MultiChannelRetriever:
    """Semantic and lexical search, merged."""

    k: int
    prefetch_k: int

    def retrieve(self, queries: DataFrame, records: DataFrame) -> DataFrame:
        channels = {
            "raw_semantic": retrieval.vector_topk(queries, records, self.prefetch_k),
            "raw_lexical": retrieval.lexical_topk(queries, records, self.prefetch_k),
        }
        return retrieval.multi_channel(channels, self.k)


@dataclass(frozen=True)
class Evaluator:
    """A versioned report: evaluation rows in, report rows out."""

    name: str
    evaluator_version: str
    run: Callable[[DataFrame], DataFrame]

    def __post_init__(self):
        if not self.evaluator_version:
            raise ValueError(f"evaluator {self.name!r} must carry an evaluator_version")


def built_in_evaluators(benchmark: str) -> dict[str, Evaluator]:
    version = scoring.rules_for(benchmark).evaluator_version
    return {
        "primary_judge_score": Evaluator("primary_judge_score", "primary-judge-v1", scoring.judge_score),
        "rigorous_report": Evaluator("rigorous_report", version, lambda df: scoring.rigorous(df, benchmark)),
        "ablation_report": Evaluator("ablation_report", version, lambda df: ablation.ablation(df, benchmark)),
    }


@dataclass
class Registry:
    """What a user plugs in, by name. Names given here win over the built-ins."""

    evaluators: dict[str, Evaluator] = field(default_factory=dict)
    prediction_readers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    retrievers: dict[str, Callable[[dict], Retriever]] = field(default_factory=dict)
    answerers: dict[str, ClientFactory] = field(default_factory=dict)
    judges: dict[str, ClientFactory] = field(default_factory=dict)

    def evaluator(self, name: str, benchmark: str) -> Evaluator:
        found = self.evaluators.get(name) or built_in_evaluators(benchmark).get(name)
        if found is None:
            raise KeyError(f"evaluator is not registered: {name!r}")
        return found

    @staticmethod
    def _named(kind: str, known: dict, name: str):
        if name not in known:
            raise KeyError(f"{kind} is not registered: {name!r}")
        return known[name]

    def read_predictions(self, name: str, *arguments) -> DataFrame:
        """Predictions by the reader of that name, which gets the arguments."""
        return self._named("prediction reader", self.prediction_readers, name)(*arguments)

    def answer(self, name: str, prompts: DataFrame, policy: CallPolicy = CallPolicy(), **options) -> DataFrame:
        """Answer every prompt with the client of that name, as ``batch_infer`` does."""
        return batch_infer(prompts, self._named("answerer", self.answerers, name), policy, **options)

    def judge(self, name: str, prompts: DataFrame, benchmark: str, policy: CallPolicy = CallPolicy(), **options) -> DataFrame:
        """Judge every prompt with the client of that name, as ``judge_infer`` does."""
        return judge_infer(prompts, self._named("judge", self.judges, name), benchmark, policy, **options)

    def retriever(self, name: str, settings: dict) -> Retriever:
        built_in = {
            "vector": lambda s: VectorRetriever(s["k"], s.get("threshold")),
            "multi_channel": lambda s: MultiChannelRetriever(s["k"], s["prefetch_k"]),
        }
        factory = self.retrievers.get(name) or built_in.get(name)
        if factory is None:
            raise KeyError(f"retriever is not registered: {name!r}")
        return factory(settings)
