"""Checked settings, stage parameters and gates, and the seams where models and rules plug in."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from conceptflow.functions import text as tx

CONFLICT_POLICIES = ("flag", "force")


class Encoder(Protocol):
    """Vectors of texts."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Scores of (mention, name) pairs."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def encoded(text: Column, encoder: Encoder) -> Column:
    """A vector for each text, in Arrow batches."""

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encoder(texts.fillna("").tolist())])

    return F.pandas_udf(encode, ArrayType(DoubleType()))(text)


def scored(left: Column, right: Column, reranker: Reranker) -> Column:
    """A score for each pair of texts, in Arrow batches."""

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(reranker(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype="float64")

    return F.pandas_udf(score, DoubleType())(left, right)


@dataclass(frozen=True)
class MappingRules:
    """How individuals are regenerated; checked when made."""

    conflict_policy: str = "flag"
    auto_threshold: float = 0.9
    grey_threshold: float = 0.7
    min_support: int = 1
    excluded: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.conflict_policy not in CONFLICT_POLICIES:
            raise ValueError(f"conflict_policy is one of {', '.join(CONFLICT_POLICIES)}, not {self.conflict_policy!r}")
        if not 0 <= self.grey_threshold <= self.auto_threshold <= 1:
            raise ValueError("thresholds are in order within 0 and 1")
        if self.min_support < 1:
            raise ValueError("min_support is one at least")

    def rules_hash(self) -> str:
        """The same for the same rules, whatever the order in which they were given."""
        rules = asdict(self) | {"excluded": sorted(self.excluded)}
        return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class StageSpec:
    """A stage: typed parameters, whether it asks a model, and the plan step that it runs."""

    name: str
    parameters: dict[str, type]
    needs_provider: bool = False
    step: str = ""


def cleaned(spec: StageSpec, given: dict[str, object]) -> dict[str, object]:
    """``given`` if all of it is known and of its type (an int where a float is asked for counts); else ``ValueError``."""
    if unknown := sorted(set(given) - set(spec.parameters)):
        raise ValueError(f"{spec.name} takes no {', '.join(unknown)}")
    out = {}
    for name, value in given.items():
        kind = spec.parameters[name]
        if kind is float and type(value) is int:
            value = float(value)
        if type(value) is not kind:
            raise ValueError(f"{spec.name}: {name} is {kind.__name__}, not {type(value).__name__}")
        out[name] = value
    return out


def blocked_by(spec: StageSpec, has_provider: bool, plan: DataFrame) -> str | None:
    """Why a stage can't run now: no provider, or its step of the plan (step, state) is blocked; null if it can."""
    if spec.needs_provider and not has_provider:
        return "no provider"
    if spec.step and not plan.where((F.col("step") == spec.step) & (F.col("state") == "blocked")).isEmpty():
        return "earlier steps are open"
    return None


#: Normalizers of templates by name, and modelling axes by name with the signature each needs; both are open for more.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {"template": tx.template, "words": tx.normalized, "none": lambda c: c}
AXES: dict[str, tuple[frozenset[str], Callable[..., DataFrame]]] = {}


def axis(name: str, *signature: str):
    """Register a detector of modelling axes; ``signature``: tables that it reads."""

    def add(detector: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        AXES[name] = (frozenset(signature), detector)
        return detector

    return add


def applicable(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What each registered detector finds, where all tables that it reads are given."""
    return {name: detector(**{k: tables[k] for k in signature}) for name, (signature, detector) in AXES.items() if signature <= tables.keys()}


def use_case(documents: DataFrame, gold: DataFrame, inventory: DataFrame, descriptor: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, gold, inventory) of an evaluation: withheld documents, excluded classes and what annotates them go.

    ``descriptor``: {"withheld": [document ids], "excluded": [class iris]}.
    """
    withheld, excluded = descriptor.get("withheld", []), descriptor.get("excluded", [])
    live = documents.where(~F.col("document_id").isin(withheld))
    kept = gold.where(~F.col("iri").isin(excluded)).join(live.select("document_id"), "document_id", "left_semi")
    return live, kept, inventory.where(~F.col("iri").isin(excluded))



def majority() -> Callable[[Column], Column]:
    """A grouped aggregate for pandas: the most frequent value, the smallest in a tie; null if all are null."""

    @F.pandas_udf(StringType())
    def pick(values: pd.Series) -> str | None:
        counts = values.dropna().value_counts()
        return min(counts[counts == counts.max()].index) if len(counts) else None

    return pick
