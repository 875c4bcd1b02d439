"""Strategies put together from named components (K5): each takes a frame of candidates and gives it back with more columns.

A component is looked up in a catalog by kind and name, is made with checked parameters, and says which columns it
needs and gives; `composed` chains them while the plan is made, so a strategy is one plan over all its dates. Candidates:
signal_date, instrument_id and whatever the components need.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import decisions

#: Kinds in the order in which they apply.
KINDS = ("alpha", "construction", "constraint", "cost")
KEYS = ("signal_date", "instrument_id")

Step = Callable[[DataFrame], DataFrame]


class Component(NamedTuple):
    kind: str
    name: str
    build: Callable[..., Step]
    needs: tuple[str, ...]
    gives: tuple[str, ...]


class Catalog:
    """Components by kind and name."""

    def __init__(self, components: Sequence[Component] = ()):
        self.known: dict[tuple[str, str], Component] = {}
        for c in components:
            self.register(c)

    def register(self, component: Component) -> None:
        key = (component.kind, component.name)
        if component.kind not in KINDS or key in self.known:
            raise ValueError(f"no new component: {key}")
        self.known[key] = component

    def made(self, kind: str, name: str, parameters: dict) -> tuple[Component, Step]:
        """The component and its step; an error if there is none or it takes other parameters."""
        if (kind, name) not in self.known:
            raise KeyError(f"no {kind} of name {name}; known: {sorted(n for k, n in self.known if k == kind)}")
        component = self.known[kind, name]
        try:
            inspect.signature(component.build).bind(**parameters)
        except TypeError as e:
            raise ValueError(f"{kind} {name}: {e}") from None
        return component, component.build(**parameters)


class Strategy(Protocol):
    """name, candidates(inputs): the frame to start from, parts: (kind, name, parameters) in the order of KINDS, several constraints being allowed."""

    name: str
    parts: Sequence[tuple[str, str, dict]]

    def candidates(self, inputs: dict[str, DataFrame]) -> DataFrame: ...


def composed(strategy: Strategy, catalog: Catalog, inputs: dict[str, DataFrame]) -> DataFrame:
    """The candidates after all parts, under the strategy's name."""
    kinds = [k for k, _, _ in strategy.parts]
    if kinds != sorted(kinds, key=KINDS.index) or any(kinds.count(k) != 1 for k in ("alpha", "construction")):
        raise ValueError(f"{strategy.name}: one alpha, one construction, then constraints and costs, not {kinds}")
    frame = strategy.candidates(inputs)
    for kind, name, parameters in strategy.parts:
        component, step = catalog.made(kind, name, parameters)
        if missing := {*KEYS, *component.needs} - set(frame.columns):
            raise ValueError(f"{strategy.name}: {kind} {name} needs {sorted(missing)}")
        frame = step(frame)
        if missing := {*KEYS, *component.gives} - set(frame.columns):
            raise ValueError(f"{strategy.name}: {kind} {name} doesn't give {sorted(missing)}")
    return frame.withColumn("strategy", F.lit(strategy.name))


def column_score(column: str) -> Step:
    """A column as the score."""
    return lambda frame: frame.withColumn("score", F.col(column).cast("double"))


def trend_score(short: int, long: int) -> Step:
    """1 where the short moving average of close is above the long one, else no score."""

    def step(frame: DataFrame) -> DataFrame:
        state = decisions.dual_ma(frame.select("instrument_id", F.col("signal_date").alias("trade_date"), "close"), short, long)
        return frame.drop("score").join(state.select(*KEYS, F.when(F.col("direction") == "LONG", 1.0).alias("score")), list(KEYS))

    return step


def equal_weights(n: int, cap: float, least_adv: float) -> Step:
    def step(frame: DataFrame) -> DataFrame:
        return frame.drop("target_weight").join(decisions.equal_weight(frame, n, cap, least_adv).select(*KEYS, "target_weight"), list(KEYS))

    return step


def industry_limit(cap: float) -> Step:
    return lambda frame: decisions.industry_cap(frame.drop("weight").withColumnRenamed("target_weight", "weight"), cap).drop("weight")


def name_limit(cap: float) -> Step:
    return lambda frame: decisions.project_allocation(frame.drop("weight").withColumnRenamed("target_weight", "weight"), cap).drop("weight", "cash_weight")


def expected_cost(model: str) -> Callable[..., Step]:
    def build(commission_bps: float, minimum_cents: int, impact_bps: float = 0.0) -> Step:
        def step(frame: DataFrame) -> DataFrame:
            terms = decisions.cost_estimates(frame.select(*KEYS, F.col("adv_amount").alias("amount"), "equity_cents"), model, commission_bps, minimum_cents, impact_bps)
            size = F.abs(F.col("target_weight") - F.coalesce("current_weight", F.lit(0.0)))
            cost = F.when(size > 0, F.greatest(F.col("fixed"), size * F.col("linear")) + F.sqrt(size) * F.col("square_root")).otherwise(0.0)
            return frame.join(terms, list(KEYS)).withColumn("expected_cost", cost).drop("fixed", "linear", "square_root", "capacity")

        return step

    return build


_COST_NEEDS = ("adv_amount", "equity_cents", "target_weight", "current_weight")
STANDARD = (
    Component("alpha", "column", column_score, (), ("score",)),
    Component("alpha", "dual_ma", trend_score, ("close",), ("score",)),
    Component("construction", "equal_weight", equal_weights, ("score", "adv_amount", "current_weight"), ("target_weight",)),
    Component("constraint", "industry_cap", industry_limit, ("industry", "target_weight"), ("target_weight",)),
    Component("constraint", "name_cap", name_limit, ("target_weight",), ("target_weight",)),
    *[Component("cost", m, expected_cost(m), _COST_NEEDS, ("expected_cost",)) for m in ("fixed_linear", "linear_impact", "sqrt_impact")],
)
