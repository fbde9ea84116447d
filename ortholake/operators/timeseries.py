"""Statistics along a clock within every group: rolling over a span of it, or decaying by a half-life of it.

Rows keep their place and gain a column. ``order_by`` is the order of rows; without it rows are ordered by the clock,
and rows at the same clock in no particular order, so name a tie-break where there are ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.functions.clocks import checked_clock, checked_values, clock_column, span
from ortholake.functions.columns import ColumnArg, keys_of, names_of, numeric, one_of
from ortholake.functions.errors import InputError
from ortholake.functions.windows import Ewm, Rolling
from ortholake.plans.ordered import halo_rows, map_groups, map_spread, sorted_rows, spread_rows

Span = int | float | timedelta
POLICIES = ("skip", "raise")


@dataclass(frozen=True)
class Statistic:
    """One statistic: kind ("ewm" or "rolling"), name, one value or two, and its parameters."""

    kind: str
    name: str
    values: tuple[ColumnArg, ...]
    span: Span
    min_samples: int = 1
    min_clock_span: Span | None = None
    ddof: int = 1
    bias: bool = False
    null_policy: str = "skip"
    out: str | None = None

    @property
    def label(self) -> str:
        return f"{self.kind}_{self.name}"


def clocked(df: DataFrame, statistics: Sequence[Statistic], *, clock: ColumnArg, by: str | Sequence[str] | None = None, order_by: ColumnArg | Sequence[ColumnArg] | None = None, spread: bool | None = None) -> DataFrame:
    """``df`` with a column for each statistic, all in one pass over one sort.

    With ``spread`` a group may go over many tasks, for groups that hold much of the data; that reads the rows twice.
    By default it is done where there are no keys. Rolling statistics in the order of the clock then run by ranges of
    it, each with copies of the rows before that its windows reach; decaying ones pass a small state for each task
    through the driver. Rolling statistics in another order, or beside decaying ones, have a window of rows as that
    state, so they are spread only when asked for.
    """
    keys = keys_of(by)
    operation = statistics[0].label
    clock_value, unit = clock_column(df, clock, operation)
    order = [clock] if order_by is None else [order_by] if isinstance(order_by, str | Column) else list(order_by)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    makers, names, values, added, reach = [], [], [], [], 0.0
    for s in statistics:
        one_of(s.null_policy, POLICIES, "null_policy")
        if s.min_samples < 0:
            raise ValueError("min_samples must not be negative")
        width = span(s.span, unit, "half_life" if s.kind == "ewm" else "window", s.label)
        reach = max(reach, width)
        if s.kind == "ewm":
            makers.append(lambda s=s, w=width: Ewm(w, s.min_samples, s.bias))
        else:
            least = 0.0 if s.min_clock_span is None else span(s.min_clock_span, unit, "min_clock_span", s.label, zero=True)
            if least > width:
                raise InputError(f"{s.label} requires min_clock_span <= window; received {s.min_clock_span!r} and {s.span!r}")
            makers.append(lambda s=s, w=width, m=least: Rolling(w, s.min_samples, m, s.ddof))
        values.append(numeric(df, s.values))
        names.append(names_of(df, s.values))
        added.append(s.out or s.label)
    columns = [f"_x{i}_{j}" for i, v in enumerate(values) for j in range(len(v))]
    flat = [v.alias(c) for v, c in zip((v for own in values for v in own), columns, strict=True)]
    rows = df.select("*", clock_value.alias("_clock"), *flat)
    first = clock if order_by is None else order_by if isinstance(order_by, str | Column) else next(iter(order_by), None)
    by_ranges = all(s.kind == "rolling" for s in statistics) and isinstance(first, str) and first == clock
    spread = not keys and (by_ranges or all(s.kind == "ewm" for s in statistics)) if spread is None else spread

    class State:
        def __init__(self):
            self.each = [make() for make in makers]
            self.last = None

        def step(self, piece: pa.RecordBatch) -> list[pa.Array]:
            at = checked_clock(piece.column("_clock"), self.last, operation)
            self.last = at[-1]
            out = []
            for i, (s, state) in enumerate(zip(statistics, self.each, strict=True)):
                own = [checked_values(piece.column(f"_x{i}_{j}"), names[i][j], s.label, s.null_policy) for j in range(len(s.values))]
                found = state.step(at, own[0], own[1] if len(own) > 1 else None, s.name)
                out.append(pa.array(found, mask=np.isnan(found)))
            return out

        def summary(self) -> tuple:
            return self.last, [state.summary() for state in self.each]

        def absorb(self, later: tuple) -> None:
            self.last = later[0]
            for state, own in zip(self.each, later[1], strict=True):
                state.absorb(own)

    fields = [T.StructField(a, T.DoubleType()) for a in added]
    if spread and by_ranges and (cut := halo_rows(rows, "_clock", reach)) is not None:
        result = map_groups(sorted_rows(cut, [*keys, "_range"], order), [*keys, "_range"], State, fields).where("not _halo").drop("_range", "_halo")
    elif spread and not by_ranges:
        result = map_spread(spread_rows(rows, keys, order), keys, State, fields)
    else:
        result = map_groups(sorted_rows(rows, keys, order), keys, State, fields)
    return result.drop("_clock", *columns)


def _one(df: DataFrame, kind: str, name: str, values: tuple, width: Span, clock, by, order_by, out, spread, **rest) -> DataFrame:
    return clocked(df, [Statistic(kind, name, values, width, out=out, **rest)], clock=clock, by=by, order_by=order_by, spread=spread)


def _rolling(name: str, pair: bool, moment: bool):
    keep = {"min_samples": 1, "min_clock_span": None, "null_policy": "skip"} | ({"ddof": 1} if moment else {})

    def run(df: DataFrame, *values: ColumnArg, clock: ColumnArg, window: Span, by=None, order_by=None, out: str | None = None, spread: bool | None = None, **options) -> DataFrame:
        _check(f"rolling_{name}", values, pair, options, keep)
        return _one(df, "rolling", name, values, window, clock, by, order_by, out, spread, **(keep | options))

    return _named(run, f"rolling_{name}", pair, "over the rows whose clock is less than ``window`` behind; ``min_samples`` values and a reach of ``min_clock_span`` at least, else null")


def _ewm(name: str, pair: bool, moment: bool):
    keep = {"min_samples": 1, "null_policy": "skip"} | ({"bias": False} if moment else {})

    def run(df: DataFrame, *values: ColumnArg, clock: ColumnArg, half_life: Span, by=None, order_by=None, out: str | None = None, spread: bool | None = None, **options) -> DataFrame:
        _check(f"ewm_{name}", values, pair, options, keep)
        return _one(df, "ewm", name, values, half_life, clock, by, order_by, out, spread, **(keep | options))

    return _named(run, f"ewm_{name}", pair, "of all rows so far, each weighing half as much for every ``half_life`` that the clock has moved since; null before ``min_samples`` values")


def _check(name: str, values: tuple, pair: bool, options: dict, keep: dict) -> None:
    if len(values) != 1 + pair:
        raise TypeError(f"{name} takes {'two values' if pair else 'one value'}")
    if unknown := set(options) - set(keep):
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")


def _named(run, name: str, pair: bool, about: str):
    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"``df`` with the {name.split('_')[1]} of {'two columns' if pair else 'a column'} {about}. A null adds nothing and still gets a result; ``null_policy='raise'`` makes it an error."
    return run


rolling_sum, rolling_mean, rolling_variance = _rolling("sum", False, False), _rolling("mean", False, False), _rolling("variance", False, True)
rolling_covariance, rolling_correlation = _rolling("covariance", True, True), _rolling("correlation", True, False)
ewm_sum, ewm_mean, ewm_variance = _ewm("sum", False, False), _ewm("mean", False, False), _ewm("variance", False, True)
ewm_covariance, ewm_correlation = _ewm("covariance", True, True), _ewm("correlation", True, False)
