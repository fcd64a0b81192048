"""Formulas written once as named steps, usable as projected columns or inside a lambda.

A formula is a list of ``(name, fn)``; ``fn`` maps the columns known so far to a new column.
``project`` lays the steps out as successive projections, which Catalyst keeps apart when a step is
referenced more than once, so nothing is recomputed and the whole chain stays in generated code.
``inline`` nests the same steps as one expression, for use inside ``aggregate``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = tuple[str, Callable[[SimpleNamespace], Column]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def project(df: DataFrame, inputs: dict[str, Column], steps: Sequence[Step], outputs: dict[str, str]) -> DataFrame:
    """Add ``outputs`` (step name -> column name) to ``df``; helper columns do not survive."""
    keep = [c for c in df.columns if c not in outputs.values()]
    tmp = {name: f"__{name}" for name in [*inputs, *(s for s, _ in steps)]}
    out = df.withColumns({tmp[k]: v for k, v in inputs.items()})
    known = SimpleNamespace(**{k: F.col(tmp[k]) for k in inputs})
    for name, fn in steps:
        out = out.withColumn(tmp[name], fn(known))
        setattr(known, name, F.col(tmp[name]))
    return out.select(*keep, *[F.col(tmp[s]).alias(c) for s, c in outputs.items()])


def inline(inputs: dict[str, Column], steps: Sequence[Step], output: str) -> Column:
    """The same formula as one nested expression."""

    def nest(known: dict[str, Column], rest: Sequence[Step]) -> Column:
        if not rest:
            return known[output]
        (name, fn), *tail = rest
        return let(fn(SimpleNamespace(**known)), lambda v: nest({**known, name: v}, tail))

    return nest(dict(inputs), list(steps))


def bisect(
    lo: Column, hi: Column, goes_right: Callable[[Column], Column], halvings: int = 60
) -> Column:
    """Fixed-count bisection; ``goes_right(mid)`` tells whether the root lies above ``mid``."""
    start = F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _i: Column) -> Column:
        # The middle is bound once: ``goes_right`` may name it many times, in a tree that is walked at every halving.
        return let(
            (s["lo"] + s["hi"]) / F.lit(2.0),
            lambda mid: F.when(goes_right(mid), F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda s: (s["lo"] + s["hi"]) / F.lit(2.0)
    )
