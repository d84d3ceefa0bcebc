"""Ordered folds over arrays that give out values on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements folded before their output is set aside. Appending copies an array, so one
# output that grows with the text would make the fold quadratic.
BLOCK = 256

Step = Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]


def scan(
    size: Column,
    value_at: Callable[[Column], Column],
    start: dict[str, Column],
    step: Step,
    out_type: str,
) -> Column:
    """Fold the values at positions 0 to `size - 1` and collect what `step` gives out.

    `step(state, value)` returns the next state, the value to give out, and whether to.
    `value_at` should pick from plain columns: an expression would be computed again for
    every value.
    """

    def state(fields: dict[str, Column], out: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()], out.alias("out"))

    def advance(acc: Column, i: Column) -> Column:
        fields, given, when = step(acc, value_at(i))
        return state(fields, F.when(when, F.array_append(acc["out"], given)).otherwise(acc["out"]))

    def advance_block(acc: Column, first: Column) -> Column:
        last = F.element_at(acc, -1)
        opening = state({name: last[name] for name in start}, empty)
        places = F.sequence(first, F.least(first + (BLOCK - 1), size - 1))
        return F.array_append(acc, F.aggregate(places, opening, advance))

    empty = F.array().cast(f"array<{out_type}>")
    folded = F.aggregate(
        F.sequence(F.lit(0), size - 1, F.lit(BLOCK)),
        F.array(state(start, empty)),
        advance_block,
        lambda acc: F.flatten(F.transform(acc, lambda s: s["out"])),
    )
    return F.when(size > 0, folded).otherwise(empty)
