"""Bounds for 0/1 choice under a budget, as SQL expressions.

Let ``crit`` be the critical item: the first one, by value per weight, that no longer fits
when items are taken in that order. The *greedy choice* takes everything before it. Weight
is priced at the rate ``crit_value / crit_weight`` (Lagrangian relaxation of the budget;
Dantzig 1957, Fisher 1981). At that price the greedy decision is the best one for every
single item, so the bound of a partial choice that keeps to the greedy order from here on
is its own value plus the price of the room it has left. No node looks at the items below.

All arithmetic is on integers: products are DECIMAL(38, 0), so a bound is never rounded
below the true optimum. The total weight and value of an instance must fit a BIGINT; a larger
one is an overflow error, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def check_whole(df: DataFrame, *columns: str) -> None:
    """Refuse columns whose type can hold fractions: they would be cut off without a word."""
    for c in columns:
        kind = df.schema[c].dataType
        whole = isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0
        if not whole:
            raise TypeError(f"{c} is {kind.simpleString()}; scale it to a whole number, such as cents")


def exact_ratio() -> str:
    """``value / weight`` as (whole part, first and second 63 bits after the point).

    Two different ratios of positive BIGINTs differ by more than 2^-126, so the three
    numbers, compared in turn, order items exactly.
    """
    wide = "cast({} as decimal(19, 0))"
    shifted = lambda rest: f"({wide.format(rest)} * {wide.format('9223372036854775808')})"
    weight, first = wide.format("weight"), shifted("(value % weight)")
    second = shifted(f"({first} % {weight})")
    return f"struct(value div weight as whole, {first} div {weight} as bits1, {second} div {weight} as bits2)"


def product(a: str, b: str) -> str:
    """Product of two BIGINT expressions, wide enough not to overflow."""
    return f"cast({a} as decimal(19, 0)) * cast({b} as decimal(19, 0))"


def gain() -> str:
    """What an item is worth beyond the price of its weight, times ``crit_weight``."""
    return f"{product('value', 'crit_weight')} - {product('crit_value', 'weight')}"


def flip_can_win(best: str) -> str:
    """Can a choice that decides this item against the greedy order still beat ``best``?

    The greedy choice leaves ``budget - base_weight`` of the budget. Deciding against the
    order costs the absolute gain (Ingargiola and Korsh 1973); items that cannot pay it
    keep their greedy decision.
    """
    slack = f"{product('crit_value', '(budget - base_weight)')} - abs({gain()})"
    return f"{slack} >= {product(f'({best} + 1 - base_value)', 'crit_weight')}"


# The largest number whose square is a BIGINT.
ROOT = 3_037_000_499


def capped_quotient(a: str, b: str, divisor: str, cap: str) -> str:
    """``least(a * b div divisor, cap)`` for numbers that are not negative; capping first keeps the result a BIGINT.

    Numbers whose product is surely a BIGINT are multiplied as such, which takes a fraction of the time.
    """
    wide = f"least({product(a, b)}, {product(cap, divisor)}) div cast({divisor} as decimal(19, 0))"
    return f"if({a} between 0 and {ROOT}L and {b} between 0 and {ROOT}L, least({a} * {b} div {divisor}, {cap}), {wide})"


def node_bound(node: str, item: str) -> str:
    """Largest objective that can be reached from ``node`` once it has decided ``item``.

    The room is priced at the critical rate and, once the greedy items are all decided,
    also at the rate of the item decided last, which no later item exceeds. Never more can
    be gained than ``addable_after``, the value of the undecided items not yet taken.
    """
    room, cap = f"(budget - {node}.weight)", f"{item}.addable_after"
    by_critical = capped_quotient("crit_value", room, "crit_weight", cap)
    by_last = capped_quotient(f"{item}.value", room, f"{item}.weight", cap)
    return f"{node}.value + if({item}.greedy, {by_critical}, least({by_critical}, {by_last}))"
