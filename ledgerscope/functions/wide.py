"""Whole numbers of 256 bits as four limbs, for amounts and sums beyond decimal(38).

A number is a struct of ``l3`` to ``l0``, 64 bits each, the highest first. Limbs are decimals, so each is added up alone, in
Spark's own sums, for up to some 10^18 rows, and carried once at the end: then ``l2`` to ``l0`` are in [0, 2^64), the sign is
that of ``l3``, and structs compare as the numbers do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerscope.functions.keys import negated, without_prefix

LIMBS = ("l3", "l2", "l1", "l0")
WHOLE = "decimal(38,0)"
BASE = 2**64


def _lit(n: int) -> Column:
    return F.lit(str(n)).cast(WHOLE)


def _of(parts: dict[str, Column]) -> Column:
    return F.struct(*(parts[x].cast(WHOLE).alias(x) for x in LIMBS))


def zero() -> Column:
    return _of(dict.fromkeys(LIMBS, _lit(0)))


def from_hex(digits: Column) -> Column:
    """A hexadecimal number of up to 64 digits, with or without 0x; no digits after 0x are zero; null where it is none or longer (zeros before it aside)."""
    h = F.ltrim(without_prefix(digits), F.lit("0"))
    part = lambda k: F.conv(F.substring(F.lpad(h, 64, "0"), 1 + 16 * k, 16), 16, 10)
    return F.when((F.length(h) <= 64) & F.unhex(h).isNotNull(), _of({x: part(k) for k, x in enumerate(LIMBS)}))


def from_decimal(amount: Column) -> Column:
    """A decimal(38,0) of either sign."""
    return carried(F.when(amount.isNotNull(), _of({"l3": _lit(0), "l2": _lit(0), "l1": _lit(0), "l0": amount})))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that a lambda names, so that its expression is not written out once for every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split(limb: Column) -> Column:
    """What stays of a limb (``stays``) and what it carries (``over``)."""
    stays = lambda x: F.pmod(x, _lit(BASE))
    over = lambda x: F.call_function("div", x, _lit(BASE)) - F.when((x < 0) & (stays(x) != 0), 1).otherwise(0)
    return _named(limb, lambda x: F.struct(stays(x).alias("stays"), over(x).alias("over")))


def carried(number: Column) -> Column:
    """The same number with every limb but the highest in [0, 2^64)."""
    out, carry = {}, F.lit(0)
    for x in LIMBS[:0:-1]:
        parts = _split((number[x] + carry).cast(WHOLE))
        out[x], carry = parts["stays"], parts["over"]
    out[LIMBS[0]] = number[LIMBS[0]] + carry
    return F.when(number.isNotNull(), _of(out))


def is_wide(rows: DataFrame, name: str) -> bool:
    kind = rows.schema[name].dataType
    return isinstance(kind, StructType) and tuple(kind.names) == LIMBS


def minus(rows: DataFrame, name: str) -> Column:
    """The number below zero; for a struct the limbs are not carried yet, as sums do that."""
    c = F.col(name)
    return F.when(c.isNotNull(), _of({x: negated(c[x]) for x in LIMBS})) if is_wide(rows, name) else negated(c)


def nothing(rows: DataFrame, name: str) -> Column:
    """The zero of a column's type."""
    return zero() if is_wide(rows, name) else F.lit(0)


def total(rows: DataFrame, name: str, over: WindowSpec | None = None, where: Column | None = None) -> Column:
    """The sum of a column, of structs or of plain numbers, in an aggregate or over a window; null without a value."""
    c = F.col(name) if where is None else F.when(where, F.col(name))
    one = lambda x: F.sum(x) if over is None else F.sum(x).over(over)
    if not is_wide(rows, name):
        return one(c)
    sums = {x: one(c[x]) for x in LIMBS}
    return F.when(sums["l0"].isNotNull(), carried(_of(sums)))


def to_hex(number: Column) -> Column:
    """A carried number as 0x and its digits, after a minus sign if negative; null beyond 256 bits."""
    part = lambda n: F.concat(*(F.lpad(F.conv(n[x].cast("string"), 10, 16), 16, "0") for x in LIMBS))
    text = lambda n: F.when(n["l3"] < _lit(BASE), F.concat(F.lit("0x"), F.lower(F.regexp_replace(part(n), "^0+(?=.)", ""))))
    below = lambda n: _named(carried(_of({x: negated(n[x]) for x in LIMBS})), text)
    return _named(number, lambda n: F.when(n["l3"] < 0, F.concat(F.lit("-"), below(n))).otherwise(text(n)))


def to_double(number: Column) -> Column:
    """The nearest double, about: limbs are added from the highest."""
    out = F.lit(0.0)
    for x in LIMBS:
        out = out * F.lit(float(BASE)) + number[x].cast("double")
    return out
