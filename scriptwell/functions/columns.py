"""Column expressions shared by the table operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_trim(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def initcap_trim(c: Column | str) -> Column:
    return F.initcap(F.trim(col(c)))


def safe_ratio(num: Column | str, den: Column | str, scale: int = 2) -> Column:
    """Rounded quotient, 0.0 where the denominator is not positive or missing."""
    return F.when(
        col(den) > 0, F.round(F.try_divide(col(num).cast("double"), col(den)), scale)
    ).otherwise(F.lit(0.0))


def null_ratio(num: Column | str, den: Column | str, scale: int = 2, factor: float = 1) -> Column:
    """Rounded quotient times factor, NULL on a zero denominator."""
    quotient = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return F.round(quotient if factor == 1 else quotient * F.lit(float(factor)), scale)


def exact_sum(c: Column | str) -> Column:
    """Sum that does not depend on the order rows arrive in: of values below 1e26, to 12 decimals."""
    return F.sum(col(c).cast("decimal(38,12)")).cast("double")


def exact_avg(c: Column | str) -> Column:
    """Average over an exact sum; nulls are skipped."""
    return F.try_divide(exact_sum(c), F.count(col(c)).cast("double"))


def sum_if(predicate: Column, value: Column | str) -> Column:
    return F.sum(F.when(predicate, col(value)).otherwise(F.lit(0)))


def is_generic(brand: Column | str, generic: Column | str) -> Column:
    return F.coalesce(col(brand) == col(generic), F.lit(False))


def is_pain_specialty(specialty: Column | str) -> Column:
    text = F.lower(col(specialty))
    return F.coalesce(text.contains("pain") | text.contains("anesthesi"), F.lit(False))


def cost_tier(avg_cost: Column | str) -> Column:
    c = col(avg_cost)
    return (
        F.when(c < 20, "low").when(c < 100, "medium").when(c < 1000, "high")
        .otherwise("specialty_tier")
    )


def label_generic(flag: Column | str) -> Column:
    return F.when(col(flag), "Generic").otherwise("Brand Name")


def starts_with_any(c: Column | str, prefixes: Iterable[str]) -> Column:
    matched = F.lit(False)
    for prefix in prefixes:
        matched = matched | F.coalesce(col(c).startswith(prefix), F.lit(False))
    return matched


def masked(c: Column | str, role: str, allowed: Iterable[str], mask: str) -> Column:
    """The value for an allowed role, a constant for everyone else."""
    return F.when(F.lit(role).isin(*allowed), col(c)).otherwise(F.lit(mask))


def optional_eq(df: DataFrame, column: str, value=None) -> DataFrame:
    """Equality filter that is left out when no value is given."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def amount_band(amount: Column | str) -> Column:
    """Coarse order-preserving integer band of a number, about 3% wide.

    Built from the bit length and the top bits of the amount in cents, so that every
    executor computes the same band for the same amount.
    """
    cents = F.floor(F.least(F.abs(col(amount)) * 100, F.lit(9.0e18))).cast("bigint")
    bits = F.when(cents == 0, F.lit(0)).otherwise(F.length(F.bin(cents)))
    top = F.call_function("shiftright", cents, F.greatest(bits - 6, F.lit(0)))
    band = (bits * 32 + top.bitwiseAND(F.lit(31))).cast("int")
    return F.when(col(amount) < 0, -band).when(col(amount).isNotNull(), band)


def hold(df: DataFrame, *columns: str) -> DataFrame:
    """Fix the given columns as computed values of each row.

    Spark moves a filter below the projections it depends on and repeats their
    expressions in it, once per reference. A one-element generator stays in between, so
    expensive columns are computed once however often they are read afterwards.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
