"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider_date(value: Column) -> Column:
    """Vendor date text (20200131, 20200131.0, 2020-01-31, with spaces) -> DATE, else null."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.coalesce(
        F.when(
            text.rlike(r"^\d{8}$"),
            F.try_to_date(text, "yyyyMMdd"),
        ),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
    )


def finite(value: Column) -> Column:
    """Number, with text that is no number, NaN and infinities all null."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def positive_inverse(value: Column) -> Column:
    return F.when(value > 0, 1.0 / value)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null for a zero or missing denominator."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def floor_lot(shares: Column, lot: int = 100) -> Column:
    """Whole lots not above ``shares``; a hair of tolerance keeps exact multiples."""
    return F.floor(F.greatest(shares, F.lit(0.0)) / lot + F.lit(1e-12)) * F.lit(float(lot))


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes")


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; values as text, nulls kept."""
    return F.to_json(
        F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]),
        {"ignoreNullFields": "false"},
    )


def row_sha(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of the given fields."""
    return F.sha2(canonical_json(fields), 256)


def report_type(value: Column) -> Column:
    """'1' for both '1' and '1.0', missing as empty text."""
    return F.coalesce(F.regexp_replace(F.trim(value.cast("string")), r"\.0$", ""), F.lit(""))


def st_flag(name: Column) -> Column:
    """Special-treatment or delisting marker in a historical name."""
    return F.coalesce(name.rlike("(?i)ST|退"), F.lit(False))


def limit_rate(symbol: Column, is_st: Column) -> Column:
    """Daily price-limit rate by board; fixed values of the exchange rules."""
    code, venue = F.split_part(symbol, F.lit("."), F.lit(1)), F.split_part(symbol, F.lit("."), F.lit(2))
    return (
        F.when((venue == "BJ") | code.startswith("4") | code.startswith("8") | code.startswith("92"), 0.30)
        .when(code.rlike("^(300|301|688|689)"), 0.20)
        .when(is_st, 0.05)
        .otherwise(0.10)
    )


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), F.lit(False))


def vendor_code(symbol: Column) -> Column:
    """Exchange-prefixed quote id: 1. for SH, 0. for SZ and BJ."""
    code, venue = F.split_part(symbol, F.lit("."), F.lit(1)), F.split_part(symbol, F.lit("."), F.lit(2))
    return F.when(venue == "SH", F.concat(F.lit("1."), code)).when(
        venue.isin("SZ", "BJ"), F.concat(F.lit("0."), code)
    )
