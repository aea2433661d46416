"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import dictionaries as D
from vacantia.functions.columns import value_map


def _amount(value: Column) -> Column:
    thousands = F.floor(value / 1000 + 0.5).cast("bigint").cast("string")
    plain = F.when(value == F.floor(value), value.cast("bigint").cast("string"))
    return F.when(value >= 1000, F.concat(thousands, F.lit("k"))).otherwise(
        F.coalesce(plain, value.cast("string"))
    )


def salary_label(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """"€60k - €80k/yr"; null when neither bound is known."""
    signs = {code: sign for sign, code in D.CURRENCY_SYMBOLS.items()}
    sign = F.coalesce(value_map(signs, currency), F.concat(currency, F.lit(" ")), F.lit(""))
    suffix = F.coalesce(value_map(D.PERIOD_SUFFIXES, period), F.lit(""))
    single = F.coalesce(high, low)
    return F.when(
        low.isNotNull() & high.isNotNull() & (low != high),
        F.concat(sign, _amount(low), F.lit(" - "), sign, _amount(high), suffix),
    ).when(single.isNotNull(), F.concat(sign, _amount(single), suffix))


def relative_label(seconds: Column) -> Column:
    """"2 hours ago" for an age in seconds."""
    minutes = F.floor(seconds / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    months = F.floor(days / 30)

    def text(n: Column, unit: str) -> Column:
        plural = F.when(n == 1, "").otherwise("s")
        return F.concat(n.cast("bigint").cast("string"), F.lit(f" {unit}"), plural, F.lit(" ago"))

    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, text(minutes, "minute"))
        .when(hours < 24, text(hours, "hour"))
        .when(days < 30, text(days, "day"))
        .otherwise(text(months, "month"))
    )
