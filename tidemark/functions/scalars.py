"""Column expressions on log fields; all stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: words that mark a log message as an error, matched without case
ERROR_WORDS = "error|fail|exception"


def ip_to_numeric(ip: Column) -> Column:
    """Base-256 value of a dotted quad; NULL or malformed text gives 0."""
    parts = F.split(ip, r"\.", -1)
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.coalesce(F.when(F.size(parts) == 4, value), F.lit(0)).cast("bigint")


def to_number(c: Column) -> Column:
    """Numeric coercion: text that is no number, and NaN, become NULL."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def message_length(message: Column) -> Column:
    return F.length(message)


def has_error(message: Column) -> Column:
    return F.coalesce(message.rlike(f"(?i){ERROR_WORDS}").cast("int"), F.lit(0))


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("bigint")


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar parts of a timestamp and their cyclical encoding."""
    hour = F.hour(ts)
    day = day_of_week(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": is_weekend(ts),
        "month": F.month(ts),
        "hour_sin": F.sin(hour * (2 * math.pi) / 24),
        "hour_cos": F.cos(hour * (2 * math.pi) / 24),
        "day_sin": F.sin(day * (2 * math.pi) / 7),
        "day_cos": F.cos(day * (2 * math.pi) / 7),
    }


def row_mean(cols: list[str]) -> Column:
    """Univariate reduction: the column itself, or the mean over columns."""
    total = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(cols)))


def flag(score: Column, threshold: float = 0.5) -> Column:
    """Prediction: strictly above the threshold."""
    return (score > F.lit(float(threshold))).cast("int")


def md5_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def rounded(c: Column, digits: int) -> Column:
    """A double to ``digits`` decimals, halves away from zero, by arithmetic; ``round`` goes through decimal texts.

    Numbers from 2^52 units of the last digit on have no further digits and stay.
    """
    scale = float(10**digits)
    units = F.abs(c) * F.lit(scale)
    return F.when(units < F.lit(float(1 << 52)), F.signum(c) * F.floor(units + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)).otherwise(c)
