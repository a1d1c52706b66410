"""Column helpers for text cleaning, numbers and thresholds."""

from pyspark.sql import Column, functions as F

from pairwise.constants import WHITESPACE

# Decimals kept of a mean. The order of a distributed sum varies from run to run; rounding removes
# that noise, so thresholds, ties and bins do not depend on the partitioning.
MEAN_DIGITS = 12

# Cell texts that stand for a missing number.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends; ``trim`` alone removes blanks only."""
    return F.btrim(col, F.lit(WHITESPACE))


def number(col: Column) -> Column:
    """A text cell as double: booleans are 1 and 0, missing tokens and unreadable text are NaN."""
    text = strip(col.cast("string"))
    return (
        F.when(text.isNull() | text.isin(MISSING_TOKENS), F.lit(float("nan")))
        .when(F.lower(text) == "true", 1.0)
        .when(F.lower(text) == "false", 0.0)
        .otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan"))))
    )


def finite_or_zero(col: Column) -> Column:
    value = col.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def stable_mean(col: Column) -> Column:
    return F.round(F.avg(col), MEAN_DIGITS)


def rounded_to(col: Column, digits: int) -> Column:
    """``round(col, digits)``, the same value to the bit, without decimals where the scaled value is clear of a tie.

    Spark's own rounding prints and parses a number, which is most of the time of a wide export. Below 2^43 the
    scaled value is off by 0.001 at most, and an integer over a power of ten is the double next to that decimal.
    """
    scaled = col * 10.0**digits
    whole = F.floor(scaled + 0.5)
    clear = (F.abs(scaled) < 2.0**43) & (F.abs(scaled - whole) < 0.49)
    return F.when(clear, whole / 10.0**digits).otherwise(F.round(col, digits))


def above(name: str, threshold: float) -> Column:
    """``name > threshold`` where NaN never passes."""
    return ~F.isnan(F.col(name).cast("double")) & (F.col(name) > threshold)


def at_least(name: str, threshold: float) -> Column:
    """``name >= threshold`` where NaN never passes (Spark orders NaN above every number)."""
    return ~F.isnan(name) & (F.col(name) >= float(threshold))


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
