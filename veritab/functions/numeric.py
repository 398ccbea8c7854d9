"""Numbers from text, percentages and plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 100_000.0


def parse_numeric(c: Column) -> Column:
    """A double from text in either decimal convention; parentheses or a leading minus negate;
    letters and currency signs go; what is no number is 0.

    With both separators the last one is the decimal mark. A single comma is a thousands mark only
    between four or more digits and exactly three.
    """
    text = F.trim(F.coalesce(c, F.lit("")))
    negative = text.startswith("-") | (text.startswith("(") & text.endswith(")"))

    def number(plain: Column) -> Column:
        """One step after another: of a part that stood twice, the optimizer would copy all patterns."""
        # '' becomes 0, and what is infinite has no remainder
        found = F.concat(F.lit("0"), F.regexp_extract(plain, r"^(\d+\.?\d*|\.\d+)([eE]\d+)?$", 0)).cast("double")
        return F.nanvl(found % F.lit(float("inf")), F.lit(0.0)) * F.when(negative, -1.0).otherwise(1.0) + 0.0  # no negative zero

    kept = F.regexp_replace(text, "[^0-9.,eE]", "")
    plain = F.regexp_replace(kept, "^([^,.]{4,}),([^,.]{3})$", "$1$2")
    plain = F.regexp_replace(plain, r",(?=.*\.[^,]*$)", "")  # a dot is the last separator
    plain = F.regexp_replace(plain, r"\.(?=.*,[^.]*$)", "")  # a comma is
    plain = F.regexp_replace(plain, "^([^,]*),", "$1.")
    # the usual texts, nothing, plain digits or no comma, need none of these steps
    return F.when(text == "", 0.0).when(text.rlike(r"^\d{1,15}\z"), text.cast("double")).when(~text.contains(","), number(kept)).otherwise(number(plain))


def pct1(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.floor(part / whole * 1000 + 0.5) / 10)


def guard_measure(c: Column) -> Column:
    """0 for what no single row can measure."""
    return F.when(F.abs(c) <= MOST, c).otherwise(0.0)  # NaN is above all numbers
