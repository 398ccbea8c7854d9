"""Periods from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations, Spanish and English, and their numbers.
MONTHS = {
    "ENE": 1, "ENERO": 1, "JAN": 1, "JANUARY": 1,
    "FEB": 2, "FEBRERO": 2, "FEBRUARY": 2,
    "MAR": 3, "MARZO": 3, "MARCH": 3,
    "ABR": 4, "ABRIL": 4, "APR": 4, "APRIL": 4,
    "MAY": 5, "MAYO": 5,
    "JUN": 6, "JUNIO": 6, "JUNE": 6,
    "JUL": 7, "JULIO": 7, "JULY": 7,
    "AGO": 8, "AGOSTO": 8, "AUG": 8, "AUGUST": 8,
    "SEP": 9, "SEPTIEMBRE": 9, "SETIEMBRE": 9, "SEPT": 9, "SEPTEMBER": 9,
    "OCT": 10, "OCTUBRE": 10, "OCTOBER": 10,
    "NOV": 11, "NOVIEMBRE": 11, "NOVEMBER": 11,
    "DIC": 12, "DICIEMBRE": 12, "DEC": 12, "DECEMBER": 12,
}
#: Parts of the patterns: a year from 1990 to 2100; a month of all digits there, two at most.
YEAR, MONTH = r"(199\d|20\d\d|2100)", r"(0[1-9]|1[0-2]|[1-9](?!\d))"


def parse_period(c: Column) -> Column:
    """YYYYMM as an int from '2025-10-15', '15/10/2025', '10/2025', 'OCT-25' or '2025 Octubre'; else null."""
    text = F.trim(c)
    # digits, or 0 for '': a cast that threw would cost each row that a pattern doesn't fit
    digits = lambda pattern, i: F.concat(F.lit("0"), F.regexp_extract(text, pattern, i)).cast("int")
    named = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = lambda pattern, i: F.try_element_at(named, F.upper(F.regexp_extract(text, pattern, i)))
    # a name before its year, of two to four digits, or after it; years under 100 are 1950 to 2049
    name, gap = "([A-Za-z]+)", r"[.\s/-]+"
    short, long, after = rf"^{name}{gap}0{{0,2}}(\d{{2}})$", rf"^{name}{gap}(\d{{3,4}})$", rf"^{YEAR}{gap}{name}$"
    first, last, alone = rf"^{YEAR}[-/.]{MONTH}", rf"^\d{{1,2}}[-/.]{MONTH}[-/.]{YEAR}", rf"^{MONTH}[-/]{YEAR}$"
    # each pattern is tried once, and only what fits is taken apart
    return (
        F.when(~text.rlike(r"\d"), F.lit(None).cast("int"))
        .when(text.rlike(first), digits(first, 1) * 100 + digits(first, 2))
        .when(text.rlike(last), digits(last, 2) * 100 + digits(last, 1))
        .when(text.rlike(alone), digits(alone, 2) * 100 + digits(alone, 1))
        .when(text.rlike(short), (F.pmod(digits(short, 2) - 50, F.lit(100)) + 1950) * 100 + month(short, 1))
        .when(text.rlike(long), digits(long, 2) * 100 + month(long, 1))
        .when(text.rlike(after), digits(after, 1) * 100 + month(after, 2))
        .cast("int")
    )


def period_of_serial(c: Column) -> Column:
    """YYYYMM of a spreadsheet's day number between 20000 and 80000; else null."""
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c).cast("int"))
    return F.when((c > 20000) & (c < 80000), F.year(day) * 100 + F.month(day))
