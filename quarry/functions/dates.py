"""Date tokens: normalised dates that are appended to table-like texts so that they can be searched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import bound, strip

#: How dates are written. Groups: year, month, day; a year of two digits is in the 2000s.
FULL = (r"(?U)(20\d{2})[./-](\d{1,2})[./-](\d{1,2})", r"(?U)(20\d{2})年(\d{1,2})月(\d{1,2})日", r"(?U)\b(\d{2})[/-](\d{1,2})[/-](\d{1,2})\b", r"(?U)\b(20\d{2})(\d{2})(\d{2})\b")
MONTHS = (r"(?U)(20\d{2})[./-](\d{1,2})", r"(?U)(20\d{2})年(\d{1,2})月", r"(?U)(\d{2})年(\d{1,2})月", r"(?U)\b(20\d{2})(\d{2})\b")
#: Those of them that are one run of digits.
RUNS = (FULL[3], MONTHS[3])
SERIAL, SERIALS, EPOCH = r"(?U)\b(\d{5})(?:\.\d+)?\b", (30000, 60000), "1899-12-30"
TOKEN = "DATE"


def _month(year: Column, month: Column) -> Column:
    ok = year.between(1900, 2100) & month.between(1, 12)
    return F.when(ok, F.concat(F.lit(f"{TOKEN}="), F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))


def _tokens(text: Column, pattern: str, with_day: bool) -> Column:
    """The tokens of a pattern's matches; a match's numbers are its runs of digits, or, in one run, its first four and then two each."""

    def each(match: Column) -> Column:
        one_run = F.array(F.substring(match, 1, 4), F.substring(match, 5, 2), F.substring(match, 7, 2))
        return bound(one_run if pattern in RUNS else F.split(match, r"(?U)\D+"), written)

    def written(parts: Column) -> Column:
        year, month, day = (F.get(parts, i).try_cast("int") for i in range(3))
        found = _month(F.when(F.length(F.get(parts, 0)) == 2, year + 2000).otherwise(year), month)
        if not with_day:
            return F.array(found)
        return bound(found, lambda token: F.array(token, F.when(day.between(1, 31), F.concat(token, F.lit("-"), F.lpad(day.cast("string"), 2, "0")))))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), each))


def _serials(text: Column) -> Column:
    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SERIAL), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.between(*SERIALS))
    days = F.transform(numbers, lambda x: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), x), "yyyy-MM-dd"))
    return F.flatten(F.transform(days, lambda d: F.array(F.concat(F.lit(f"{TOKEN}="), F.substring(d, 1, 7)), F.concat(F.lit(f"{TOKEN}="), d))))


def date_tokens(text: Column) -> Column:
    """The distinct tokens of all dates in a text, sorted; the calendar is not checked, and a bad day leaves the month."""
    return bound(text, lambda t: F.array_sort(F.array_distinct(F.array_compact(F.concat(*[_tokens(t, p, True) for p in FULL], *[_tokens(t, p, False) for p in MONTHS], _serials(t))))))


def append_date_tokens(text: Column) -> Column:
    suffix = lambda tokens: F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")
    return bound(text, lambda x: bound(date_tokens(x), lambda tokens: F.when(F.size(tokens) > 0, strip(F.concat(x, F.lit(" "), suffix(tokens)))).otherwise(x)))
