"""Lengths of work and months, read from résumé texts. Months are numbers: 12 * year + month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The year before the first of each era, numerals, and how "years" and "months" are written.
ERAS = {"昭和": 1925, "S": 1925, "平成": 1988, "H": 1988, "令和": 2018, "R": 2018}
NUMERALS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12}
LENGTHS = r"([0-9]+|[一二三四五六七八九十]+)\s*(年|[ヶかカヵｶ]月)"
#: More "years" than this are a date; serial days of spreadsheets that are taken for dates; years that are believed.
LONGEST_YEARS, SERIAL, YEARS = 50, (25569, 50000), (1970, 2100)
#: Shapes of dates, the first that gives a believed month counting: a pattern, and its groups of the era, the year and the month.
DATES = (
    (r"^\s*(昭和|平成|令和|[SHRshr])\s*(元|[0-9]{1,2})\s*[年./-]\s*([0-9]{1,2})", 1, 2, 3),
    (r"^\D*((?:19|20)[0-9]{2})\s*[年./-]\s*([0-9]{1,2})(?![0-9])", None, 1, 2),
    (r"^\D*([0-9]{2,4})\s*[年./-]\s*([0-9]{1,2})(?![0-9]*/[0-9])", None, 1, 2),
    (r"^\s*([0-9]{1,2})/[0-9]{1,2}/([0-9]{2,4})\s*$", None, 2, 1),
)


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _lookup(table: dict, c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def duration_months(c: Column) -> Column:
    """Months of a text as 2年6ヶ月, in digits or numerals, or null; what looks like a calendar year is no length."""
    amounts = F.arrays_zip(F.regexp_extract_all(c, F.lit(LENGTHS), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(LENGTHS), F.lit(2)).alias("unit"))

    def first(is_year: bool) -> Column:
        own = F.get(F.filter(amounts, lambda x: (x["unit"] == "年") == F.lit(is_year)), F.lit(0))["n"]
        return F.coalesce(own.try_cast("int"), _lookup(NUMERALS, own), F.lit(0))

    return F.when(first(True) <= LONGEST_YEARS, F.nullif(12 * first(True) + first(False), F.lit(0)))


def month_number(c: Column) -> Column:
    """Year and month of a date in a text as one number: by era, year first, month/day/year, or a spreadsheet's serial day."""

    def month_of(pattern: str, era: int | None, year: int, month: int) -> Column:
        part = lambda i: _or_null(F.regexp_extract(c, pattern, i))
        number = lambda i: F.when(part(i) == "元", 1).otherwise(part(i).try_cast("int"))
        y, m = number(year), number(month)
        y = y + _lookup(ERAS, F.upper(part(era))) if era else F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
        return F.when(y.between(*YEARS) & m.between(1, 12), 12 * y + m)

    serial = _or_null(F.regexp_extract(c, r"^\s*([0-9]{5})(?:[.][0-9]+)?\s*$", 1)).cast("int")
    day = F.date_add(F.to_date(F.lit("1899-12-30")), F.when(serial.between(*SERIAL), serial))
    return F.coalesce(F.year(day) * 12 + F.month(day), *(month_of(*shape) for shape in DATES))


def mail_conflicts(a: str, b: str, columns: tuple[str, ...] = ("station", "prefecture", "age", "rate")) -> Column:
    """The names of the columns in which both rows have a value, and not the same one."""
    given = lambda side, c: _or_null(F.col(f"{side}.{c}").cast("string"))
    return F.array_compact(F.array(*(F.when(given(a, c) != given(b, c), F.lit(c)) for c in columns)))
