"""Values read from free text, as columns: places, rates, dates, bands, keys. Nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefectures by region.
REGIONS = {
    "北海道": ["北海道"],
    "東北": ["青森", "岩手", "宮城", "秋田", "山形", "福島"],
    "関東": ["茨城", "栃木", "群馬", "埼玉", "千葉", "東京", "神奈川"],
    "甲信越": ["新潟", "山梨", "長野"],
    "北陸": ["富山", "石川", "福井"],
    "東海": ["岐阜", "静岡", "愛知", "三重"],
    "近畿": ["滋賀", "京都", "大阪", "兵庫", "奈良", "和歌山"],
    "中国": ["鳥取", "島根", "岡山", "広島", "山口"],
    "四国": ["徳島", "香川", "愛媛", "高知"],
    "九州": ["福岡", "佐賀", "長崎", "熊本", "大分", "宮崎", "鹿児島", "沖縄"],
}
# Names that say no prefecture, and endings of prefectures that aren't 県.
NO_PREFECTURE = ["", "null", "日本", "関東", "全国", "リモート"]
FULL_NAMES = {"東京": "東京都", "大阪": "大阪府", "京都": "京都府", "北海": "北海道"}
# How amounts before 万 and numbers alone are written.
AMOUNT, NUMBER = r"([0-9]+(?:\.[0-9]+)?)\s*万", r"^\s*[0-9]+(\.[0-9]+)?\s*$"
# Words for "from today on", and whose own staff or whose partner's staff may be offered.
AT_ONCE = "即日|即時|すぐ|随時|現在|稼働可能|空き"
OWN, ONE_STEP, FURTHER = "自社", "1社先", "2社先以降"
# Lowest years of each band of experience.
BANDS = [(16, "16+"), (11, "11-15"), (6, "6-10"), (3, "3-5"), (None, "0-2")]
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def _or_null(c: Column) -> Column:
    """regexp_extract gives an empty string where there is nothing."""
    return F.nullif(c, F.lit(""))


def _first(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def skill_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def name_key(c: Column) -> Column:
    """A person's name without what differs between spellings."""
    return F.regexp_replace(F.upper(c), r"[. ,　、．・ー\-]", "")


def region_of(prefecture: Column) -> Column:
    pairs = [F.lit(x) for region, names in REGIONS.items() for name in names for x in (name, region)]
    return F.try_element_at(F.create_map(*pairs), prefecture)


def full_prefecture(c: Column) -> Column:
    """A prefecture's whole name, or null. The shortest reading wins, so that 京都府 gives 京都."""
    plain = [n for names in REGIONS.values() for n in names if n not in ("東京", "大阪", "京都", "北海道")]
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in FULL_NAMES.items() for x in kv)), c)
    cut = _or_null(F.regexp_extract(c, "^(.+?[都道府県]).+$", 1))
    return _first([(c.isNull() | c.isin(NO_PREFECTURE) | c.rlike("[a-zA-Z]"), F.lit(None).cast("string")), (cut.isNotNull(), cut), (c.rlike("[都道府県]$"), c), (c.isin(plain), F.concat(c, F.lit("県")))], named)


def core_prefecture(c: Column) -> Column:
    """A prefecture without its ending, out of an address; names that have an ending's character inside go first."""
    text = F.coalesce(c, F.lit(""))
    special = [(text.contains(mark), F.lit(name)) for mark, name in (("北海道", "北海道"), ("東京", "東京"), ("京都", "京都"))]
    head = _or_null(F.regexp_extract(text, r"(\S+?)[都道府県]", 1))
    town = F.regexp_replace(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), "(市|区|町|村|郡).*$", "")
    return _first(special, F.coalesce(head, town))


def place_of_work(prefecture: Column, location: Column) -> Column:
    given = _or_null(F.trim(F.coalesce(prefecture, F.lit(""))))
    return F.when(given.isNotNull(), F.coalesce(_or_null(core_prefecture(given)), given)).otherwise(core_prefecture(location))


def location_fits(gate: Column, full_remote: Column, work: Column, home: Column) -> Column:
    """Whether someone living in `home` can work in `work`; an unknown home doesn't fit, an unknown place of work fits all."""
    known = _or_null(F.coalesce(home, F.lit("")))
    near = known.isNotNull() & (known.eqNullSafe(work) | F.coalesce(region_of(known) == region_of(work), F.lit(False)))
    return ~F.coalesce(gate, F.lit(True)) | F.coalesce(full_remote, F.lit(False)) | region_of(work).isNull() | near


def supply_step(flow: Column) -> Column:
    given = _or_null(F.trim(F.coalesce(flow, F.lit(""))))
    return F.when(given.isNotNull(), F.when(given.isin(OWN, ONE_STEP), given).otherwise(FURTHER))


def can_be_offered(gate: Column, flow: Column, has_resume: Column, available: Column, as_of: Column) -> Column:
    ready = supply_step(flow).isin(OWN, ONE_STEP) & F.coalesce(has_resume, F.lit(False)) & (available <= as_of)
    return ~F.coalesce(gate, F.lit(True)) | F.coalesce(ready, F.lit(False))


def highest_rate(c: Column) -> Column:
    """The largest of the amounts before 万 in (0, 500], else a text that is a number alone."""
    text = F.translate(F.coalesce(c, F.lit("")), WIDE_DIGITS + "．", DIGITS + ".")
    amounts = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), lambda x: x.cast("double"))
    alone = F.when(text.rlike(NUMBER), F.trim(text).cast("double"))
    return F.coalesce(F.array_max(F.filter(amounts, lambda x: (x > 0) & (x <= 500))), alone)


#: An amount before 万, or two of them with a dash between.
RANGE = "([0-9]{2,3})(?:[ 　]*[~〜ー−-][ 　]*([0-9]{2,3}))?[ 　]*万"


def lowest_rate(c: Column) -> Column:
    """The smallest amount of two or three digits before 万 in 20..300; both ends of a range count."""
    text = F.translate(F.coalesce(c, F.lit("")), WIDE_DIGITS + "～－", DIGITS + "~-")
    ends = F.concat(*(F.regexp_extract_all(text, F.lit(RANGE), F.lit(i)) for i in (1, 2)))
    return F.array_min(F.filter(F.transform(ends, lambda x: x.try_cast("int")), lambda x: x.between(20, 300)))


def mean_rate(c: Column) -> Column:
    """The mean of all amounts before 万 in 20..300."""
    amounts = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9]{2,3})\s*万"), F.lit(1)), lambda x: x.cast("double"))
    good = F.filter(amounts, lambda x: x.between(20, 300))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good))


def available_from(c: Column, as_of: Column) -> Column:
    """The first day of the month that a text names; as_of for "at once"; a month alone is the next one of that name."""
    text = F.translate(c, WIDE_DIGITS, DIGITS)
    dated = lambda i: _or_null(F.regexp_extract(text, r"(20[0-9]{2})\s*[年/-]\s*([0-9]{1,2})?", i)).cast("int")
    bare = _or_null(F.regexp_extract(text, r"(?<![0-9])([0-9]{1,2})\s*[月/]", 1)).cast("int")
    year = F.coalesce(dated(1), F.year(as_of) + (bare < F.month(as_of)).cast("int"))
    month = F.when(dated(1).isNotNull(), dated(2)).otherwise(bare)
    return F.when(text.rlike(AT_ONCE), as_of).when(month.between(1, 12), F.make_date(year, F.when(month.between(1, 12), month), F.lit(1)))


def experience_band(years: Column) -> Column:
    pairs = [(years >= low, F.lit(name)) for low, name in BANDS[:-1]]
    return F.when(years.isNotNull(), _first(pairs, F.lit(BANDS[-1][1])))


def contains_word(text: Column, word: Column) -> Column:
    """Whether a lower-case word stands in a lower-case text with no letter, digit, # or + beside it."""
    return F.rlike(text, F.concat(F.lit(r"(^|[^a-z0-9#+])\Q"), word, F.lit(r"\E([^a-z0-9#+]|$)")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
