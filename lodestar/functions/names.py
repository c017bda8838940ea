"""Names of people and companies, and numbers of people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.operators.rules import reasons

# Legal forms, at the beginning or at the end.
FORMS_BEFORE = "株式会社|合同会社|有限会社|合資会社|一般社団法人|一般財団法人|医療法人"
FORMS_AFTER = "株式会社|合同会社|有限会社|合資会社"
# Headers of tables that were read as names, eras of dates, ends of kinds of skills, letters, and the longest name.
HEADERS = ["不明", "未定", "なし", "該当なし", "要員", "人材", "エンジニア", "技術者", "氏名", "名前", "お名前", "氏名カナ", "氏名（カナ）", "フリガナ", "ふりがな", "ﾌﾘｶﾞﾅ", "ｶﾅ"]
ERAS = "昭和|平成|令和|大正"
SKILL_KINDS = "(?:オープン系|汎用系|制御系|組込|インフラ|ネットワーク|サーバ|アプリ|開発系|運用系)$"
LETTER = "[A-Za-zＡ-Ｚａ-ｚぁ-んァ-ヶ一-龥ｦ-ﾝ]"
LONGEST = 20


def _wide(first: str, last: str) -> str:
    return "".join(chr(ord(c) + 0xFEE0) for c in map(chr, range(ord(first), ord(last) + 1)))


_NARROW = "".join(chr(c) for a, b in (("A", "Z"), ("a", "z"), ("0", "9")) for c in range(ord(a), ord(b) + 1))
_WIDE = _wide("A", "Z") + _wide("a", "z") + _wide("0", "9")


def narrow(c: Column) -> Column:
    """Full-width letters and digits as ASCII ones."""
    return F.translate(c, _WIDE, _NARROW)


def without_form(c: Column) -> Column:
    """A company's name without its legal form; null if that leaves nothing or changes nothing."""
    cut = F.trim(F.regexp_replace(F.regexp_replace(c, rf"^(?:{FORMS_BEFORE})[\s　]*", ""), rf"[\s　]*(?:{FORMS_AFTER})$", ""))
    return F.when((cut != "") & (cut != c), cut)


def company_key(c: Column) -> Column:
    """For comparing, not for showing: width, case, legal form, spaces and marks don't count."""
    return F.lower(F.regexp_replace(narrow(F.coalesce(without_form(F.trim(c)), F.trim(c))), r"[\s　・.,、。()（）「」\-]", ""))


def name_faults(c: Column) -> Column:
    """Why a text can hardly be a person's name: names of the reasons in their order; an empty or null one has that single fault."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s　\xa0]+|[\s　\xa0]+$", "")
    checks = [("wide digits", s.rlike("[０-９]")), ("digits", s.rlike("[0-9]")), ("era", s.rlike(ERAS)), ("kind of skill", s.rlike(SKILL_KINDS)), ("placeholder", s.isin(HEADERS)), ("no letter", ~s.rlike(LETTER)), ("too long", F.char_length(s) > LONGEST)]
    return F.when(F.char_length(s) > 0, reasons(checks)).otherwise(F.array(F.lit("empty")))


def person_code(number: Column) -> Column:
    return F.concat(F.lit("AK-"), F.lpad(number.cast("string"), 5, "0"))


def mail_domain(address: Column) -> Column:
    """The lower-case domain of the last address in a text like "Name <a@b.c>", or null."""
    return F.nullif(F.lower(F.regexp_extract(address, r"@([A-Za-z0-9.-]+)>?\s*$", 1)), F.lit(""))
