"""Roles that a person's text gives them, and the prefecture of a station as people write it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Roles in order of rank, what names them, and work that points to them without naming them.
ROLES = [
    ("PMO", "(?<![A-Z])PMO(?![A-Z])|プロジェクト[　 ]?マネジメント[　 ]?オフィス", None),
    ("プロジェクトマネージャー", "(?<![A-Z])PM(?!O)(?![A-Z])|プロジェクト[　 ]?マネージャー", None),
    ("プロダクトマネージャー", "(?<![A-Za-z])PdM(?![A-Za-z])|プロダクト[　 ]?(?:マネージャー|マネジャー|オーナー)", None),
    ("プロジェクトリーダー", "(?<![A-Z])(?<!サブ)PL(?![A-Z])(?![/／ -]?(?i:sql|pgsql|[1i](?![a-z])))|(?<!サブ)リーダー(?!シップ)", None),
    ("テックリード", "(?<![A-Z])(?<!サブ)TL(?![A-Z])|テック[　 ]?リード", None),
    ("アーキテクト", "アーキテクト", None),
    ("インフラエンジニア", "インフラ[　 ]?(?:エンジニア|構築|設計|移行|刷新|要件定義|基盤)", "インフラ[　 ]?(?:運用|保守|周り)"),
    ("ディレクター", "ディレクター(?!ズ)|ディレクション", "(?:進行|制作)[　 ]?管理"),
    ("システムエンジニア", "(?<![A-Za-zドML])SE(?![A-Za-z])|システム[　 ]?エンジニア(?!長)", None),
    ("プログラマー", "(?<![A-Za-z])PG(?![A-Za-z])|プログラマー?", None),
    ("スクラムマスター", "スクラム[　 ]?マスター", None),
]
#: What takes a mention back, sections that speak of others or of wishes, lines that name a role outright, and points.
NOT_OWN = "[　 ]?(?:補佐|補助|支援のみ|見習い|の(?:もと|下|指示)|(?:の|として(?:の)?)?(?:経験)?(?:は|も)?(?:なし|無し|ありません|ない|未経験)|(?:は|も)?未経験|を?(?:希望|目指))"
SUPPORT_COUNTS = ("PMO",)
SECTION = r"^\s*[【■◆●〔\[]\s*([^】〕\]\n:：]{1,20})"
OTHERS_SECTION = "希望|募集|案件概要|求める|体制|チーム構成|今後"
TITLE_LINE = r"^\s*[・●■]?\s*(?:役割|役職|担当|ポジション|職種|立場)\s*[:：]"
TITLE_POINTS, NAMED_POINTS, WORK_POINTS = 5, 2, 1


def prose_roles(texts: DataFrame, key: str = "id") -> DataFrame:
    """key, role, points, rank: what each text (key, text) makes of a person, most points first, then by rank of the roles.

    Each line gives a role the points of its surest mention: a line that is about the role, a name, or work alone. Mentions that are taken
    back (not experienced, assisting, wished for) give none, nor do lines of sections about others or wishes; a section goes on to
    the next heading. A text is one partition; null texts and texts without roles have no rows.
    """
    each = texts.select(key, F.monotonically_increasing_id().alias("nr"), "text").select(key, "nr", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "")
    heading = F.nullif(F.regexp_extract("text", SECTION, 1), F.lit(""))
    section = F.last(heading, ignorenulls=True).over(W.partitionBy(key, "nr").orderBy("line"))
    own = each.withColumn("section", section).where(~F.coalesce(F.col("section").rlike(OTHERS_SECTION), F.lit(False)))
    title = F.col("text").rlike(TITLE_LINE)

    def points(role: str, name: str, work: str | None) -> Column:
        taken_back = NOT_OWN.replace("補佐|補助|支援のみ|", "") if role in SUPPORT_COUNTS else NOT_OWN
        named = F.col("text").rlike(f"(?:{name})(?!{taken_back})")
        worked = F.col("text").rlike(f"(?:{work})(?!{taken_back})") if work else F.lit(False)
        return F.when(named & title, TITLE_POINTS).when(named, NAMED_POINTS).when(worked, WORK_POINTS).otherwise(0)

    scores = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(i).alias("place"), points(role, name, work).alias("points")) for i, (role, name, work) in enumerate(ROLES)))
    found = own.select(key, F.explode(F.filter(scores, lambda s: s["points"] > 0)).alias("s")).groupBy(key, "s.role", "s.place").agg(F.sum("s.points").alias("points"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("points"), "place"))
    return found.select(key, "role", "points", rank.cast("long").alias("rank"))


# What is written before a station's name, around it, and which words are lines and no stations.
OPERATOR = "^(?:JR[東西]?日?本?|ＪＲ|都営(?:地下鉄)?|東京メトロ|市営(?:地下鉄)?|地下鉄|新交通)"
AFTER, WALK, LINE_WORD = r"(?s)[※（(].*$", r"徒歩\s*[0-9]+\s*分|バス\s*[0-9]+\s*分", "線$|鉄道$|電鉄$|^JR|^ＪＲ"


def station_candidates(c: Column) -> Column:
    """Names under which a station may be known, the surest first: as written, with the other small ke, without the operator; then word by word."""
    base = F.trim(F.regexp_replace(F.regexp_replace(c, AFTER, ""), WALK, ""))
    words = F.filter(F.split(base, r"[\s　、,/／]+"), lambda w: (w != "") & ~w.rlike(LINE_WORD))

    def forms(x: Column) -> Column:
        raw = F.regexp_replace(F.regexp_replace(x, "駅$", ""), r"\s+", "")
        bare = F.regexp_replace(raw, OPERATOR, "")
        return F.array(raw, F.translate(raw, "ヶ", "ケ"), bare, F.translate(bare, "ヶ", "ケ"))

    return F.filter(F.array_distinct(F.flatten(F.transform(F.concat(F.array(base), words), forms))), lambda n: n != "")


def station_prefectures(people: DataFrame, stations: DataFrame, prefectures: list[str], key: str = "id") -> DataFrame:
    """key, station, prefecture: one that is written beside the station, else that of the first of its names that is known.

    people: key, station (as written); stations: name, prefecture; of one name in several prefectures the least counts. Unknown stations have null.
    """
    written = F.regexp_extract("station", "(" + "|".join(sorted(prefectures, key=len, reverse=True)) + ")", 1)
    p = people.select(key, "station", F.nullif(written, F.lit("")).alias("written"))
    known = stations.groupBy("name").agg(F.min("prefecture").alias("prefecture"))
    names = p.where("written is null").select(key, "station", F.posexplode(station_candidates(F.col("station"))).alias("place", "name"))
    found = names.join(known, "name").groupBy(key, "station").agg(F.min(F.struct("place", "prefecture")).alias("b")).select(key, F.col("station").alias("s_"), "b.prefecture")
    j = p.alias("p").join(found.withColumnRenamed(key, "k_").alias("f"), F.col(f"p.{key}").eqNullSafe(F.col("f.k_")) & F.col("p.station").eqNullSafe(F.col("f.s_")), "left")
    return j.select(F.col(f"p.{key}").alias(key), F.col("p.station").alias("station"), F.coalesce("p.written", "f.prefecture").alias("prefecture"))
