"""Which mails introduce people, which introduce projects, and which are neither: an ordered chain of rules over subject and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_rule

# Patterns of subjects and bodies, in the order in which they were agreed on.
SKIP_SUBJECT = [
    "(?i:unsubscribe)", "(?i:newsletter)", "ニュースレター", "メルマガ", "お知らせ", "ご案内", "配信停止", "登録完了", "確認メール", "(?i:noreply)", "(?i:no-reply)", "(?i:Invoice)", "(?i:receipt)",
    "領収書", "請求書", "支払い確認", "サービス停止", "メンテナンス", "セキュリティ通知", "(?i:password.*reset)", "アカウント.*確認", "ホームページより", "HPより.*お問い合わせ", "問い合わせフォーム",
    "勤怠実績通知", "(?i:e-staffing)", "自動配信メール", "システム通知", "打ち?合わせ", "ミーティング", "面談.*日程", "日程.*面談", "日程調整", "スケジュール調整", "お時間.*いただけ", "(?i:MTG.*依頼)",
    "(?i:meeting.*request)", "退職のご挨拶", "退職.*挨拶",
]
SKIP_BODY = [
    "配信停止はこちら", "テレアポ代行", "テレアポ.*外注", "営業代行.*強み", "見込み顧客.*トスアップ", "オンライン.*MTG.*ご状況", r"sales@[a-zA-Z0-9.]+\.[a-zA-Z]+", "BtoB.*サービス.*ご案内",
    "弊社.*サービス.*ご紹介", "資料請求はこちら", "日程調整URL.*https", r"timerex\.net", "ホームページより.*お客様からのお問い合わせ", "【お問い合わせ区分】", "【ご質問・ご相談内容】",
    "このメールはシステムからの自動配信メール", "返信いただけませんので.*ご了承", "勤怠実績通知", "派遣先企業より.*勤怠", r"e-staffing\.ne\.jp", r"e-staffing\.co\.jp", "スタッフコード[：:]",
    "就業先企業名[：:]", "派遣先管理台帳", "このメールへの返信はできません", "このメールは自動送信されています", "自動送信メールのため.*返信.*できません", r"portal\.[a-zA-Z0-9.-]+/agency/",
    "LinkedIn.*活用.*採用", "LinkedInを活用した",
]
HIRING_SUBJECT = [
    "スキルシート", "経歴書", "エンジニア", "フリーランス", "案件", "要件", "参画", "募集", "求人", "稼働", "単価", "常駐", "開発者", "SE[^O]", "PG[^P]", "PM[^S]", "インフラ.*エンジ",
    "Java.*開発", "Python.*開発", "React.*開発", "Angular.*開発", "Vue.*開発", "AWS.*開発", "Azure.*開発", "クラウド.*案件",
]
PROJECT_SUBJECT = [
    "【案件", "案件情報", "案件のご紹介", "案件ご紹介", "ご案件", "開発案件", "スキルチェック", "要員募集", "人材募集", "エンジニア募集", "SE.*急募", "エンジニア.*急募", "求人", "更改", "リニューアル",
    "リプレイス", "構築.*案件", "移行.*案件",
]
PROJECT_BODY = [
    "【案件情報】", "案件名[：:]", "必須スキル[：:]", "参画時期[：:]", "募集人数[：:]", r"単価[：:]\s*[0-9～〜]", "契約形態[：:]", "精算幅[：:]", "清算幅[：:]", "稼働開始[：:]", "就業場所[：:]",
    "作業場所[：:]", "勤務地[：:]", "商流[：:]", "管理ID[：:]", "ご提案をお待ち", "合う人材がいれば", "見合う方がいれば", "人材をお持ちであれば", "人材を探して", r"【商[\s　]*流】", r"【精[\s　]*算】",
    r"【人[\s　]*数】", r"【面[\s　]*談】", r"【期[\s　]*間】.*[0-9]{4}", "見合う要員", "ご提案いただけますと", "ご紹介いただけますと", "要員のご提案", "ご提案.*幸い", "案件のご紹介", "弊社案件",
    "ご紹介の案件", "要員をお探し", "ご要員がいれば", "ご提案いただける", "該当する方がいらっしゃいましたら", "ご検討いただける人材", "お力添えをいただけますか", "ご参画いただける方",
    "表記の件について、ご紹介いたします", "見合う方がおりましたらご提案", r"[＜<]\s*(?:案件名|案件概要|必須スキル|募集人数|作業場所|商流制限|面談回数)\s*[＞>]", "案件を(?:ご案内|ご紹介)",
    "エンジニア様?のご紹介をお待ち", "マッチするエンジニア", "【案件概要】", "案件情報を(?:展開|お送り|ご案内)",
]
PERSON_SUBJECT = [
    "【[^】]{0,10}人材", "★[^★】]{0,10}人材", "人材情報", "人材[ー－-]", "要員情報", "要員紹介", "技術者情報", "(?:弊社)?(?:正社員)?技術者の?ご紹介", "弊社技術者", r"自社\s*要員", "スキルシート", "経歴書",
    r"[0-9]{2}\s*歳(?!\s*(?:位|くらい|程度|前後)?\s*(?:まで|迄|以下|未満|以上|前後))", "案件(?:希望|のみ希望|を?探し|ご紹介くださ|をご紹介くださ)", "参画先(?:希望|募集)",
]
NO_PERSON_SUBJECT = [
    r"【\s*案件", "案件情報", "案件のご紹介", r"案件ご紹介\s*[】)）]", "必須スキル", r"【商\s*流】", "募集", "人月", "エンド直", "直案件", "元請け?直", "エンジニア様?のご紹介をお待ち", "見合う方がおりましたら",
]
NAME_LABEL = [r"(?:氏\s*名|お名前|ご氏名|名\s*前|要員番号|技術者番号|イニシャル)\s*[：:】]", r"【\s*(?:氏\s*名|名\s*前|お名前)\s*】"]
AGE, PERSON_LABEL = r"[0-9]{2}\s*歳", [r"(?:年\s*齢|単\s*価|希望単価|最寄\s*り?\s*駅|稼[働動]\s*開始)\s*[：:】]", r"【\s*(?:年\s*齢|単\s*価|最寄\s*り?\s*駅)\s*】"]
AGE_BOUND, OWN_LABEL = r"[0-9]{2}\s*歳\s*(?:位|くらい|程度|前後)?\s*(?:まで|迄|以下|未満|以上)", r"(?:年\s*齢|単\s*価|最寄\s*り?\s*駅)\s*[：:】]"
STRONG_SUBJECT = ["【案件", "案件情報", "案件のご紹介", "案件ご紹介", "開発案件"]
STRONG_BODY = [
    r"(?:案件名|必須スキル|募集人数|就業場所|勤務地|作業場所|参画時期|契約形態|商[\s　]*流|精[\s　]*算幅|清[\s　]*算幅)[　\s]*[：:]", r"【商[\s　]*流】|【精[\s　]*算】|【人[\s　]*数】|【案件",
    r"[＜<]\s*(?:案件名|案件概要|必須スキル|商流制限)\s*[＞>]",
]
DIRECT_SUBJECT = ["エンド直", "直案件", r"直\s*案件", "合う人材", "ご紹介をお待ち", "エンドユーザー.*直"]
WEAK_NAME, WEAK_PLACE = r"(?:氏\s*名|お名前|ご氏名)[　\s]*[：:]", r"最寄[　\s]*り?駅|最寄[　\s]*[：:]|所属[　\s]*[：:]|稼[働動][　\s]*[：:]"
WANTED_SUBJECT = ["案件", "要件", "募集", "参画", "依頼", "発注", "プロジェクト"]
#: Characters of a body, its tags and runs of blanks aside, that are looked at for projects, for the rest, and for people.
FIRST, SECOND, THIRD = 500, 1000, 4000


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def shown_text(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), "<[^>]*>", " "), r"[\s　\xa0]+", " "))


def person_in_subject(subject: Column) -> Column:
    """A subject that says it introduces a person, and nothing that only projects say."""
    return _any(subject, PERSON_SUBJECT) & ~_any(subject, NO_PERSON_SUBJECT)


def person_in_body(text: Column) -> Column:
    """A label of a name and a person's age, rate or station; an age that is only a bound is none."""
    bound = text.rlike(AGE_BOUND) & ~text.rlike(OWN_LABEL)
    return _any(text, NAME_LABEL) & _any(text, [AGE, *PERSON_LABEL]) & ~bound


def project_for_sure(subject: Column, text: Column) -> Column:
    return _any(subject, STRONG_SUBJECT) | _any(text, STRONG_BODY)


def mail_class(subject: Column, body: Column) -> Column:
    """candidate, project, skip or unknown, by the first of the rules that holds. Null counts as empty; a body may be HTML."""
    s, text = F.coalesce(subject, F.lit("")), shown_text(body)
    first, second, third = (F.substring(text, 1, n) for n in (FIRST, SECOND, THIRD))
    sure = project_for_sure(s, first)
    weak = second.rlike(WEAK_NAME) & second.rlike(WEAK_PLACE)
    hiring = _any(s, HIRING_SUBJECT)
    return first_rule(
        [
            ("candidate", person_in_body(third) & ~sure),
            ("skip", _any(s, SKIP_SUBJECT)),
            ("skip", _any(second, SKIP_BODY)),
            ("candidate", person_in_subject(s)),
            ("project", _any(s, DIRECT_SUBJECT)),
            ("candidate", weak & ~sure),
            ("project", _any(s, PROJECT_SUBJECT) | _any(first, PROJECT_BODY)),
            ("project", hiring & _any(s, WANTED_SUBJECT)),
            ("candidate", hiring),
        ],
        "unknown",
    )
