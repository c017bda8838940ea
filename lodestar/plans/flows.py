"""Streams, sources and names over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import names, roles
from lodestar.operators import entities, skills
from lodestar.sources import records
from lodestar.streaming import batches, pages, states

from .staffing import PEOPLE, PROJECTS, ROLES, people, projects
from .tables import table


#: Files of a batch, where it is to hold all that there are.
ALL_FILES = 2**31 - 1


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    return batches.daily_counts(batches.events_stream(spark, d), batches.folder(spark, "daily"))


def stream_first(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of user and type, once each; the watermark is longer than the data."""
    seen = batches.first_of_each(batches.events_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days", batches.folder(spark, "first"))
    return seen.groupBy("event_type").agg(F.count("*").alias("users"))


def stream_marks(spark: SparkSession, d: str) -> DataFrame:
    """Two watch rules on events; each (rule, user) is marked once."""
    rules = spark.createDataFrame([(1, "error", 50.0), (2, "purchase", 90.0)], "rule long, event_type string, least double")

    def matches(batch: DataFrame) -> DataFrame:
        return batch.join(F.broadcast(rules), "event_type").where(F.col("value") >= F.col("least")).select("rule", "user_id")

    return batches.marked_once(batches.events_stream(spark, d), matches, ["rule", "user_id"], batches.folder(spark, "marks"))


def _arriving(spark: SparkSession, d: str, name: str) -> DataFrame:
    return batches.arriving(table(spark, d, "events"), batches.folder(spark, f"{name}-files"), "ts", 3)


def stream_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """Totals computed anew after each of three batches."""
    compute = lambda: table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    out, runs = batches.recomputed_on_arrival(_arriving(spark, d, "recomputed"), compute, batches.folder(spark, "recomputed"))
    return out.withColumn("runs", F.lit(runs).cast("long"))


def stream_archived(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("ts").cast("timestamp") < F.to_timestamp(F.lit("2024-01-15"))
    parts = batches.archived(_arriving(spark, d, "archived"), old, batches.folder(spark, "archived"))
    counted = [df.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for df, name in zip(parts, ("archive", "live"), strict=True)]
    return counted[0].unionByName(counted[1])


def stall_alerts(spark: SparkSession, d: str) -> DataFrame:
    a = batches.stall_alerts(table(spark, d, "events"), "user_id", "ts")
    return a.select("user_id", F.date_format("at", "yyyy-MM-dd HH").alias("at"), F.date_format("since", "yyyy-MM-dd HH:mm").alias("since"))


def stream_stalls(spark: SparkSession, d: str) -> DataFrame:
    """Alerts about silent users, business hours of Japan, by a stream of three batches; they are repeated after six hours."""
    a = states.stalls(_arriving(spark, d, "stalls"), ["user_id"], "ts", "1 hour", batches.folder(spark, "stalls"))
    return a.select("user_id", F.date_format("at", "yyyy-MM-dd HH").alias("at"), F.date_format("since", "yyyy-MM-dd HH:mm").alias("since"))


def stream_new_again(spark: SparkSession, d: str) -> DataFrame:
    """Users' first events of a type, and those after three days without one, by state that is dropped meanwhile."""
    n = states.new_keys(_arriving(spark, d, "new-keys"), ["user_id", "event_type"], "ts", "1 hour", 3, batches.folder(spark, "new-keys"))
    return n.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def stream_marks_again(spark: SparkSession, d: str) -> DataFrame:
    """Marks of two watch rules that lapse when a rule has not been met by a user for seven days."""
    rules = spark.createDataFrame([(1, "error", 50.0), (2, "purchase", 90.0)], "rule long, event_type string, least double")
    met = _arriving(spark, d, "marks-again").join(F.broadcast(rules), "event_type").where(F.col("value") >= F.col("least"))
    marks = states.new_keys(met, ["rule", "user_id"], "ts", "1 hour", 7, batches.folder(spark, "marks-again"))
    return marks.select("rule", "user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """Events in pages of 300, the oldest first."""
    stream = batches.events_stream(spark, d, ALL_FILES).select("event_id", "ts", "event_type")
    rows = pages.in_pages(stream, "ts", "event_id", batches.folder(spark, "pages"))
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first"), F.max_by("event_id", F.struct("ts", -F.col("event_id"))).alias("last"), F.sum("event_id").alias("ids"))


def new_again(spark: SparkSession, d: str) -> DataFrame:
    return batches.counted_as_new(table(spark, d, "events"), ["user_id", "event_type"], "ts", 3).groupBy("event_type").agg(F.count("*").alias("n"))


def silences(spark: SparkSession, d: str) -> DataFrame:
    s = batches.silences(table(spark, d, "events"), ["event_type"], "ts", 1.5)
    return s.groupBy("event_type").agg(F.count("*").alias("n"), F.date_format(F.max("until"), "yyyy-MM-dd HH:mm").alias("last"))


def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON lines of several days and read again, the last line of each customer counting."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy").alias("year"))
    path = batches.folder(spark, "lines")
    for turn, part in enumerate((F.col("year") < "1995", F.col("year") >= "1995")):
        once = o.where(part).groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("r")).select("o_custkey", "r.*")
        once.write.mode("append").json(f"{path}/{turn}")
    schema = once.schema
    first, second = (records.read_latest(spark, f"{path}/{i}", schema, "o_custkey") for i in (0, 1))
    return records.upserted(first, second, ["o_custkey"])


def company_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "株式会社 ").otherwise(""), F.lit("ＡＢ・"), (F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "有限会社").otherwise("")).alias("name"))
    return c.groupBy(names.company_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.min(names.person_code(F.col("c_custkey"))).alias("first"))


def role_fit(spark: SparkSession, d: str) -> DataFrame:
    """How well people's roles fit what the projects of their nation ask for."""
    # Both sides are counted before they meet: pairs of people and projects aren't made.
    p = people(spark, d).groupBy(F.col("home").alias("work"), "role", "role_level").agg(F.count("*").alias("people"))
    q = projects(spark, d).groupBy("work", "required_role").agg(F.count("*").alias("projects"))
    pairs = q.join(p, "work").groupBy("required_role", "role", "role_level").agg(F.sum(F.col("people") * F.col("projects")).alias("n"))
    g = roles.with_affinity(pairs, spark).groupBy("required_role", "role", "role_level", "affinity").agg(F.sum("n").alias("n"))
    return g.select("required_role", "role", "role_level", F.round("affinity", 4).alias("affinity"), "n")


def unseen(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.concat("o_orderstatus", F.lit("|"), F.date_format("o_orderdate", "yyyy-MM")).alias("m"))
    return entities.greedy_unseen(o, "o_custkey", [F.col("o_orderpriority"), F.col("m")], F.col("o_orderkey")).select("o_custkey", "o_orderkey")


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """A number for every customer in order of nation and key: counts of the ranges before, and a number within each; no global window over rows."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    sizes = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("c_nationkey").rowsBetween(W.unboundedPreceding, -1))
    offsets = skills.small(sizes.select("c_nationkey", F.coalesce(before, F.lit(0)).alias("before")))
    return c.join(offsets, "c_nationkey").select("c_custkey", (F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + F.col("before")).alias("number"))


def merged_people(spark: SparkSession, d: str) -> DataFrame:
    """New values over old ones, null leaving the old one."""
    o = table(spark, d, "orders")
    old, new = (o.where(p).groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"), F.max(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))).alias("s")) for p in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"))
    j = old.alias("o").join(new.alias("n"), "o_custkey")
    return j.select("o_custkey", *entities.merged("o", "n", ["k", "s"]))


#: Times in milliseconds, the watermark, and the hours of business in Japan with the next one from each hour on.
WATERMARK = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms, max(epoch_us(ts) // 1000) OVER () - 3600000 AS mark FROM events)"
QUERIES = {
    "stream_stalls": (stream_stalls, f"""WITH RECURSIVE {WATERMARK},
h AS (SELECT h, (h + 9) % 24 BETWEEN 9 AND 17 AND ((h + 9) // 24 + 3) % 7 < 5 AS works FROM (SELECT unnest(range(min(ms) // 3600000, max(ms) // 3600000 + 240)) AS h FROM e)),
nb AS MATERIALIZED (SELECT h, min(CASE WHEN works THEN h END) OVER (ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM h),
s AS MATERIALIZED (SELECT user_id, ms, least(coalesce(lead(ms) OVER (PARTITION BY user_id ORDER BY ms) - 1, mark), mark) AS until FROM e WHERE ms <= mark),
a(user_id, ms, until, hr) AS (SELECT user_id, ms, until, n FROM s JOIN nb ON h = (ms + 3599999) // 3600000 + 3 WHERE n * 3600000 <= until
  UNION ALL SELECT user_id, ms, until, n FROM a JOIN nb ON h = a.hr + 6 WHERE n * 3600000 <= until)
SELECT user_id, strftime(make_timestamp(hr * 3600000000), '%Y-%m-%d %H') AS at, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M') AS since FROM a"""),
    "stream_new_again": (stream_new_again, f"""WITH {WATERMARK}, b AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms) AS gap FROM e WHERE ms <= mark)
SELECT user_id, event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM b WHERE gap IS NULL OR gap > 259200000 GROUP BY 1, 2"""),
    "stream_marks_again": (stream_marks_again, """WITH m AS (SELECT CASE event_type WHEN 'error' THEN 1 ELSE 2 END::BIGINT AS rule, user_id, ts, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'error' AND value >= 50 OR event_type = 'purchase' AND value >= 90),
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY rule, user_id ORDER BY ms) AS gap FROM m WHERE ms <= (SELECT max(ms) FROM m) - 3600000)
SELECT rule, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM g WHERE gap IS NULL OR gap > 604800000"""),
    "stream_pages": (stream_pages, "SELECT page, count(*) AS n, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS last, sum(event_id)::BIGINT AS ids FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 300 AS page FROM events) GROUP BY 1"),
    "stream_daily": (stream_daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_first": (stream_first, "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "stream_marks": (stream_marks, "SELECT DISTINCT rule, user_id FROM events JOIN (VALUES (1::BIGINT, 'error', 50.0), (2, 'purchase', 90.0)) v(rule, t, least) ON event_type = t AND value >= least"),
    "silences": (silences, "SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS l FROM events) WHERE floor(epoch(ts)) - floor(epoch(l)) > 5400 GROUP BY 1"),
    "stream_recomputed": (stream_recomputed, "SELECT event_type, count(*) AS n, 3::BIGINT AS runs FROM events GROUP BY 1"),
    "stream_archived": (stream_archived, "SELECT event_type, count(*) AS n, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'archive' ELSE 'live' END AS part FROM events GROUP BY ALL"),
    "stall_alerts": (stall_alerts, """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), g AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM e),
c AS (SELECT user_id, s, unnest(range(s // 3600 + 3, (n - 1) // 3600 + 1)) AS h, n FROM g WHERE n - s >= 10800), d AS (SELECT * FROM c WHERE h * 3600 - s >= 10800 AND h * 3600 < n AND h % 24 >= 9 AND h % 24 < 18),
f AS (SELECT *, min(h) OVER (PARTITION BY user_id, s) AS f FROM d) SELECT user_id, strftime(make_timestamp(h * 3600000000), '%Y-%m-%d %H') AS "at", strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M') AS since FROM f WHERE (h - f) % 6 = 0"""),
    "new_again": (new_again, "SELECT event_type, count(*) AS n FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS l FROM events) WHERE l IS NULL OR ts - l > INTERVAL 3 DAYS GROUP BY 1"),
    "latest_lines": (latest_lines, "SELECT o_custkey, max(CASE WHEN y THEN o_orderkey END) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM (SELECT *, CASE WHEN max(o_orderdate >= TIMESTAMP '1995-01-01') OVER (PARTITION BY o_custkey) THEN o_orderdate >= TIMESTAMP '1995-01-01' ELSE true END AS y FROM orders) WHERE y GROUP BY 1"),
    "company_keys": (company_keys, "SELECT 'ab' || (c_custkey % 40) AS key, count(*) AS n, 'AK-' || lpad(CAST(min(c_custkey) AS VARCHAR), 5, '0') AS first FROM customer GROUP BY c_custkey % 40"),
    "role_fit": (role_fit, f"""WITH {PEOPLE}, {PROJECTS}, {ROLES}
SELECT required_role, role, role_level, round(CASE WHEN required_role IS NULL OR role IS NULL THEN 0.5 WHEN required_role = role THEN 1 ELSE affinity END, 4) AS affinity, count(*) AS n
FROM pr JOIN pe ON home = work LEFT JOIN af USING (required_role, role, role_level) GROUP BY ALL"""),
    "unseen": (unseen, """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m') AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
w AS (SELECT o_custkey, k, o_orderkey, [p] AS ps, [m] AS ms, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.o_custkey, o.k, o.o_orderkey, CASE WHEN list_contains(ps, p) OR list_contains(ms, m) THEN ps ELSE list_append(ps, p) END,
  CASE WHEN list_contains(ps, p) OR list_contains(ms, m) THEN ms ELSE list_append(ms, m) END, NOT (list_contains(ps, p) OR list_contains(ms, m)) FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.k = w.k + 1)
SELECT o_custkey, o_orderkey FROM w WHERE kept"""),
    "numbered": (numbered, "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS number FROM customer"),
    "merged_people": (merged_people, "WITH x AS (SELECT o_custkey, o_orderkey % 2 AS p, max(o_orderkey) AS k, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END) AS s FROM orders GROUP BY 1, 2) SELECT o_custkey, coalesce(n.k, o.k) AS k, coalesce(n.s, o.s) AS s FROM x o JOIN x n USING (o_custkey) WHERE o.p = 0 AND n.p = 1"),
}
