"""Keyed state with timers over several batches and restarts, and pages of a table, against what one pass over all rows gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import pages, states

START = datetime.datetime(2024, 1, 1)  # a Monday
HOUR = datetime.timedelta(hours=1)
SCHEMA = "k string, ts timestamp"


def add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def made(seed):
    """Times of three keys over two weeks, a file a day, shifted by less than three hours out of order; some repeat, some are null."""
    r = random.Random(seed)
    times = sorted((START + HOUR * r.random() * 336, r.choice("abc")) for _ in range(60))
    times = [(k, t.replace(microsecond=0)) for t, k in times] + [("z", START + HOUR * 400)]
    times.insert(20, times[20])
    order = sorted(times, key=lambda x: x[1] + HOUR * 2.9 * r.random())
    files = [order[i : i + 12] for i in range(0, len(order), 12)]
    files[2].append(("a", None))
    return times, files


def stalls_of(times, mark, silent=3, again=6):
    out = []
    for k in sorted({k for k, _ in times}):
        own = sorted(t for key, t in times if key == k and t <= mark)
        for t, after in zip(own, [*own[1:], None], strict=False):
            last, at = None, t.replace(minute=0, second=0)
            until = min(mark, after - datetime.timedelta(milliseconds=1)) if after else mark
            while (at := at + HOUR) <= until:
                local = at + 9 * HOUR
                due = at - t >= silent * HOUR if last is None else at - last >= again * HOUR
                if due and local.weekday() < 5 and 9 <= local.hour < 18:
                    out.append((k, at, t))
                    last = at
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_stalls_over_batches_and_a_restart(spark, tmp_path, seed):
    times, files = made(seed)
    source, state = str(tmp_path / "files"), str(tmp_path / "state")
    for rows in files[:3]:
        add(spark, source, rows)
    first = states.stalls(stream(spark, source), ["k"], "ts", "3 hours", state)
    seen = {(r.k, r.at, r.since) for r in first.collect()}
    for rows in files[3:]:
        add(spark, source, rows)
    got = sorted((r.k, r.at, r.since) for r in states.stalls(stream(spark, source), ["k"], "ts", "3 hours", state).collect())
    assert got == stalls_of(times, START + HOUR * 397) and seen < set(got) and len(seen) > 5


def test_forgotten_keys_are_new_again(spark, tmp_path):
    times, files = made(3)
    source, state = str(tmp_path / "files"), str(tmp_path / "state")
    for i, rows in enumerate(files):
        add(spark, source, rows)
        if i % 2 or i == len(files) - 1:
            got = states.new_keys(stream(spark, source), ["k"], "ts", "3 hours", 1, state)
    want = []
    for k in "abc":
        own = sorted(t for key, t in times if key == k)
        want += [(k, t) for before, t in zip([None, *own], own, strict=False) if before is None or t - before > 24 * HOUR]
    assert sorted((r.k, r.at) for r in got.collect()) == sorted(want)


def test_rows_that_the_watermark_has_passed_do_not_wait_for_later_ones(spark, tmp_path):
    source = str(tmp_path / "files")
    add(spark, source, [("a", START), ("a", START + 50 * HOUR), ("a", START + 99 * HOUR), ("b", START + 100 * HOUR)])
    got = states.new_keys(stream(spark, source), ["k"], "ts", "3 hours", 1, str(tmp_path / "state"))
    assert sorted((r.k, r.at) for r in got.collect()) == [("a", START), ("a", START + 50 * HOUR)]


def test_pages_stop_and_go_on(spark, tmp_path):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    rows = [(i, START + HOUR * (i * 7 % 50)) for i in range(105)] + [(None, START), (500, None)]
    spark.createDataFrame(rows, "id long, ts timestamp").repartition(4).write.parquet(table)
    want = [i for t, i in sorted((t, i) for i, t in rows if t and i is not None)]
    source = lambda: pages.paged(spark, table, "id long, ts timestamp", "ts", "id", 10)
    seen = {}

    def write(page, number):
        if number == 4 and 4 not in seen:
            seen[4] = None
            raise RuntimeError("stopped here")
        seen[number] = [r.id for r in page.orderBy("ts", "id").collect()]

    with pytest.raises(Exception, match="stopped here"):
        pages.read_all(source(), state, write)
    assert [seen[i] for i in range(4)] == [want[i : i + 10] for i in range(0, 40, 10)]
    pages.read_all(source(), state, write)
    assert [len(seen[i]) for i in sorted(seen)] == [10] * 10 + [5] and [x for i in sorted(seen) for x in seen[i]] == want
    spark.createDataFrame([(900, START + HOUR * 900)], "id long, ts timestamp").write.mode("append").parquet(table)
    pages.read_all(source(), state, write)
    assert seen[11] == [900]
    assert pages._Reader({"path": table, "time": "ts", "key": "id", "limit": "1000"}, spark.read.parquet(table).schema).read({"at": None, "key": None, "done": False})[1]["done"]


def test_a_batch_holds_many_pages(spark, tmp_path):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    rows = [(i, START + HOUR * (i * 7 % 50)) for i in range(105)] + [(None, START), (500, None)]
    spark.createDataFrame(rows, "id long, ts timestamp").repartition(4).write.parquet(table)
    want = [i for t, i in sorted((t, i) for i, t in rows if t and i is not None)]
    source = lambda: spark.readStream.schema("id long, ts timestamp").parquet(table)
    read = lambda: [(r.page, r.id) for r in pages.in_pages(source(), "ts", "id", state, 10).orderBy("page", "ts", "id").collect()]
    assert read() == [(k // 10, i) for k, i in enumerate(want)]
    spark.createDataFrame([(900, START + HOUR * 900), (901, START)], "id long, ts timestamp").write.mode("append").parquet(table)
    assert read() == [(k // 10, i) for k, i in enumerate(want)] + [(11, 901), (11, 900)] == read()


def test_pages_of_many_rows_take_one_batch(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "timestamp_seconds(1700000000 + id * 7919 % 200000) AS ts").repartition(3).write.parquet(str(tmp_path / "table"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "table"))
    got = pages.in_pages(stream, "ts", "id", str(tmp_path / "state"))  # 667 pages: one by one, as many batches
    assert got.groupBy("page").count().selectExpr("count(*)", "min(count)", "sum(count)", "max(page)").first() == (667, 200, 200_000, 666)
    assert len(list((tmp_path / "state" / "rows").glob("batch_=*"))) == 1


def test_many_keys_over_batches(spark, tmp_path):
    """State is a table that batches join natively, of which the last few batches' alone is kept; key by key, 120,000 calls were made here."""
    source, state = str(tmp_path / "files"), str(tmp_path / "state")
    for i in range(5):
        spark.range(30_000).selectExpr("concat('k', id) AS k", f"timestamp_seconds(1704067200 + {i * 2 * 86400} + id % 3600) AS ts").where(f"id % 2 = 0 or {i} in (0, 4)").coalesce(1).write.mode("append").parquet(source)
    got = states.new_keys(stream(spark, source), ["k"], "ts", "1 minute", 3, state)
    mark = 8 * 86400 + 3599 - 60  # odd keys are forgotten after the first batch, and come again in the last one, as far as the watermark goes
    again = sum(i % 2 == 1 and 8 * 86400 + i % 3600 <= mark for i in range(30_000))
    assert got.count() == 30_000 + again and got.where("k = 'k1'").count() == 2 and got.where("k = 'k2'").count() == 1
    assert len(list((tmp_path / "state" / "state").iterdir())) == states.TURNS
