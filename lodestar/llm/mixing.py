"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, set_aside, table

#: Weights that the sources get in turn, the mix's size as a share of all sizes, and copies of a document at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that one step of the reduction tree pairs one after another, on average.
BLOCK = 64
#: A document of more than a share of 1/HEAVY of its source is settled before the others, which then make up for it.
HEAVY = 200
#: Rows of one doc_id, source and size that a task numbers.
NUMBERED = 10_000
#: Up to so many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Documents (16 bytes each) that the pipeline's stage broadcasts at most.
BROADCAST_DOCS = 500_000
SEED = 20240817


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, n, target.

    With the sources in order of most * size / weight, those that reach their limit come first: a source does if
    its limit is within what is left for it. One row a source meets in one window, never a row a document.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn))
    s = s.withColumn("cap", most * F.col("source_size"))
    every, order = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = share * F.sum("source_size").over(every)
    left = total - F.sum("cap").over(order) + F.col("cap")
    weight_left = F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight")
    s = s.withColumn("full", F.col("cap") * weight_left <= F.col("weight") * left)
    rest = total - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return s.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest / rest_weight).alias("target"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def pivotal(items: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs the documents of each block, one after another; a row for each block: settled (array) and left (struct).

    A pair's probabilities a and b with sizes s and t move along a*s + b*t = constant, up or down at random so that
    neither changes on average, until one is 0 or 1; that one is settled and the other meets the next document.
    """
    block = F.sort_array(F.collect_list(F.struct("draw", "doc_id", "size", "source", "whole", "p", "source_size", "target")))
    head = F.element_at("items", 1)

    def settle(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["source"].alias("source"), (x["whole"] + p).cast("long").alias("copies"), x["source_size"].alias("source_size"), x["target"].alias("target"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("draw", "doc_id", "size", "source", "whole")), p.alias("p"), x["source_size"].alias("source_size"), x["target"].alias("target"))

    def merge(acc: Column, x: Column) -> Column:
        r = acc["left"]
        a, b, s, t = r["p"], x["p"], r["size"].cast("double"), x["size"].cast("double")
        up, down = F.least((1 - a) * s, b * t), F.least(a * s, (1 - b) * t)
        u = F.pmod(F.xxhash64(r["draw"], x["draw"], F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)

        def moved(m: Column) -> Column:
            def fits(room: Column, d: Column) -> Column:
                return room <= d

            d = m["d"]
            new_a = F.when(m["rise"], F.when(fits((1 - a) * s, d), F.lit(1.0)).otherwise(a + d / s)).otherwise(F.when(fits(a * s, d), F.lit(0.0)).otherwise(a - d / s))
            new_b = F.when(m["rise"], F.when(fits(b * t, d), F.lit(0.0)).otherwise(b - d / t)).otherwise(F.when(fits((1 - b) * t, d), F.lit(1.0)).otherwise(b + d / t))
            return F.struct(new_a.alias("a"), new_b.alias("b"))

        def choose(q: Column) -> Column:
            done_a = (q["a"] == 0) | (q["a"] == 1)
            out = F.when(done_a, settle(r, q["a"])).otherwise(settle(x, q["b"]))
            stay = F.when(done_a, with_p(x, q["b"])).otherwise(with_p(r, q["a"]))
            return F.struct(F.concat(acc["settled"], F.array(out)).alias("settled"), stay.alias("left"))

        step = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.struct((u * (m["up"] + m["down"]) < m["down"]).alias("rise"), m["up"].alias("up"), m["down"].alias("down")))
        step = _let(step, lambda m: F.struct(m["rise"].alias("rise"), F.when(m["rise"], m["up"]).otherwise(m["down"]).alias("d")))
        return _let(_let(step, moved), choose)

    none = F.filter(F.transform("items", lambda x: settle(x, F.lit(0.0))), lambda x: F.lit(False))
    start = F.struct(none.alias("settled"), with_p(head, head["p"]).alias("left"))
    folded = F.aggregate(F.slice("items", 2, F.size("items")), start, merge)
    return items.groupBy(*keys).agg(block.alias("items")).select(*keys, folded.alias("f")).select(*keys, "f.settled", "f.left")


def rounded(scratch: Scratch, items: DataFrame, n: DataFrame, name: str) -> list[DataFrame]:
    """Settles every document of every source by a tree of blocks; n: source and its number of items.

    The last document of a source rounds at random. Each level is written, as it is read twice.
    """
    done, level = [], 0
    counts = scratch.put(n, f"{name}-n")
    most = counts.agg(F.max("n")).first()[0] or 0
    small = F.broadcast(counts) if counts.count() <= BROADCAST_SOURCES else counts
    current = items.alias("i").join(small.alias("n"), F.col("i.source").eqNullSafe(F.col("n.source"))).select("i.*", F.ceil(F.col("n.n") / BLOCK).alias("blocks"))
    while True:
        block = F.pmod(F.xxhash64("draw", "doc_id", F.lit(level)), F.greatest("blocks", F.lit(1)))
        folded = scratch.put(pivotal(current.withColumn("block", block).withColumn("of", F.col("source")), ["of", "blocks", "block"]), f"{name}-{level}")
        done.append(folded.select(F.explode("settled").alias("x")).select("x.*"))
        last, most = most <= BLOCK, -(-most // BLOCK)
        over = folded.select(F.ceil(F.col("blocks") / BLOCK).alias("blocks"), "left.*")
        if last:
            lucky = F.pmod(F.xxhash64("draw", F.lit(SEED + 1)), F.lit(1 << 40)) / float(1 << 40) < F.col("p")
            done.append(over.select("doc_id", "size", "source", (F.col("whole") + lucky.cast("int")).cast("long").alias("copies"), "source_size", "target"))
            return done
        current, level = over, level + 1


def numbered(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size of each row and row, its number among those that agree in all three; they are counted, not gathered."""
    keys = ["doc_id", "source", "size"]
    counts = sizes.groupBy(*keys).agg(F.count("*").alias("rows"))
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / NUMBERED)))).repartition(*keys, "part")
    numbers = F.sequence(F.col("part") * NUMBERED, F.least(F.col("rows"), (F.col("part") + 1) * NUMBERED) - 1)
    return parts.select(*keys, F.explode(numbers).alias("row"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """How often each document enters the mix: doc_id, size, source_size, target, copies, taken = copies * size.

    size counts the words `[^\\x20\\x09-\\x0D]+` of the text, 0 for null. copies is the whole part of target /
    source_size plus a rounded rest, so that a source's taken words differ from its target by one document's words
    at most, and by 1/HEAVY where smaller documents can make up for a large one. The draws are hashes of
    the seed, doc_id and size: reruns agree. Documents without words are taken no times. Rows that repeat
    a doc_id, or have none, are documents of their own: those that agree in source and size too are numbered and also drawn by
    their numbers, so that no block gets them all. A null source is a source, the last one. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = scratch.put(docs.select("doc_id", "source", size.alias("size")), "sizes")
    tied = not sizes.groupBy("doc_id").count().where("count > 1").isEmpty()
    if tied:
        sizes = scratch.put(numbered(sizes), "numbered")
    targets = scratch.put(source_targets(sizes, weights, share, most), "targets")
    small = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    d = sizes.alias("d").join(small.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    d = d.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size", *(["row"] if tied else []))).withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    none = (F.col("size") == 0) | (F.col("p") == 0)
    settled = d.where(none).select("doc_id", "size", "source", F.when(F.col("size") == 0, 0).otherwise(F.col("whole")).cast("long").alias("copies"), "source_size", "target")
    d, heavy = d.where(~none), F.col("size") * HEAVY > F.greatest("target", "source_size")
    large = d.where(heavy)
    parts = rounded(scratch, large, large.groupBy("source").agg(F.count("*").alias("n")), "large")
    taken = scratch.put(_union(parts).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("large_taken"), F.sum("size").alias("large_size")), "large-taken")
    light = d.where(~heavy).alias("d").join(F.broadcast(taken).alias("k") if taken.count() <= BROADCAST_SOURCES else taken.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")), "left").select("d.*", "k.large_taken", "k.large_size")
    again = (F.col("target") - F.coalesce("large_taken", F.lit(0))) / (F.col("source_size") - F.coalesce("large_size", F.lit(0)))
    again = F.least(F.greatest(again, F.lit(0.0)), F.lit(most))
    light = light.withColumn("whole", F.floor(again)).withColumn("p", again - F.floor(again)).drop("large_taken", "large_size")
    settled = settled.unionByName(light.where("p = 0").select("doc_id", "size", "source", F.col("whole").cast("long").alias("copies"), "source_size", "target"))
    light = light.where("p != 0")
    parts += rounded(scratch, light, light.groupBy("source").agg(F.count("*").alias("n")), "light")
    out = settled.unionByName(_union(parts))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it.

    Where doc_ids repeat, rows are told apart by a 128-bit hash of all their columns and drawn by it; rows that agree in
    every column are drawn one by one and enter as often as they are taken together. A null doc_id is one like any other.
    """
    scratch, names = Scratch(spark, "taken"), [f"mix_{c}" for c in ("id", "high", "low")]
    columns, (docs, back) = docs.columns, set_aside(docs, (*names, "mix_copies", "mix_rows", "mix_copy"))
    tied = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    parts = [F.col(f"`{c}`") for c in docs.columns]
    parts += [c.isNull() for c in parts]  # hashes leave nulls out
    # Nulls add nothing to a draw's hash: without repeats the draws are those of doc_id alone.
    high, low = (F.xxhash64(F.lit(SEED + i), *parts) if tied else F.lit(None).cast("long") for i in range(2))
    keyed = docs.withColumns(dict(zip(names, (F.col("doc_id"), high, low), strict=True)))
    taken = mix(keyed.select(F.struct(*names).alias("doc_id"), "source", "text"))
    taken = taken.groupBy("doc_id").agg(F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")).where("mix_copies > 0")
    taken = scratch.put(taken.select("doc_id.*", "mix_copies", "mix_rows"), "copies")
    small = F.broadcast(taken) if taken.count() <= BROADCAST_DOCS else taken
    same = [F.col(f"d.{n}").eqNullSafe(F.col(f"t.{n}")) for n in (names if tied else names[:1])]
    out = keyed.alias("d").join(small.alias("t"), same).select("d.*", "t.mix_copies", "t.mix_rows")
    if tied:
        out = out.where("mix_rows = 1").unionByName(out.where("mix_rows > 1").dropDuplicates(names))
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)
    return back(out).select(*columns)
