"""Similarity join of word n-gram sets, with block-skipped index lists and answers derived from similar sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DARK, Powers, Scratch, mixed, pieces, set_aside, shingle_hashes, table, tidy, utf8, word_hashes
from .components import connected_components

#: Counters of the sketch by which shingles are ordered: one for so many bytes of texts, and of a task's input, within bounds.
#: A task sends its counters, two bytes each: an eighth of its input at most, however many tasks there are.
TEXT_BYTES, TASK_BYTES, SKETCH_LOG2_MIN, SKETCH_LOG2_MAX = 400, 16, 12, 24
#: A list of up to so many sets gives pairs; the sets of a longer one are joined as a family.
SHORT = 32
#: Entries of a list that are skipped together.
SKIP = 8
#: Hashes in one block of a family; a task holds two blocks.
BLOCK_TOKENS = 1 << 20
#: Rows that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 500_000
#: Bits of a shingle's hash that are kept, of which the last ones stay beside the order when sorting.
BITS, TAIL = 52, 42
MASK, TAIL_MASK = np.uint64((1 << BITS) - 1), np.uint64((1 << TAIL) - 1)
#: A set's bitmap has at least so many bits, and at least one for two of its shingles; a power of 2.
BITMAP = 512


def sets_of(batch_text: pa.Array, k: int, powers: Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each piece: first and last row; the distinct k-word shingles of each text as sorted 52-bit hashes; where each text's start."""
    data, at = utf8(batch_text)
    for a, b in pieces(at):
        words, first = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], DARK, powers)
        n = np.diff(first)
        runs = shingle_hashes(words, k) & MASK
        text = np.repeat(np.arange(b - a), n)
        inside = np.arange(len(runs)) + k <= first[1:][text[: len(runs)]]
        runs, of = runs[inside], text[: len(runs)][inside]
        for t in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence as one
            h = words[first[t]]
            for w in words[first[t] + 1 : first[t + 1]]:
                h = mixed(np.array([h]) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
            runs, of = np.append(runs, mixed(np.array([h + np.uint64(n[t])]))[0] & MASK), np.append(of, t)
        yield a, b, *_distinct(runs, of, b - a)


def _distinct(runs: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= 1 << 12:
        key = np.sort((of.astype(np.uint64) << np.uint64(BITS)) | runs)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        return key & MASK, np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS)) if n < 1 << 12 else np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << np.uint64(BITS)), len(key))
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    new = np.concatenate([[True], (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])]) if len(runs) else np.empty(0, bool)
    return runs[new], np.searchsorted(of[new], np.arange(n + 1))


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


def describe(docs: DataFrame, k: int, sketch_bits: int) -> DataFrame:
    """A row for each text: doc_id, n (size of its set), hi and lo (which set it is), bitmap; and each task's counters, by part."""
    part = min(1 << 14, 1 << sketch_bits)

    def run(batches):
        powers, counters = Powers(), np.zeros(1 << sketch_bits, np.uint32)
        names = ["doc_id", "n", "hi", "lo", "bitmap", "part", "counters"]
        for batch in batches:
            rows = batch.num_rows
            n, ids, bitmaps, lengths = np.zeros(rows, np.int32), np.zeros((rows, 2), np.int64), [], [np.zeros(1, np.int64)]
            for a, b, tokens, first in sets_of(batch.column(1), k, powers):
                n[a:b] = np.diff(first)
                np.add.at(counters, (tokens >> np.uint64(BITS - sketch_bits)).astype(np.int64), 1)
                bits = BITMAP << np.ceil(np.log2(np.maximum(n[a:b] / 2, BITMAP) / BITMAP)).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(bits)])
                text = np.repeat(np.arange(b - a), n[a:b])
                odd = np.bincount(begin[text] + (tokens.astype(np.int64) & (bits[text] - 1)), minlength=begin[-1]) & 1
                bitmaps.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
                lengths.append(bits // 64)
                for t in range(b - a):
                    ids[a + t] = _identity(tokens[first[t] : first[t + 1]])
            lists = pa.ListArray.from_arrays(np.cumsum(np.concatenate(lengths)).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *bitmaps])))
            nothing = pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), lists, *nothing], names=names)
        cut = counters.reshape(-1, part)
        some = np.flatnonzero(cut.any(axis=1))
        for i in some:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))), pa.array([i], pa.int32()), pa.array([np.minimum(cut[i], 65535).astype(np.uint16).tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n int, hi long, lo long, bitmap array<long>, part int, counters binary")


def rarity(described: DataFrame, sketch_bits: int) -> np.ndarray:
    """For each counter, a level from 0 to 1023 by how often its shingles are in the corpus; their size is fixed by sketch_bits."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.uint16).astype(np.int64)
        for part, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(np.log2(n + 1.0) * 24, 1023).astype(np.uint16).tobytes()], pa.binary())], names=["part", "levels"])

    parts = described.where("part is not null").select("part", "counters").repartition("part").mapInArrow(tidy(add), "part int, levels binary").collect()
    size = min(1 << 14, 1 << sketch_bits)
    out = np.zeros(1 << sketch_bits, np.uint16)
    for r in parts:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["levels"], np.uint16)
    return out


def sketch_bits(text_bytes: int, task_bytes: str) -> int:
    """task_bytes: a size as Spark's settings have it, as 128m or 134217728b."""
    number, unit = re.fullmatch(r"([0-9]+)\s*([kmgt]?)i?b?", task_bytes.strip().lower()).groups()
    task = int(number) * 1024 ** " kmgt".index(unit or " ")
    return int(min(SKETCH_LOG2_MAX, max(SKETCH_LOG2_MIN, min(np.log2(text_bytes / TEXT_BYTES + 1), np.log2(task / TASK_BYTES)))))


def least_overlap(n, m, num: int, den: int):
    """Of sets of n and m elements, the smallest intersection with den * intersection >= num * union."""
    return -(-num * (n + m) // (den + num))


def prefixes(docs: DataFrame, k: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """Index entries: token, hi, lo, n, pos of the rarest shingles of each set, as many as two linked sets can't both lack."""
    bits = int(np.log2(len(levels)))
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        powers, seen = Powers(), set()
        for batch in batches:
            out = []
            for a, b, tokens, first in sets_of(batch.column(0), k, powers):
                n = np.diff(first)
                text = np.repeat(np.arange(b - a), n)
                level = sent.value[(tokens >> np.uint64(BITS - bits)).astype(np.int64)].astype(np.uint64)
                low = (level << np.uint64(TAIL)) | (tokens & TAIL_MASK)
                if b - a < 1 << 12:
                    low = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | low) & MASK
                else:
                    low = low[np.lexsort((low, text))]
                pos = np.arange(len(low)) - first[text]
                keep = pos < (n + (num * n) // -den + 1)[text]
                ids = np.array([_identity(tokens[first[t] : first[t + 1]]) for t in range(b - a)], np.int64).reshape(-1, 2)
                new = np.zeros(b - a, bool)
                for t, key in enumerate(map(tuple, ids.tolist())):
                    if n[t] and key not in seen:
                        seen.add(key)
                        new[t] = True
                keep &= new[text]
                of = text[keep]
                out.append((low[keep].astype(np.int64), ids[of, 0], ids[of, 1], n[of].astype(np.int32), pos[keep].astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["token", "hi", "lo", "n", "pos"])

    return docs.select("text").mapInArrow(tidy(run), "token long, hi long, lo long, n int, pos int")


def list_pairs(e: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, int]:
    """Pairs of sets that may link (ahi, alo, bhi, blo, na, nb, 0), blocks that were looked at, and how many of these were skipped.

    e: rows of token, n, hi, lo, pos, sorted, of whole lists without repeated sets. A list is cut into blocks of SKIP entries,
    each with its least size, greatest place and most shingles behind a place. A set is held against a block first: if
    even a set with all of these could not share enough with it, none of the block's entries is looked at.
    """
    if not len(e):
        return np.empty((0, 7), np.int64), 0, 0
    token, n, pos = e[:, 0], e[:, 1], e[:, 4]
    rest = n - pos - 1
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(starts, len(e)))
    blocks = -(-sizes // SKIP)
    first_block = np.cumsum(blocks) - blocks
    first = np.repeat(starts - first_block * SKIP, blocks) + np.arange(blocks.sum()) * SKIP
    end = np.minimum(first + SKIP, np.repeat(starts + sizes, blocks))
    least_n, most_pos, most_rest = n[first], np.maximum.reduceat(pos, first), np.maximum.reduceat(rest, first)
    last_block = np.repeat(first_block + blocks - 1, sizes)
    own = np.repeat(first_block, sizes) + (np.arange(len(e)) - np.repeat(starts, sizes)) // SKIP
    many = last_block - own + 1
    x = np.repeat(np.arange(len(e)), many)
    block = np.repeat(own - np.cumsum(many) + many, many) + np.arange(many.sum())
    looked = len(x)
    could = np.minimum(pos[x], most_pos[block]) + 1 + np.minimum(rest[x], most_rest[block])
    fits = (least_n[block] * num <= n[x] * den) & (could >= least_overlap(n[x], least_n[block], num, den))
    x, block = x[fits], block[fits]
    many = end[block] - first[block]
    y = np.repeat(first[block] - np.cumsum(many) + many, many) + np.arange(many.sum())
    x = np.repeat(x, many)
    x, y = x[y > x], y[y > x]
    shared = np.minimum(pos[x], pos[y]) + 1 + np.minimum(rest[x], rest[y])
    near = (n[y] * num <= n[x] * den) & (shared >= least_overlap(n[x], n[y], num, den))
    x, y = x[near], y[near]
    return np.hstack([e[x, 2:4], e[y, 2:4], e[x, 1:2], e[y, 1:2], np.zeros((len(x), 1), np.int64)]), looked, looked - int(fits.sum())


def candidates(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of sets that share an index list: ahi, alo, bhi, blo, na, nb, far.

    Lists are sorted by size and compared by `list_pairs`. A list of more than SHORT sets gives pairs of its first set with
    each other (far = true), which stand for all pairs in it: its sets become one family, which is joined as a whole.
    """
    names = ["ahi", "alo", "bhi", "blo", "na", "nb", "far"]

    def pairs(e: np.ndarray) -> np.ndarray:
        return list_pairs(e, num, den)[0]

    def star(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        head = np.tile(first[2:4], (len(rest), 1))
        return np.hstack([head, rest[:, 2:4], np.full((len(rest), 1), first[1]), rest[:, 1:2], np.ones((len(rest), 1), np.int64)])

    def batch_of(x: np.ndarray) -> pa.RecordBatch:
        x = np.unique(np.where((x[:, 0] > x[:, 2])[:, None] | ((x[:, 0] == x[:, 2]) & (x[:, 1] > x[:, 3]))[:, None], x[:, [2, 3, 0, 1, 5, 4, 6]], x), axis=0)
        return pa.RecordBatch.from_arrays([*(pa.array(x[:, i].copy()) for i in range(4)), *(pa.array(x[:, i].astype(np.int32)) for i in (4, 5)), pa.array(x[:, 6] == 1)], names=names)

    def run(batches):
        tail, head, out, waiting = np.empty((0, 5), np.int64), None, [], 0
        for batch in batches:
            e = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            e = np.concatenate([tail, e])
            if len(e) > 1:
                e = e[np.concatenate([[True], (e[1:, [0, 2, 3]] != e[:-1, [0, 2, 3]]).any(axis=1)])]
            if head is not None:  # a long list goes on
                same = e[:, 0] == head[0]
                out.append(star(head, e[same]))
                if same.all():
                    e = e[:0]
                else:
                    e, head = e[~same], None
            if len(e):
                starts = np.flatnonzero(np.concatenate([[True], e[1:, 0] != e[:-1, 0]]))
                sizes = np.diff(np.append(starts, len(e)))
                long = sizes > SHORT
                for s, n in zip(starts[long], sizes[long], strict=True):
                    out.append(star(e[s], e[s + 1 : s + n]))
                last = e[starts[-1] :]
                of = np.repeat(np.arange(len(starts)), sizes)
                use = (sizes > 1) & ~long
                use[-1] = False
                out.append(pairs(e[use[of]]))
                if long[-1]:
                    head, tail = e[starts[-1]], e[:0]
                else:
                    tail = last
            else:
                tail = e
            waiting += len(out[-1]) if out else 0
            if waiting > 200_000:
                yield batch_of(np.concatenate(out))
                out, waiting = [], 0
        if head is None and len(tail) > 1:
            out.append(pairs(tail) if len(tail) <= SHORT else star(tail[0], tail[1:]))
        if out:
            yield batch_of(np.concatenate(out))

    sorted_lists = entries.select("token", "n", "hi", "lo", "pos").repartition("token").sortWithinPartitions("token", "n", "hi", "lo")
    return sorted_lists.mapInArrow(tidy(run), "ahi long, alo long, bhi long, blo long, na int, nb int, far boolean")


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def joined(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the same sets as all links between them do; between sides 0 and 1 if there are both, else between all.

    A set's intersections with all others are those of the set before it, corrected by the index lists of the elements
    in which the two differ; sets are in the order of their elements, so that similar ones follow each other.
    """
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if common >= least_overlap(n[0], n[1], num, den) else []
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    member, first = of[order], np.searchsorted(token[order], np.arange(token.max() + 2))
    own = np.split(token, np.cumsum(n)[:-1])
    lists = lambda t: member[np.repeat(first[t] - np.cumsum(first[t + 1] - first[t]) + first[t + 1] - first[t], first[t + 1] - first[t]) + np.arange((first[t + 1] - first[t]).sum())]
    cross, root, out, before, counts = side.min() != side.max(), np.arange(len(sets)), [], None, None
    for x in sorted(range(len(sets)), key=lambda i: (own[i][:8].tolist(), len(own[i]))):
        if before is not None:
            more, less = np.setdiff1d(own[x], own[before], assume_unique=True), np.setdiff1d(own[before], own[x], assume_unique=True)
        if before is None or len(more) + len(less) > n[x]:
            counts = np.bincount(lists(own[x]), minlength=len(sets))
        else:
            counts = counts + np.bincount(lists(more), minlength=len(sets)) - np.bincount(lists(less), minlength=len(sets))
        before = x
        for y in np.flatnonzero(counts >= least_overlap(n[x], n, num, den)):
            if y != x and not (cross and side[x] == side[y]):
                a, b = _find(root, x), _find(root, y)
                if a != b:
                    root[a] = b
                    out.append((x, int(y)))
    return out


def family_links(units: DataFrame, num: int, den: int) -> DataFrame:
    """units: family, i, j, side, node, tokens, all rows of a unit in one partition, one unit after another."""

    def run(batches):
        key, ids, sets, sides, out = None, [], [], [], []

        def close():
            if len(ids) > 1:
                for x, y in joined(sets, np.array(sides), num, den):
                    out.append((ids[x], ids[y]))

        for batch in batches:
            unit = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for u, s, x, raw in zip(unit, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if u != key:
                    close()
                    key, ids, sets, sides = u, [], [], []
                ids.append(x), sides.append(s), sets.append(np.frombuffer(raw.as_buffer(), np.int64).copy())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return units.mapInArrow(tidy(run), "a long, b long")


def similar_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A row's set has its distinct k-word shingles; with fewer
    words the whole sequence as one; null and texts without words have an empty set and are linked with nothing.
    Two rows link when den * intersection >= num * union. component_id is the smallest doc_id that links reach. Equal
    sets are one class from the start. Rows that repeat a doc_id are judged by their own texts. Rows without a doc_id take part, but
    name no component: one of such rows alone has a null component_id. Other columns are dropped.
    Shingles are compared as 52-bit hashes, classes as 128-bit ones.

    1. One pass describes each text and counts shingles in a sketch, by which they are ordered, rare ones first.
    2. Each class enters the index with its rarest shingles; lists give candidate pairs, which a bitmap of each set thins.
    3. Candidates form families. A family's sets meet in one task, or block by block, for the exact join.
    4. Graphs are over numbers of classes; the smallest doc_id of a component is read from its classes at the end.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "similar")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bytes_in = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(bytes_in, spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    tied = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    described = scratch.put(describe(docs, k, bits), "described")
    levels = rarity(described, bits)
    texts = described.where("part is null").select("doc_id", "n", "hi", "lo", "bitmap")
    classes = texts.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("bitmap").alias("bitmap"))
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so that numbers stay
    found = scratch.put(candidates(prefixes(docs, k, num, den, levels), num, den), "candidates")
    pairs = found.groupBy("ahi", "alo", "bhi", "blo").agg(F.any_value("na").alias("na"), F.any_value("nb").alias("nb"), F.max("far").alias("far"))
    maps = classes.select("hi", "lo", "node", "bitmap")
    pairs = pairs.join(maps.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("node").alias("a"), F.col("bitmap").alias("abits")), ["ahi", "alo"]).drop("ahi", "alo")
    pairs = pairs.join(maps.select(F.col("hi").alias("bhi"), F.col("lo").alias("blo"), F.col("node").alias("b"), F.col("bitmap").alias("bbits")), ["bhi", "blo"])
    length = F.least(F.size("abits"), F.size("bbits"))

    def folded(c: str) -> Column:  # sizes of a pair are close, so that one bitmap is at most twice the other
        halves = F.zip_with(F.slice(c, 1, length), F.slice(c, length + 1, length), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) > length, halves).otherwise(F.col(c))

    # Counts as long: sets of many millions of shingles are no error.
    apart = F.aggregate(F.zip_with(folded("abits"), folded("bbits"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)
    both = F.col("na").cast("long") + F.col("nb")
    pairs = pairs.where(F.col("far") | ((both - apart) * (den + num) >= 2 * num * both)).select("a", "b")
    families = scratch.put(connected_components(pairs, scratch, "families").select(F.col("id").alias("node"), F.col("root").alias("family")), "families")
    # The sets of the families, from the texts.
    members = classes.select("hi", "lo", "node", "doc_id", "n").join(families, "node")
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    members = scratch.put(members.join(sizes, "family"), "members")
    few = members.select("doc_id")
    few = F.broadcast(few) if members.count() <= BROADCAST_ROWS else few
    chosen = docs.alias("d").join(few.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi")

    def tokens(batches):
        powers = Powers()
        for batch in batches:
            out = []
            for a, b, t, first in sets_of(batch.column(1), k, powers):
                out += [(*_identity(t[first[i] : first[i + 1]]), t[first[i] : first[i + 1]].astype(np.int64).tobytes()) for i in range(b - a)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["hi", "lo", "tokens"])

    sets = chosen.mapInArrow(tidy(tokens), "hi long, lo long, tokens binary")
    # Of rows that repeat a doc_id with other texts, those of other classes fall out here.
    units = sets.join(members, ["hi", "lo"]).withColumn("own", F.pmod(F.xxhash64("hi", "lo"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # Rows that repeat a text give its set more than once.
    units = units.dropDuplicates(["hi", "lo"]) if tied else units
    units = units.select("family", "node", "tokens", "own", other)
    units = units.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "tokens")
    keys = ["family", "i", "j"]
    units = units.repartition(*keys).sortWithinPartitions(*keys, "node")
    links = scratch.put(family_links(units, num, den), "links")
    roots = connected_components(links, scratch, "components").select(F.col("id").alias("node"), "root")
    linked = scratch.put(classes.select("hi", "lo", "node", "doc_id").join(roots, "node", "left"), "linked")
    smallest = linked.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    smallest = scratch.put(smallest, "smallest")
    named = F.broadcast(smallest) if smallest.count() <= BROADCAST_ROWS else smallest
    whole = linked.join(named, "root", "left").select("hi", "lo", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component"))
    whole = scratch.put(whole, "whole")
    out = texts.select("doc_id", "n", "hi", "lo").join(whole, ["hi", "lo"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the row with the smallest doc_id of each component of five-word shingles at 0.8.

    Rows that repeat a doc_id with the same text are one; with other texts they are rows of their own, in the order of
    hashes of their texts. Rows without a doc_id are the last ones, told apart in the same way.
    """
    scratch, columns = Scratch(spark, "similar-stage"), docs.columns
    docs, back = set_aside(docs, ("similar_row", "similar_high", "similar_low"))
    # Repeated and missing doc_ids: numbers in the order of doc_id and text hashes stand for them.
    again = not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    rows, row = docs, "doc_id"
    if again:
        row, text = "similar_row", [F.xxhash64(F.lit(i), "text", F.col("text").isNull()) for i in range(2)]
        rows = docs.withColumns({"similar_high": text[0], "similar_low": text[1]}).dropDuplicates(["doc_id", "similar_high", "similar_low"])
        rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), "similar_high", "similar_low").withColumn(row, F.monotonically_increasing_id())
        rows = scratch.put(rows.drop("similar_high", "similar_low"), "rows")
    found = scratch.put(similar_components(rows.select(F.col(row).alias("doc_id"), "text"), 5, 80, 100), "found")
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    stay = F.broadcast(stay) if found.count() <= BROADCAST_ROWS else stay
    return back(rows.join(stay, row, "left_semi").select(*docs.columns)).select(*columns)
