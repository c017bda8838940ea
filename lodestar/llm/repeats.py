"""Repeated byte strings by a hash-compared suffix sort around content-defined anchors."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Powers, Scratch, append_columns, mixed, pieces, prefix_hash, table, tidy, utf8

#: Bytes of a repeated string, and of an anchor: in every string of LENGTH bytes the ANCHOR bytes with the smallest hash.
LENGTH, ANCHOR = 100, 37
#: Places for an anchor in a string of LENGTH bytes (a power of 2), and what of such strings can stand before or after it.
PLACES = LENGTH - ANCHOR + 1
SIDE = PLACES - 1
#: Of two contexts that share a string of LENGTH bytes, so many bytes before or after the anchor are the same.
HALF = SIDE // 2 + 1
#: Random numbers for the hashes of contexts.
CONTEXT_BYTES = np.random.default_rng(20240818).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Surroundings whose earliest place a task remembers, and first rows of one anchor that wait for a partner, at most.
MOST_SEEN, MOST_HEADS = 1 << 17, 1 << 17
#: First places of strings (40 bytes each, and 100 more with their bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST_FIRSTS = 125_000
#: Bytes of contexts that are sorted together; a larger group is sorted alone.
SORTED = 8 << 20
#: Contexts of one anchor that are sorted in a task; the strings of more are joined by hash.
MOST_CONTEXTS = SORTED // (2 * SIDE + ANCHOR)


class Anchors(NamedTuple):
    """Of each anchor: its text and place, bytes before and after it within reach, its hash, one of all these bytes, and of its halves."""

    text: np.ndarray
    place: np.ndarray
    before: np.ndarray
    after: np.ndarray
    hash: np.ndarray
    context: np.ndarray
    sides: np.ndarray


def anchors(data: np.ndarray, at: np.ndarray, powers: Powers) -> Anchors:
    """The anchors of texts. Their hashes and those of their surroundings are by two tables of random numbers, independent of each other.

    sides: 16 bits of the hash of the anchor with the HALF bytes before it, then of it with the HALF bytes after it; 0 where there are fewer.
    """
    nothing = Anchors(*(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)))
    if len(data) < LENGTH:
        return nothing
    s, (_, down) = prefix_hash(data, powers), powers.get(len(data) + 1)
    n = len(data) - ANCHOR + 1
    h = mixed((s[ANCHOR:] - s[:n]) * down[:n])
    low = np.uint64((1 << 32) - 1)
    least = (h & ~low) | np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost
    step = 1
    while step < PLACES:  # least[i] covers the places from i on, twice as many each time
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    starts = np.arange(len(least))
    text = np.searchsorted(at, starts, "right") - 1
    inside = starts + LENGTH <= at[text + 1]
    place = (least & low).astype(np.int64)[inside]
    if not len(place):
        return nothing
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    text = np.searchsorted(at, place, "right") - 1
    before, after = np.minimum(SIDE, place - at[text]), np.minimum(SIDE, at[text + 1] - place - ANCHOR)
    begin, end = place - before, place + ANCHOR + after
    other = prefix_hash(data, powers, CONTEXT_BYTES)
    context = mixed((other[end] - other[begin]) * down[begin] + (before * 128 + after).astype(np.uint64))

    def half(first: np.ndarray, there: np.ndarray) -> np.ndarray:
        first = np.where(there, first, 0)
        found = mixed((s[first + HALF + ANCHOR] - s[first]) * down[first]) & np.uint64((1 << 16) - 1)
        return np.where(there, np.maximum(found, np.uint64(1)), np.uint64(0))

    sides = (half(place - HALF, before >= HALF) << np.uint64(16)) | half(place, after >= HALF)
    return Anchors(text, place - at[text], before, after, h[place], context, sides)


def merged(of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of texts as disjoint ones that don't touch, in order."""
    order = np.lexsort((begin, of))
    of, begin, end = of[order], begin[order], end[order]
    if not len(of):
        return of, begin, end
    rank = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]])).astype(np.int64) << 33
    reach = np.maximum.accumulate(rank + end)
    new = np.concatenate([[True], rank[1:] + begin[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of)) - 1
    return of[first], begin[first], reach[last] - rank[last]


class Earliest:
    """The earliest place that a task has seen of some surroundings: of those that were there twice in a batch, at most MOST_SEEN.

    It only saves rows: what is forgotten goes through the shuffle.
    """

    def __init__(self) -> None:
        self.key, self.at = np.empty(0, np.uint64), np.empty((0, 3), np.int64)

    def later(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which places (doc, tie, spot) of surroundings are after one that was seen."""
        if not len(self.key):
            return np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        x, y = at, self.at[i]
        after = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & ((x[:, 1] > y[:, 1]) | ((x[:, 1] == y[:, 1]) & (x[:, 2] > y[:, 2]))))
        return (self.key[i] == key) & after

    def add(self, key: np.ndarray, at: np.ndarray) -> None:
        key, at = np.concatenate([self.key, key]), np.vstack([self.at, at])
        order = np.lexsort((at[:, 2], at[:, 1], at[:, 0], key))
        order = order[np.concatenate([[True], key[order[1:]] != key[order[:-1]]])[: len(order)]]
        self.key, self.at = (key[order], at[order]) if len(order) <= MOST_SEEN else (np.empty(0, np.uint64), np.empty((0, 3), np.int64))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """docs: doc, tie, text. A row for each anchor, but one for each context in a batch; of the others the bytes are covered at once."""
    names = ["anchor", "context", "sides", "doc", "tie", "spot", "begin", "end"]

    def run(batches):
        powers, seen = Powers(), Earliest()
        for batch in batches:
            data, at = utf8(batch.column(2))
            doc, tie = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            found = []
            for a, b in pieces(at):
                x = anchors(data[at[a] : at[b]], at[a : b + 1] - at[a], powers)
                found.append(x._replace(text=x.text + a))
            if not found:
                continue
            x = Anchors(*map(np.concatenate, zip(*found, strict=True)))
            if not len(x.text):
                continue
            where = np.stack([doc[x.text], tie[x.text], (x.place << 14) | (x.before << 7) | x.after], axis=1)
            key = mixed(x.hash + mixed(x.context))
            order = np.lexsort((where[:, 2], where[:, 1], where[:, 0], key))
            key, own = key[order], where[order]
            repeats = np.concatenate([[False], key[1:] == key[:-1]])
            again = repeats & np.concatenate([[False], (own[1:] != own[:-1]).any(axis=1)])
            heads = ~repeats
            again[heads] = seen.later(key[heads], own[heads])
            seen.add(key[heads & np.append(repeats[1:], False)], own[heads & np.append(repeats[1:], False)])
            first, cover = order[heads & ~again], order[again]
            none = pa.nulls(len(first), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(v[first].view(np.int64)) for v in (x.hash, x.context)), pa.array(x.sides[first].astype(np.uint32).view(np.int32)), *(pa.array(where[first, i]) for i in range(3)), none, none], names=names)
            if len(cover):
                of, begin, end = merged(x.text[cover], (x.place - x.before)[cover], (x.place + ANCHOR + x.after)[cover])
                none, at_doc = pa.nulls(len(of), pa.int64()), doc[of]
                # These go through the same shuffle, to a place by their text.
                yield pa.RecordBatch.from_arrays([pa.array(mixed(at_doc.view(np.uint64)).view(np.int64)), none, pa.nulls(len(of), pa.int32()), pa.array(at_doc), pa.array(tie[of]), none, *(pa.array(v.astype(np.int32)) for v in (begin, end))], names=names)

    return docs.select("doc", "tie", "text").mapInArrow(tidy(run), "anchor long, context long, sides int, doc long, tie long, spot long, begin int, end int")


def partnered(heads: np.ndarray) -> np.ndarray:
    """Which first rows of contexts (anchor, context, doc, tie, spot, sides) agree with another of their anchor in one of the sides.

    Strings of LENGTH bytes that two contexts share have HALF bytes before or after the anchor.
    """
    out, anchor, sides = np.zeros(len(heads), bool), heads[:, 0].astype(np.uint64), heads[:, 5].astype(np.uint64) & np.uint64((1 << 32) - 1)
    for i, side in enumerate((sides >> np.uint64(16), sides & np.uint64((1 << 16) - 1))):
        there = np.flatnonzero(side)
        # Keys that agree by chance only let a row too many through.
        key = mixed(anchor[there] ^ mixed(side[there] + np.uint64(i)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        out[there[order]] |= np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return out


def sorted_out(rows: DataFrame) -> DataFrame:
    """Of rows in order of anchor, context, doc, tie, spot: spans of later rows of a context; and each context's first row if it is `partnered`.

    Rows stream by, so that an anchor may have any number of them; of one with more than MOST_HEADS contexts, all first rows stay.
    """
    names = ["anchor", "doc", "tie", "spot", "begin", "end"]

    def heads_of(e: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(e[:, i].copy()) for i in (0, 2, 3, 4)), *[pa.nulls(len(e), pa.int32())] * 2], names=names)

    def spans_of(e: np.ndarray) -> pa.RecordBatch:
        place, before, after = e[:, 4] >> 14, (e[:, 4] >> 7) & 127, e[:, 4] & 127
        none = pa.nulls(len(e), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(e[:, 2].copy()), pa.array(e[:, 3].copy()), none, pa.array((place - before).astype(np.int32)), pa.array((place + ANCHOR + after).astype(np.int32))], names=names)

    def run(batches):
        # The last row; first rows of the last row's anchor, or its number where they are too many to wait.
        last, waiting, crowded = None, np.empty((0, 6), np.int64), None
        for batch in batches:
            spans = batch.filter(batch.column(6).is_valid())
            if spans.num_rows:
                none = pa.nulls(spans.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, spans.column(3), spans.column(4), none, spans.column(6), spans.column(7)], names=names)
            batch = batch.filter(batch.column(6).is_null())
            if not batch.num_rows:
                continue
            e = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4, 5, 2)], axis=1)
            prior = np.vstack([last if last is not None else np.append(~e[0, :1], e[0, 1:])[None], e[:-1]])
            same = (e[:, 0] == prior[:, 0]) & (e[:, 1] == prior[:, 1])
            if (same & (e[:, 5] != prior[:, 5])).any():
                raise RuntimeError("a hash collision of surroundings")
            # Rows of one text that are there twice are one row.
            cover = same & (e[:, 2:5] != prior[:, 2:5]).any(axis=1)
            if cover.any():
                yield spans_of(e[cover])
            heads, last = np.vstack([waiting, e[~same]]), e[-1:]
            if crowded is not None:
                more = heads[:, 0] == crowded
                if more.any():
                    yield heads_of(heads[more])
                heads, crowded = heads[~more], crowded if last[0, 0] == crowded else None
            open_ = heads[:, 0] == last[0, 0]
            done, waiting = heads[~open_], heads[open_]
            done = done[partnered(done)]
            if len(done):
                yield heads_of(done)
            if len(waiting) > MOST_HEADS:
                yield heads_of(waiting)
                waiting, crowded = waiting[:0], last[0, 0]
        waiting = waiting[partnered(waiting)]
        if len(waiting):
            yield heads_of(waiting)

    keys = ["anchor", "context", "doc", "tie", "spot"]
    return rows.repartition("anchor").sortWithinPartitions(*keys).mapInArrow(tidy(run), "anchor long, doc long, tie long, spot long, begin int, end int")


class Suffixes:
    """Bytes of contexts, one after another, in which strings are compared by prefix hashes."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.data = np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)])
        self.s = prefix_hash(self.data, powers)
        self.down = powers.get(len(self.s))[1]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the strings from a and from b have in common, up to most: a binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while True:
            middle = (low + high + 1) // 2
            open_ = low < high
            if not open_.any():
                return low
            same = (self.s[a + middle] - self.s[a]) * self.down[a] == (self.s[b + middle] - self.s[b]) * self.down[b]
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)

    def less(self, a, b, len_a, len_b) -> np.ndarray:
        n = self.common(a, b, np.minimum(len_a, len_b))
        ended = n == np.minimum(len_a, len_b)
        return np.where(ended, len_a < len_b, self.data[a + n] < self.data[b + n])

    def sort(self, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge sort of strings (start, size) within groups; the order, and what each has in common with the one before it.

        Runs of 1, 2, 4 and so on of a group are merged at once: a string's place is its place in its own run and its rank in
        the other one, which a binary search finds.
        """
        first = np.searchsorted(group, group)
        count = np.searchsorted(group, group, "right") - first
        order, width = np.arange(len(start)), 1
        while len(count) and width < count.max():
            i = np.arange(len(order)) - first
            other = first + ((i // width) ^ 1) * width
            end = np.minimum(other + width, first + count)
            has = other < first + count
            low, high = np.where(has, other, 0), np.where(has, end, 0)
            right = (i // width) % 2 == 1
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                x, y = order[open_], order[middle]
                # Of equal strings, the left run's come first.
                before = np.where(right[open_], ~self.less(start[x], start[y], size[x], size[y]), self.less(start[y], start[x], size[y], size[x]))
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            rank = np.where(has, low - other, 0)
            base = first + (i // (2 * width)) * 2 * width
            moved = np.empty_like(order)
            moved[base + i % width + rank] = order
            order, width = moved, 2 * width
        x, y = order[1:], order[:-1]
        shared = np.concatenate([[0], self.common(start[x], start[y], np.minimum(size[x], size[y]))]) if len(order) else np.empty(0, np.int64)
        shared[np.flatnonzero(first == np.arange(len(first)))] = 0
        return order, shared

    def verified(self, start: np.ndarray, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours have the bytes in common that their hashes say."""
        reach = np.arange(SIDE + ANCHOR)
        for i in range(1, len(order), 1 << 15):
            x, y, n = order[i : i + (1 << 15)], order[i - 1 : i - 1 + (1 << 15)][: len(order[i : i + (1 << 15)])], shared[i : i + (1 << 15)]
            if ((self.data[start[x][:, None] + reach] != self.data[start[y][:, None] + reach]) & (reach < n[:, None])).any():
                return False
        return True


def covered(contexts: list[bytes], before: np.ndarray, group: np.ndarray, powers: Powers) -> np.ndarray:
    """Rows (index, first, last): strings of LENGTH bytes in a context that start there, from the anchor's `first` bytes before it to `last`, and are in an earlier one of the group.

    contexts are in the order of groups and, within a group, of text and place; before: the anchor's place in each.
    """
    sizes = np.array([len(c) for c in contexts])
    at = np.concatenate([[0], np.cumsum(sizes)])
    forward = np.frombuffer(b"".join(contexts), np.uint8)
    backward = np.frombuffer(b"".join(c[b::-1][1:] if b else b"" for c, b in zip(contexts, before.tolist(), strict=True)), np.uint8)
    mirror = np.concatenate([[0], np.cumsum(before)])
    ranks = []
    for data, start, size in ((forward, at[:-1] + before, sizes - before), (backward, mirror[:-1], before)):
        suffixes = Suffixes(data, powers)
        order, shared = suffixes.sort(start, size, group)
        if not suffixes.verified(start, order, shared):
            raise RuntimeError("a hash collision in the suffix sort")
        ranks.append((order, shared))
    (right_order, right_shared), (left_order, left_shared) = ranks
    n, out = len(contexts), []
    after = sizes - before
    for k in range(PLACES):  # k bytes before the anchor and LENGTH - k from it on
        fits = (before >= k) & (after >= LENGTH - k)
        if fits.sum() < 2:
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[right_order], left[left_order] = np.cumsum(right_shared < LENGTH - k), np.cumsum(left_shared < k)
        # Groups differ in their classes of right sides, as the first of a group has nothing in common with the one before.
        rows = np.flatnonzero(fits)
        key = right[rows] * (n + 1) + (left[rows] if k else 0)
        by = np.argsort(key, kind="stable")
        later = by[1:][key[by][1:] == key[by][:-1]]
        out.append(np.stack([rows[later], np.full(len(later), k)], axis=1))
    hits = np.concatenate([np.empty((0, 2), np.int64), *out])
    if not len(hits):
        return np.empty((0, 3), np.int64)
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    new = np.concatenate([[True], (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(hits)) - 1
    return np.stack([hits[begin, 0], hits[end, 1], hits[begin, 1]], axis=1)


def partly_covered(contexts: DataFrame) -> DataFrame:
    """contexts: anchor, doc, tie, spot, bytes. Spans (doc, tie, begin, end) of strings that are in an earlier context of the anchor."""

    def run(batches):
        powers, held, size = Powers(), [], 0

        def spans(rows):
            keys = np.array([r[0] for r in rows], np.int64)
            group = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
            spot = np.array([r[3] for r in rows], np.int64)
            found = covered([r[4] for r in rows], (spot >> 7) & 127, group, powers)
            place = spot[found[:, 0]] >> 14
            doc, tie = (np.array([r[i] for r in rows], np.int64)[found[:, 0]] for i in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array((place - found[:, 1]).astype(np.int32)), pa.array((place - found[:, 2] + LENGTH).astype(np.int32))], names=["doc", "tie", "begin", "end"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size > SORTED and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(held)

    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor", "doc", "tie", "spot")
    return ordered.mapInArrow(tidy(run), "doc long, tie long, begin int, end int")


def joined_strings(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """contexts as in `partly_covered`, of anchors with any number of them. The same spans, by 128-bit hashes of the strings.

    The first place of each string is a partial aggregate, and every other place is compared with its bytes.
    """
    contexts = scratch.put(contexts, "many")
    before, after = F.shiftright("spot", 7).bitwiseAND(F.lit(127)), F.col("spot").bitwiseAND(F.lit(127))
    low, high = F.greatest(F.lit(0), LENGTH - ANCHOR - after), F.least(before, F.lit(LENGTH - ANCHOR))
    each = contexts.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    start = (F.shiftright("spot", 14) - F.col("k")).cast("int")
    each = each.select("doc", "tie", start.alias("start"), F.substring("bytes", (before - F.col("k") + 1).cast("int"), F.lit(LENGTH)).alias("string"))
    each = each.withColumns({"high": F.xxhash64(F.lit(0), "string"), "low": F.xxhash64(F.lit(1), "string")})
    place = F.struct("doc", "tie", "start")
    firsts = each.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    firsts = scratch.put(firsts, "firsts")
    few = firsts.count() <= BROADCAST_FIRSTS
    small = F.broadcast(firsts) if few else firsts
    # One row for each first place, with its bytes; two anchors may both have it.
    bytes_of = each.join(small, ["high", "low"]).where(place == F.col("first")).groupBy("high", "low").agg(F.first("first").alias("first"), F.min("string").alias("wanted"))
    bytes_of = scratch.put(bytes_of, "bytes")
    found = each.join(F.broadcast(bytes_of) if few else bytes_of, ["high", "low"]).where(place > F.col("first"))
    same = F.when(F.col("string") == F.col("wanted"), F.col("start")).otherwise(F.raise_error(F.lit("a hash collision of repeated strings")).cast("int"))

    def join_up(batches):
        for batch in batches:
            doc, tie, begin = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            if not len(doc):
                continue
            texts, of = np.unique(np.stack([doc, tie], axis=1), axis=0, return_inverse=True)
            of, begin, end = merged(of.ravel(), begin, begin + LENGTH)
            yield pa.RecordBatch.from_arrays([*(pa.array(texts[of, i].copy()) for i in range(2)), *(pa.array(v.astype(np.int32)) for v in (begin, end))], names=["doc", "tie", "begin", "end"])

    return found.select("doc", "tie", same.alias("begin")).mapInArrow(tidy(join_up), "doc long, tie long, begin int, end int")


def mark_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    Texts count as UTF-8, null as empty. A byte is removed if a string of LENGTH bytes that covers it also starts earlier:
    in a text of a smaller doc_id or earlier in the same text. Strings are judged on the input. Rows that repeat a doc_id
    with the same text are one text and share its result; with other texts they are texts in the order of
    their 64-bit hashes. A null doc_id counts as the smallest. Other columns are dropped.

    1. Every string of LENGTH bytes has an anchor, the same one wherever the string is. An anchor whose surroundings (all that
       strings with it reach) are there earlier has all their strings repeated.
    2. Anchors with several surroundings: their bytes are fetched, and two merge sorts, of what follows the anchors and of what
       precedes them, tell which strings of the first text with each surroundings are in an earlier text. Of an anchor with more
       than MOST_CONTEXTS of them, each string's first place is found by its hash, and the bytes are compared.
    3. The spans of each text are merged.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "repeats")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    again = docs.select(key.alias("doc")).groupBy("doc").count().where("count > 1").select("doc")
    tied = not again.isEmpty()
    docs = docs.select("doc_id", key.alias("doc"), (F.xxhash64("text") if tied else F.lit(0)).cast("long").alias("tie"), "text")
    found = scratch.put(sorted_out(anchor_rows(docs)), "found")
    # The bytes around anchors with several surroundings.
    heads = found.where("begin is null").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "spot")).alias("spots"))
    heads = scratch.put(heads, "heads")
    # As many texts as the corpus has may have some, at any size: texts and spots are shuffled, by doc.

    def fetch(batches):
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, (doc, tie, spots) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own, raw = [(x["anchor"], x["spot"]) for x in spots], data[at[i] : at[i + 1]].tobytes()
                cut = [raw[(s >> 14) - ((s >> 7) & 127) : (s >> 14) + ANCHOR + (s & 127)] for _, s in own]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([doc] * len(own), pa.int64()), pa.array([tie] * len(own), pa.int64()), pa.array([x[1] for x in own], pa.int64()), pa.array(cut, pa.binary())], names=["anchor", "doc", "tie", "spot", "bytes"])

    # Rows that repeat a text are one text.
    chosen = docs.select("doc", "tie", "text").join(heads.hint("merge"), ["doc", "tie"])
    contexts = (chosen.dropDuplicates(["doc", "tie"]) if tied else chosen).select("doc", "tie", "text", "spots").mapInArrow(tidy(fetch), "anchor long, doc long, tie long, spot long, bytes binary")
    # Each of these has MOST_CONTEXTS rows and more, so that they are few.
    large = scratch.put(found.where("begin is null").groupBy("anchor").count().where(F.col("count") > MOST_CONTEXTS).select("anchor"), "large")
    some = not large.isEmpty()
    cold = contexts.join(F.broadcast(large), "anchor", "left_anti").select("anchor", "doc", "tie", "spot", "bytes") if some else contexts
    partly = scratch.put(partly_covered(cold), "partly")
    spans = found.where("begin is not null").select("doc", "tie", "begin", "end").unionByName(partly)
    if some:
        hot = contexts.join(F.broadcast(large), "anchor", "left_semi").select("anchor", "doc", "tie", "spot", "bytes")
        spans = spans.unionByName(scratch.put(joined_strings(hot, scratch), "joined"))

    def join_up(batches):
        names = ["doc", "tie", "spans"]
        keep = np.empty((0, 4), np.int64)

        def out(e):
            part = np.cumsum(np.concatenate([[False], (e[1:, :2] != e[:-1, :2]).any(axis=1)]))
            of, begin, end = merged(part, e[:, 2], e[:, 3])
            head = np.searchsorted(part, np.unique(of))
            pairs = np.stack([begin, end], axis=1).astype(np.int32)
            cut = np.split(pairs, np.flatnonzero(np.diff(of)) + 1)
            return pa.RecordBatch.from_arrays([pa.array(e[head, 0].copy()), pa.array(e[head, 1].copy()), pa.array([c.tobytes() for c in cut], pa.binary())], names=names)

        for batch in batches:
            e = np.vstack([keep, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)])
            if not len(e):
                continue
            tail = np.flatnonzero((e[:, :2] != e[-1, :2]).any(axis=1))
            at = tail[-1] + 1 if len(tail) else 0
            if at:
                yield out(e[:at])
            keep = e[at:]
        if len(keep):
            yield out(keep)

    spans = spans.repartition("doc", "tie").sortWithinPartitions("doc", "tie", "begin").mapInArrow(tidy(join_up), "doc long, tie long, spans binary")
    spans = scratch.put(spans, "spans")
    whole = docs.join(spans.hint("merge"), ["doc", "tie"], "left")

    def digest(batch: pa.RecordBatch) -> list[pa.Array]:
        data, at = utf8(batch.column(batch.schema.get_field_index("text")))
        rows = []
        for i, spans in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
            own = data[at[i] : at[i + 1]]
            pairs = np.frombuffer(spans or b"", np.int32).reshape(-1, 2)
            h, place = hashlib.sha256(), 0
            for begin, end in pairs.tolist():
                h.update(own[place:begin].tobytes())
                place = end
            h.update(own[place:].tobytes())
            rows.append((len(own), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), h.hexdigest()))
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]

    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    return append_columns(whole, digest, fields, drop=("doc", "tie", "text", "spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
