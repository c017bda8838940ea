"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Powers, Scratch, append_columns, mixed, pieces, set_aside, shingle_hashes, table, tidy, utf8, word_hashes

#: Words of a window, and of the shingles of which a window's rarest is its prefix.
WINDOW, SHINGLE = 10, 4
#: Bytes of items that one block of the benchmark has at most about (its index is broadcast); each block is a pass over the documents.
BLOCK_BYTES = 8 << 20
#: Blocks whose passes over the documents are one job; documents are written again only after so many.
CHAINED = 4


class Windows:
    """The distinct windows of a block of items, as places in the items' words, and which items each is in.

    Windows are told apart by two independent 64-bit hashes. Arrays only: about 60 bytes for each word of the items.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.ids, self.shingle = sorted({i for i, _ in items}), shingle
        number = {x: k for k, x in enumerate(self.ids)}
        raw = [text.encode("utf-8") for _, text in items]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.words, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at, ALNUM, Powers())
        n = np.diff(first)
        size = np.minimum(window, n)
        many = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.array([number[i] for i, _ in items], np.int64), many)
        start = np.repeat(first[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
        size = np.repeat(size, many)
        keys = np.zeros((2, len(start)), np.uint64)
        for k in np.unique(size):
            own = size == k
            for i, words in enumerate((self.words, mixed(self.words ^ np.uint64(0x5851F42D4C957F2D)))):
                keys[i, own] = shingle_hashes(words, int(k))[start[own]]
        order = np.lexsort((item, keys[1], keys[0], size))
        new = np.concatenate([[True], (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0) | (size[order[1:]] != size[order[:-1]])])[: len(order)]
        once = new | np.concatenate([[True], item[order[1:]] != item[order[:-1]]])[: len(order)]
        self.start, self.size = start[order[new]], size[order[new]]
        #: Items of window w: item[of[w] : of[w + 1]], each once.
        self.item, self.of = item[order[once]], np.append(np.flatnonzero(new[once]), once.sum())

    def shingles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length of shingles, shorter only for windows of fewer words: that length, the windows, hashes at each word, shingles of each window."""
        k_of = np.minimum(self.shingle, self.size)
        for k in np.unique(k_of):
            own = np.flatnonzero(k_of == k)
            yield int(k), own, shingle_hashes(self.words, int(k)), self.size[own] - k + 1

    def distinct(self) -> dict[int, np.ndarray]:
        out = {}
        for k, own, hashes, many in self.shingles():
            mark = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(mark, self.start[own], 1), np.add.at(mark, self.start[own] + many, -1)
            out[k] = np.unique(hashes[np.cumsum(mark[:-1]) > 0])
        return out

    def index(self, counts: dict[int, np.ndarray]) -> Index:
        """With how often each distinct shingle is in the documents: keeps each window's rarest one, the prefix."""
        by, known = {}, self.distinct()
        for k, own, hashes, many in self.shingles():
            often = counts[k][np.minimum(np.searchsorted(known[k], hashes), len(known[k]) - 1)]
            best = np.zeros(len(own), np.int64)  # the place of the rarest so far; of equally rare ones the smaller hash, then the first
            for j in range(1, int(many.max())):
                x, y = self.start[own] + np.minimum(j, many - 1), self.start[own] + best
                best = np.where((often[x] < often[y]) | ((often[x] == often[y]) & (hashes[x] < hashes[y])), np.minimum(j, many - 1), best)
            h = hashes[self.start[own] + best]
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            by[k] = (keys, np.append(first, len(order)), own[order], best[order])
        return Index(self.ids, self.item, self.of, self.words, self.start, self.size, by)


class Index:
    """Prefix lists: by shingle, the windows that it is the rarest shingle of, with its place."""

    def __init__(self, ids, item, of, words, start, sizes, by):
        self.ids, self.item, self.of, self.words, self.start, self.sizes, self.by = ids, item, of, words, start, sizes, by

    def names(self, windows: np.ndarray) -> set[str]:
        return {self.ids[i] for w in windows for i in self.item[self.of[w] : self.of[w + 1]]}

    def find(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin in the words of texts (bounds: each text's first word, with the end), and which."""
        at, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, (keys, first, windows, places) in self.by.items():
            hashes = shingle_hashes(words, k)
            slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[slot] == hashes)
            slot, n = slot[hit], first[slot[hit] + 1] - first[slot[hit]]
            row = np.repeat(first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            w, begin = windows[row], np.repeat(hit, n) - places[row]
            text = np.searchsorted(bounds, np.repeat(hit, n), "right") - 1
            fits = (begin >= bounds[text]) & (begin + self.sizes[w] <= bounds[text + 1])
            begin, w = begin[fits], w[fits]
            for j in range(int(self.sizes[w].max()) if len(w) else 0):  # all words of the window, one after another
                same = (j >= self.sizes[w]) | (words[np.minimum(begin + j, len(words) - 1)] == self.words[np.minimum(self.start[w] + j, len(self.words) - 1)])
                begin, w = begin[same], w[same]
            at.append(begin), found.append(w)
        return np.concatenate(at), np.concatenate(found)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each piece of a batch: its first and last row, its words, and where each text's words start, with the end."""
    powers = _texts.__dict__.setdefault("powers", Powers())
    data, at = utf8(batch.column(batch.schema.get_field_index("text")))
    for a, b in pieces(at):
        yield a, b, *word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], ALNUM, powers)


def shingle_counts(docs: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How often each distinct shingle of the windows is in all documents; as many numbers as there are shingles in the block."""
    known = windows.distinct()
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        sums = {k: np.zeros(len(keys), np.int64) for k, keys in sent.value.items()}
        for batch in batches:
            for _, _, words, _ in _texts(batch):
                for k, keys in sent.value.items():
                    hashes = shingle_hashes(words, k)
                    slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    slot = slot[keys[slot] == hashes]
                    sums[k] += np.bincount(slot, minlength=len(keys)) if len(slot) else 0
        for k, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["k", "i", "n"])

    rows = docs.select("text").mapInArrow(tidy(count), "k int, i int, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(len(keys), np.int64) for k, keys in known.items()}
    for k in out:
        own = rows[rows["k"] == k]
        out[k][own["i"].to_numpy()] = own["n"].to_numpy()
    return out


def _join(docs: DataFrame, index: Index, first: bool, drop: tuple[str, ...]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def fields_of(batch: pa.RecordBatch) -> list[pa.Array]:
        ix, n = sent.value, batch.num_rows
        n_words, n_hit, spans, items = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n, [[]] * n
        old = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "hit_items")]
        for a, b, words, bounds in _texts(batch):
            n_words[a:b] = np.diff(bounds)
            begin, w = ix.find(words, bounds)
            text = np.searchsorted(bounds, begin, "right") - 1
            rows = np.unique(text) if old is None else np.union1d(text, [r - a for r in range(a, b) if old[1][r]]).astype(int)
            for r in rows:
                own = text == r
                mark = np.zeros(n_words[a + r] + 1, np.int32)
                np.add.at(mark, begin[own] - bounds[r], 1)
                np.add.at(mark, begin[own] - bounds[r] + ix.sizes[w[own]], -1)
                names = ix.names(np.unique(w[own]))
                if old is not None and old[1][a + r]:
                    pairs = np.frombuffer(old[0][a + r], np.int32).reshape(-1, 2)
                    np.add.at(mark, pairs[:, 0], 1), np.add.at(mark, pairs[:, 1], -1)
                    names |= set(old[1][a + r])
                hit = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).astype(np.int32)
                n_hit[a + r], spans[a + r], items[a + r] = hit.sum(), edge.tobytes(), sorted(names)
        return [pa.array(n_words), pa.array(n_hit), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.BinaryType()), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    return append_columns(docs, fields_of, fields, drop)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, drop: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (pairs of 32-bit word numbers, end exclusive), hit_items (sorted strings).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is WINDOW consecutive words
    of an item; an item of fewer, but not none, is one window. A word inside any occurrence of a window is hit.
    Null texts have no words; items without words have no windows; rows that repeat an item_id are one item, and
    a null item_id is an item named "". An empty benchmark hits nothing. Columns of these names are replaced.
    A benchmark of more than block_bytes goes in blocks, so that what is broadcast stays bounded: a counting pass over the texts for each, and
    one job for the hits of CHAINED blocks, after which the documents are written for the next ones.
    Words are compared as 64-bit hashes, all words of a window.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    scratch, texts = Scratch(docs.sparkSession, "contamination"), docs.select("text")
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        windows = Windows([(r["item"], r["text"]) for r in own.collect()])
        docs = _join(docs, windows.index(shingle_counts(texts, windows)), b == 0, drop if b == blocks - 1 else ())
        if b < blocks - 1 and (b + 1) % CHAINED == 0:
            docs = scratch.put(docs, f"block{b}")
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop=("text",))
    names = F.array_join("hit_items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any word of an occurrence of a window."""
    names, (safe, back) = docs.columns, set_aside(docs, ("n_words", "n_hit", "hit_spans", "hit_items"))
    return back(mark_contamination(safe, table(spark, sf_dir, "benchmark")).where("n_hit = 0")).select(*names)


SQL2 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.x = d.x),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
