"""Language-model scoring: a weighted backoff automaton over smoothed n-grams, run once over each text from left to right.

The model has every n-gram of every training text, so it is as large as the corpus and never in one place. Texts are dealt into
blocks of bounded size; a block asks for the counts of the n-grams that it has, in the order of their hashes, and gets the part of
the automaton that its texts can reach: what is asked for and answered are arrays, a row for each block and range of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import DARK, Powers, Scratch, bound_batches, mixed, pieces, table, tidy, utf8, word_hashes

#: Words of the longest n-grams, and how many tokens of a state's own count the next shorter state's distribution weighs.
ORDER, BACKOFF = 2, 30.0
#: Bytes of text in a block (a longer text is one alone), and n-grams in a range of hashes, about.
BLOCK_BYTES, RANGE_GRAMS = 8 << 20, 2 << 20
#: Tokens that a lane of the traversal reads at most; a longer text takes several lanes.
LANE = 512
#: Stand-ins for the hashes of what opens and ends a text.
OPEN, END = np.uint64(0x6F70656E5F5F5F31), np.uint64(0x656E645F5F5F5F31)
HELD = "docs.held_out AS held"
_CHAIN = np.uint64(0xD6E8FEB86659FD93)


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of the n-gram without its last word and of this word."""
    return mixed(context * _CHAIN + word)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, all lowest bytes first, then the next ones: high bytes that are zero take no room once compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : max(1, -(-int(values.max(initial=0)).bit_length() // 8))].T).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def sorted_keys(first: int, data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.concatenate([np.array([first], np.uint64), unpacked(data, n)[1:]]), dtype=np.uint64)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no count is learned from; never null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Block:
    """Texts as numbers of words: each text is OPEN, its words, END; `words` are the hashes of the numbers, the commonest first."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, ends: np.ndarray, learn: np.ndarray):
        self.hashes, self.ends, self.learn = words[ids], ends, learn
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.at = np.arange(len(ids)) - np.repeat(self.starts, np.diff(ends, prepend=0))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams and where their last words are. OPEN is a word of longer ones only as the first; alone it stands for itself."""
        h = self.hashes
        for k in range(1, n):
            h = extended(h[:-1], self.hashes[k:])
        last = np.flatnonzero(self.at >= n - 1)
        return h[last - n + 1], last


def block_rows(docs: DataFrame, names: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs in blocks: block, train_tokens, n_docs, n_ids, n_words, docs (the columns `names` and held_out), ends, ids, words."""
    inside = T.StructType([*(docs.schema[c] for c in names), T.StructField("held_out", T.BooleanType())])
    sizes = [T.StructField(c, T.LongType()) for c in ("block", "train_tokens", "grams", "n_docs", "n_ids", "n_words")]
    schema = T.StructType([*sizes, T.StructField("docs", T.ArrayType(inside)), *(T.StructField(c, T.BinaryType()) for c in ("ends", "ids", "words"))])

    def deal(batches):
        arrow, powers, part, number = to_arrow_schema(schema), Powers(), TaskContext.get().partitionId(), 0
        held, rows, size = [], [], 0

        def block():
            nonlocal number, size
            hashes, ends = np.concatenate([h for h, _ in held]), np.cumsum(np.concatenate([n for _, n in held]))
            structs = pa.concat_arrays(rows)
            learn = ~np.array(structs.field("held_out").to_pylist(), bool)
            words, ids, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens = int((np.diff(ends, prepend=0) - 1)[learn].sum())
            values = [(part << 32) + number, tokens, len(ids), len(ends), len(ids), len(words)]
            number, size = number + 1, 0
            held.clear(), rows.clear()
            columns = [pa.array([v], pa.int64()) for v in values]
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs).cast(arrow.field("docs").type))
            columns += [pa.array([b], pa.binary()) for b in (packed(np.diff(ends, prepend=0)), packed(rank[ids]), words[order].tobytes())]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index("text")))
            if not batch.num_rows:
                continue
            if held and size + len(data) > block_bytes:
                yield block()
            for a, b in pieces(at):
                found, bounds = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a], DARK, powers)
                n = np.diff(bounds) + 2
                out = np.empty(int(n.sum()), np.uint64)
                last = np.cumsum(n)
                out[last - 1], out[last - n] = END, OPEN
                inner = np.ones(len(out), bool)
                inner[last - 1] = inner[last - n] = False
                out[inner] = found
                held.append((out, n))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*names, "held_out")]
            rows.append(pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, c.type) for f, c in zip(inside, columns, strict=True)]))
            size += len(data)
        if held:
            yield block()

    return docs.withColumn("held_out", held_out(F.col("doc_id"))).select(*names, "held_out", *([] if "text" in names else ["text"])).mapInArrow(tidy(deal), schema)


def _block(row: dict) -> Block:
    words = np.frombuffer(row["words"], np.uint64)
    ends = np.cumsum(unpacked(row["ends"], row["n_docs"]).astype(np.int64))
    return Block(words, unpacked(row["ids"], row["n_ids"]).astype(np.int64), ends, ~np.array(row["held"], bool))


def _read(batch: pa.RecordBatch | pa.Table, i: int) -> dict:
    names = ("block", "n_docs", "n_ids", "n_words", "ends", "ids", "words")
    row = {c: batch.column(c)[i].as_py() for c in names if c in batch.schema.names}
    return row | {"held": batch.column("held")[i].values.to_pylist()}


def questions(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """The different n-grams of each block, sorted by hash and cut into ranges of hashes, with how often training texts of the block have them."""
    schema = "slot long, n int, range int, block long, size long, first long, keys binary, counts binary"

    def ask(batches):
        edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                block, number = _block(_read(batch, i)), batch.column("block")[i].as_py()
                learn = np.repeat(block.learn, np.diff(block.ends, prepend=0))
                for n in range(1, order + 1):
                    found, last = block.grams(n)
                    keys = np.unique(found)
                    own, times = np.unique(found[learn[last]], return_counts=True)
                    counts = np.zeros(len(keys), np.int64)
                    counts[np.searchsorted(keys, own)] = times
                    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    rows = [(n * ranges + r, n, r, number, b - a, int(keys[a : a + 1].view(np.int64)[0]), packed(np.diff(keys[a:b], prepend=keys[a])), packed(counts[a:b])) for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    for j in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[j : j + 64], strict=True), types, strict=True)], names=["slot", "n", "range", "block", "size", "first", "keys", "counts"])

    return blocks.selectExpr("block", "n_docs", "n_ids", "ends", "ids", "words", HELD).mapInArrow(tidy(ask), schema)


def answers(asked: DataFrame) -> DataFrame:
    """For each row that was asked, its n-grams' counts over all blocks in the same order; `known` words are counted on one row a range."""
    schema = "block long, n int, range int, size long, known long, counts binary"

    def answer(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_numpy()
        columns = [group.column(c).to_pylist() for c in ("first", "keys", "counts")]
        keys = np.concatenate([sorted_keys(first & (1 << 64) - 1, k, n) for first, k, n in zip(*columns[:2], sizes.tolist(), strict=True)])
        different, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([unpacked(c, n) for c, n in zip(columns[2], sizes.tolist(), strict=True)]), minlength=len(different)).astype(np.int64)
        known = int(((total > 0) & (different != OPEN)).sum())
        all_counts, at = total[which], np.concatenate([[0], np.cumsum(sizes)])
        counts = pa.array([packed(all_counts[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.Table.from_arrays([group.column("block"), group.column("n"), group.column("range"), group.column("size"), pa.array([known] + [0] * (len(sizes) - 1), pa.int64()), counts], names=["block", "n", "range", "size", "known", "counts"])

    return asked.groupBy("slot").applyInArrow(answer, schema)


class Automaton:
    """The states and arcs that a block's texts can reach.

    A state is an n-gram of fewer than `order` words that training texts have; state 0 has none. The arc of a word leads to the
    longest state that ends the extended n-gram and weighs log10 of its probability; without such an arc the failure arc, which
    reads nothing, leads to the state without its first word and weighs log10 of the mass that is left for it. Arcs are found by
    the hash of the extended n-gram. Probabilities are (count + backoff * shorter) / (state's count + backoff), where shorter is the
    probability in the state of the failure arc, and in state 0 (count + 1) / (tokens + words + 1): they add up to 1 in each state.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, words: int, backoff: float = BACKOFF):
        self.order, self.unknown = len(counts), -np.log10(tokens + words + 1.0)
        keys, key, probability, fail = [], [np.zeros(1, np.uint64)], [np.ones(1)], [np.zeros(1, np.int64)]
        count, to, offset, shorter = [np.array([tokens])], [np.zeros(1, np.int64)], 1, None
        for n, own in enumerate(counts, 1):
            found, last = block.grams(n)
            k, where = np.unique(found, return_index=True)
            if n == 1:
                p, f, self.one = (own + 1) / (tokens + words + 1), np.zeros(len(k), np.int64), k
            else:
                place = last[where]
                tails, heads = self._at(block, n - 1, place, shorter), self._at(block, n - 1, place - 1, shorter)
                c = counts[n - 2]
                p = (own + backoff * probability[-1][tails]) / (c[heads] + backoff)
                f = offset - len(shorter) + tails
            keys.append(k), key.append(k), probability.append(p), fail.append(f), count.append(own)
            to.append(np.arange(offset, offset + len(k)) if n < self.order else f)
            shorter, offset = k, offset + len(k)
        self.key, self.count = np.concatenate(key), np.concatenate(count)
        self.weight, self.fail, self.to = np.log10(np.concatenate(probability)), np.concatenate(fail), np.concatenate(to)
        self.left = np.log10(backoff / (self.count + backoff))
        arcs = np.flatnonzero((self.count > 0) & (self.key != OPEN))[1:] if tokens else np.zeros(0, np.int64)
        self.arcs = arcs[np.argsort(self.key[arcs])]
        self.arc_keys = self.key[self.arcs]
        at_open = np.searchsorted(self.one, OPEN)
        self.open = 1 + int(at_open) if at_open < len(self.one) and self.one[at_open] == OPEN and counts[0][at_open] and self.order > 1 else 0

    @staticmethod
    def _at(block: Block, n: int, last: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams that end there."""
        h = block.hashes[last - n + 1]
        for k in range(1, n):
            h = extended(h, block.hashes[last - n + 1 + k])
        return np.searchsorted(keys, h)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and what it weighs to get there."""
        state, weight, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            now = state[todo]
            wanted = np.where(now == 0, word[todo], extended(self.key[now], word[todo]))
            at = np.searchsorted(self.arc_keys, wanted)
            hit = np.zeros(len(todo), bool)
            inside = at < len(self.arc_keys)
            hit[inside] = self.arc_keys[at[inside]] == wanted[inside]
            arc = self.arcs[at[hit]]
            weight[todo[hit]] += self.weight[arc]
            state[todo[hit]] = self.to[arc]
            lost = ~hit & (now == 0)
            weight[todo[lost]] += self.unknown
            rest = ~hit & ~lost
            weight[todo[rest]] += self.left[now[rest]]
            state[todo[rest]] = self.fail[now[rest]]
            todo = todo[rest]
        return state, weight

    def scores(self, block: Block) -> np.ndarray:
        """log10 of the probability of each text. Texts go side by side; a lane that begins inside a text reads order - 1 tokens for the state first."""
        warm = self.order - 1
        n = block.ends - block.starts - 1
        cuts = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), cuts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        inner = nth > 0
        first = block.starts[text] + 1 + nth * LANE - warm * inner
        last = np.minimum(block.starts[text] + 1 + (nth + 1) * LANE, block.ends[text])
        order = np.argsort(first - last, kind="stable")
        text, inner, first, size = text[order], inner[order], first[order], (last - first)[order]
        state = np.where(inner, 0, self.open)
        total = np.zeros(len(text))
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))
            state[:live], weight = self.step(state[:live], block.hashes[first[:live] + t])
            if t < warm:
                weight[inner[:live]] = 0
            total[:live] += weight
        return np.bincount(text, weights=total, minlength=len(n))


def score_texts(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, drop: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """docs with held_out, n_tokens, n_known, train_tokens, base_score and score, in place of any columns of these names.

    Tokens are the words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, and one end; the model, a backoff automaton of n-grams of
    up to `order` words, is learned from the rows that aren't held out. n_known: tokens that training texts have. base_score: the sum of
    log10((c + 1) / (N + 1 * (V + 1))), c the token's count in training, N all training tokens, V the different ones. score: the
    automaton's log10 probability of the tokens. A null text is an empty one, which is an end; a null doc_id is never held out; rows
    that repeat are texts of their own. Nothing to learn from: every token is unknown, and both scores are 0. No rows: none come out.

    Words and n-grams are told apart by 64-bit hashes. Texts are written once to spark.checkpoint.dir as numbers of words; each
    block's n-grams travel once to the task of their range and the counts back.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "scoring")
    bound_batches(spark)
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in docs.columns if c not in (*new, *drop)]
    inside = T.StructType([*(docs.schema[c] for c in names)])
    out = T.StructType([*inside, T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in new[1:4]), *(T.StructField(c, T.DoubleType()) for c in new[4:])])
    blocks = scratch.put(block_rows(docs, names, block_bytes), "blocks", compression="zstd")
    tokens, grams = blocks.agg(F.sum("train_tokens"), F.sum("grams")).first()
    if grams is None:
        return spark.createDataFrame([], out)
    tokens, parts = tokens or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, -(-grams // range_grams))
    asked = questions(blocks, order, ranges).repartition(max(parts, ranges // 4), "slot")
    told = scratch.put(answers(asked), "answers", compression="zstd")
    words = told.where("n = 1").agg(F.sum("known")).first()[0] or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.select(["n", "range", "size", "counts"]).sort_by([("n", "ascending"), ("range", "ascending")])
        counts = [np.concatenate([unpacked(c, size) for m, size, c in zip(right.column("n").to_pylist(), right.column("size").to_pylist(), right.column("counts").to_pylist(), strict=True) if m == n] or [np.zeros(0, np.uint64)]).astype(np.int64) for n in range(1, order + 1)]
        row = _read(left, 0)
        block, rows = _block(row), left.column("docs")[0].values
        # The end of each text but its OPEN; n-grams that none of a block has leave an empty array.
        n = block.ends - block.starts - 1
        of_word = counts[0][np.searchsorted(np.unique(block.hashes), np.frombuffer(row["words"], np.uint64))]
        c = of_word[unpacked(row["ids"], row["n_ids"]).astype(np.int64)]
        text = np.repeat(np.arange(len(n)), n + 1)
        token = block.at > 0
        base = np.bincount(text[token], weights=np.log10((c[token] + 1) / (tokens + 1 * (words + 1))), minlength=len(n))
        columns = [rows.field(i) for i in range(len(names) + 1)]
        columns += [pa.array(n), pa.array(np.bincount(text[token & (c > 0)], minlength=len(n))), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(Automaton(block, counts, tokens, words, backoff).scores(block))]
        return pa.Table.from_arrays(columns, schema=to_arrow_schema(out))

    sent = blocks.selectExpr("block", "n_docs", "n_ids", "docs", "ends", "ids", "words", HELD)
    return sent.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, out)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
