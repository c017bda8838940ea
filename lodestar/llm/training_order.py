"""Token-ID output: fixed-stride shards in the order of a keyed permutation."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mixed, table, tidy

#: A public byte-level BPE of 50,256 ids; the next id ends a document and fills the last sequence.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern by which that vocabulary's pre-tokens are found.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SINGLE = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
END = 50256
#: Tokens of a sequence, slots of a shard file at least (about 17 MB), and shard files at most, which then grow.
LENGTH, SHARD_SLOTS, MOST_SHARDS = 2048, 4096, 100_000
KEY, ROUNDS = 20240817, 6
#: Little-endian: slot, sequence, first and last doc_id, number of tokens before the filling; then LENGTH 16-bit ids, then a line feed.
HEADER = "<qqqqq"
#: What stands for a null doc_id in a record.
NO_DOC = -(1 << 63)


class Encoder:
    """Encodes whole texts. Where no two white-space characters meet, a pattern without look-ahead finds the same pre-tokens, faster."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.single, self.pair = ranks, self.encoding(ranks, SINGLE), re.compile(r"\s\s").search

    @staticmethod
    def encoding(ranks: dict[bytes, int], pattern: str):
        import tiktoken

        return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def any(self):
        return self.encoding(self.ranks, PATTERN)

    def __call__(self, text: str) -> list[int]:
        return self.any(text) if self.pair(text) else self.single(text)


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def permuted(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Where each of 0..n-1 goes by a Feistel network keyed with key; values of n or more walk on until they fall below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key))
    out = np.asarray(x, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def _encoded(batches, encoder: Encoder) -> Iterator[tuple[int, list[int]]]:
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoder(text.as_py() or "")
            if ids:
                ids.append(END)
                yield doc, ids


def shard_size(n: int, least: int = SHARD_SLOTS, most_shards: int = MOST_SHARDS) -> int:
    """Slots of a shard file of n sequences."""
    return max(least, -(-n // most_shards))


def write_shards(docs: DataFrame, path: str, ranks: dict[bytes, int], length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> int:
    """Writes all texts' tokens below path and returns the number of sequences.

    The texts, each with END after it, follow one another in the order of docs' partitions and rows; every `length` tokens
    are a sequence, the last filled with END. Sequence i is in slot permuted(i); shard s holds shard_size(n) slots, of which
    there are shard_slots at least, one record after another, in the file part-s of fixed stride. Null and empty texts have no
    tokens; rows that repeat are texts of their own; a null doc_id stays null; other columns are left out. No tokens: no file.

    docs is read twice and must have the same partitions both times, as tables in files do; a task that finds
    other totals than the first time fails. Every token moves once, to its shard, and no count of them to the driver but one a task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(ranks)

    def count(batches):
        texts = tokens = 0
        for _, ids in _encoded(batches, Encoder(sent.value)):
            texts, tokens = texts + 1, tokens + len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (TaskContext.get().partitionId(), texts, tokens)], names=["part", "texts", "tokens"])

    totals = sorted(docs.mapInArrow(tidy(count), "part long, texts long, tokens long").collect())
    starts, at = {}, 0
    for r in totals:
        starts[r["part"]] = (at, r["texts"], r["tokens"])
        at += r["tokens"]
    n = -(-at // length)
    if not n:
        return 0
    offsets, shard_slots = spark.sparkContext.broadcast(starts), shard_size(n, shard_slots)

    def cut(batches):
        """Pieces of sequences: shard, slot, seq, first token's place, doc_ids, tokens."""
        part = TaskContext.get().partitionId()
        start, want_texts, want_tokens = offsets.value.get(part, (0, 0, 0))
        texts, tokens, place, held, docs_of, rows = 0, 0, start, bytearray(), [], []

        def piece(size: int):
            nonlocal place, docs_of
            rows.append((place // length, place % length, docs_of[0], docs_of[-1], bytes(held[: 2 * size])))
            del held[: 2 * size]
            place += size
            docs_of = docs_of[-1:]

        def batch():
            seq = np.array([r[0] for r in rows], np.int64)
            slot = permuted(seq, n, key)
            out = pa.RecordBatch.from_arrays([pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot), pa.array(seq), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.binary())], names=["shard", "slot", "seq", "at", "first_doc", "last_doc", "tokens"])
            rows.clear()
            return out

        for doc, ids in _encoded(batches, Encoder(sent.value)):
            texts, tokens = texts + 1, tokens + len(ids)
            docs_of = docs_of if held else []
            held += np.array(ids, np.uint16).tobytes()
            docs_of.append(doc)
            while len(held) // 2 >= length - place % length:
                piece(length - place % length)
            if len(rows) >= 500:
                yield batch()
        if held:
            piece(len(held) // 2)
        if (texts, tokens) != (want_texts, want_tokens):
            raise RuntimeError(f"partition {part} has {texts} texts and {tokens} tokens; it had {want_texts} and {want_tokens} before")
        if rows:
            yield batch()

    def records(batches):
        """Whole records from pieces that come in order of slots and places."""
        now, slot, first, last, body, rows = None, None, None, None, b"", []

        def close():
            ids = body + np.full(length - len(body) // 2, END, np.uint16).tobytes()
            rows.append(struct.pack(HEADER, slot, now, first, last, len(body) // 2) + ids)

        for batch in batches:
            for at_slot, seq, a, b, tokens in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6)), strict=True):
                if seq != now:
                    if now is not None:
                        close()
                    now, slot, first, body = seq, at_slot, a, b""
                last, body = b, body + tokens
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
                rows = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    pieces = docs.mapInArrow(tidy(cut), "shard int, slot long, seq long, at int, first_doc long, last_doc long, tokens binary")
    pieces = pieces.repartitionById(-(-n // shard_slots), F.col("shard")).sortWithinPartitions("slot", "at")
    pieces.mapInArrow(tidy(records), "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)
    return n


def read_slots(spark: SparkSession, path: str, first: int = 0, length: int = LENGTH) -> DataFrame:
    """Records from slot `first` on: slot, shard, byte_offset, seq, n_tokens, first_doc_id, last_doc_id, tokens (binary).

    Files are read record by record of the fixed stride, a large one by several tasks; no task holds one. A reader that
    stopped goes on from its slot: files of earlier shards are not opened. A folder without shards gives no rows.
    """
    schema = "slot long, shard long, byte_offset long, seq long, n_tokens long, first_doc_id long, last_doc_id long, tokens binary"
    stride, head = struct.calcsize(HEADER) + 2 * length + 1, struct.calcsize(HEADER)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")  # contents are not read
    shards = sorted((int(re.search(r"part-(\d+)", f["path"])[1]), f["path"], f["length"] // stride) for f in files.collect())
    slots = max((x[2] for x in shards), default=0)  # all files but the last one are full
    wanted = [file for shard, file, _ in shards if (shard + 1) * slots > first]
    if not wanted:
        return spark.createDataFrame([], schema)

    def parsed(records):
        for r in records:
            slot, seq, a, b, n = struct.unpack(HEADER, r[:head])
            if slot >= first:
                yield slot, slot // slots, slot % slots * stride, seq, n, None if a == NO_DOC else a, None if b == NO_DOC else b, bytearray(r[head:-1])

    return spark.createDataFrame(spark.sparkContext.binaryRecords(",".join(wanted), stride).mapPartitions(parsed), schema, verifySchema=False)


def in_training_order(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Writes the shards of docs and returns a row for each record, as read from them, with the SHA-256 of its ids in place of them."""
    path = Scratch(docs.sparkSession, "shards").path
    schema = "slot long, shard long, byte_offset long, seq long, n_tokens long, first_doc_id long, last_doc_id long, tokens_sha256 string"
    if not write_shards(docs, path, vocabulary(vocabulary_path)):
        return docs.sparkSession.createDataFrame([], schema)
    return read_slots(docs.sparkSession, path).withColumn("tokens_sha256", F.sha2("tokens", 256)).drop("tokens")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_training_order(table(spark, sf_dir, "documents"))


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the records of all documents in training order."""
    return in_training_order(docs)
