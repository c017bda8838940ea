"""Many words sought in many texts at once, by an automaton of all words that reads each text once."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Functions sent to executors travel by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: UTF-8 bytes of words in one automaton, which takes some fifty times as much; more words take several, and texts are read once for each.
MOST_BYTES = 2 << 20
#: Characters that a word must not have beside it if it is to stand alone.
JOINED = frozenset("abcdefghijklmnopqrstuvwxyz0123456789#+")


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        out.add_word(w)
    out.make_automaton()
    return out


def _stands_alone(text: str, start: int, end: int) -> bool:
    return (start == 0 or text[start - 1] not in JOINED) and (end == len(text) or text[end] not in JOINED)


def _counts(automaton: ahocorasick.Automaton, text: str, alone: bool) -> Iterator[tuple[str, int]]:
    found: Counter = Counter()
    for last, size in automaton.iter(text):
        if not alone or _stands_alone(text, last + 1 - size, last + 1):
            found[text[last + 1 - size : last + 1]] += 1
    return iter(found.items())


def _longest(automaton: ahocorasick.Automaton, text: str) -> Iterator[tuple[str, int]]:
    size, word = min(((-n, text[last + 1 - n : last + 1]) for last, n in automaton.iter(text)), default=(0, None))
    return iter([(word, -size)] if word is not None else [])


def _run(texts: DataFrame, key: str, column: str, words: DataFrame, find: Callable, number: str) -> DataFrame:
    """key, word and a number of what `find` gives for each text, for all words; each part of the words is a pass of its own."""
    spark = texts.sparkSession
    words = words.select(F.col(words.columns[0]).alias("word")).where("word != ''").distinct()
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    parts = -(-size // MOST_BYTES)
    schema = T.StructType([texts.schema[key], T.StructField("word", T.StringType()), T.StructField(number, T.LongType())])
    out = spark.createDataFrame([], schema)
    for part in range(parts):
        own = words if parts == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([r[0] for r in own.collect()])  # about MOST_BYTES

        def read(batches, sent=sent):
            arrow, automaton = to_arrow_schema(schema), _automaton(sent.value) if sent.value else None
            for batch in batches:
                hits = [(k, *hit) for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text and automaton for hit in find(automaton, text)]
                for i in range(0, len(hits), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits[i : i + 10_000], strict=True), arrow, strict=True)], schema=arrow)

        found = texts.select(key, column).mapInArrow(read, schema)
        out = found if parts == 1 else out.unionByName(found)
    return out


def counted(texts: DataFrame, key: str, column: str, words: DataFrame, alone: bool = False) -> DataFrame:
    """key, word, n: how often each word of the first column of words is in a text, overlaps counted; words that aren't have no row.

    alone: only where no lower-case letter, digit, # or + is beside it. Case counts, so both sides are lowered before where it should not.
    Null and empty texts and words have no rows; rows that repeat a key are texts of their own.
    """
    return _run(texts, key, column, words, lambda a, text: _counts(a, text, alone), "n")


def longest(texts: DataFrame, key: str, column: str, words: DataFrame) -> DataFrame:
    """key, word, size: the longest word (in characters) that is in a text, the least of several; no row for a text without any."""
    found = _run(texts, key, column, words, _longest, "size")
    return found.groupBy(key).agg(F.min(F.struct((-F.col("size")).alias("less"), "word")).alias("b")).select(key, "b.word", (-F.col("b.less")).alias("size"))
