"""Conversation structure repair: the cheapest edits that make the roles of a conversation fit a grammar.

Three weighted automata are composed lazily, turn by turn: the acceptor of the turns (a line of states), the edit transducer
(`edits`, `INSERTS`) and the grammar of roles (`GRAMMAR`). Only composed states that some path reaches are made; they come in
topological order, so that one pass finds the shortest path over weights (cost, labels), compared in that order.

A prefix may be chosen before what follows is known: given a state and labels, the grammar leaves one path, so that two paths to
one state never have one cost and labels of which one begins with the other (what is longer has inserts, which cost).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, table, tidy

#: States of `(s?(ua)+)?` and where each initial leads; a path may end in START or WHOLE.
START, SYSTEM, ASKED, WHOLE = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": WHOLE}, WHOLE: {"u": ASKED}}
FINAL = (START, WHOLE)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What a path to any state costs at most more, from another state on, than the best one from there: two inserts and a delete.
SLACK = 2 * INSERT + DELETE
#: Turns after which labels that all paths share are stored as bytes.
FLUSH = 512
INSERTS = [("I", symbol, INSERT) for symbol in ROLES]
SPACES = " \t\n\x0b\x0c\r"


def edits(initial: str, fault: str) -> list[tuple[str, str | None, int]]:
    """Arcs of the edit transducer for a turn: label, initial of what comes out (None: nothing), cost."""
    if fault in ("blank", "duplicate"):
        return [("D", None, DELETE)]
    stays = TRUNCATED if fault == "truncated" else 0
    return [("D", None, DELETE), ("K", initial, stays), *(("R", symbol, REROLE + stays) for symbol in ROLES)]


class Path:
    """The labels of a path as a list linked backwards."""

    __slots__ = ("before", "depth", "label")

    def __init__(self, before: Path | None, label: str):
        self.before, self.label, self.depth = before, label, before.depth + 1 if before else 0

    def less(self, other: Path) -> bool:
        """By labels, from where the two part."""
        a, b, one, two = self, other, [], []
        while a is not b:
            if a.depth >= b.depth:
                one.append(a.label)
                a = a.before
            else:
                two.append(b.label)
                b = b.before
        return one[::-1] < two[::-1]


class Repair:
    """Shortest path over the turns of one conversation, as they come.

    Kept: for each state of the grammar that a path reaches its cost, labels and the running hash of its output; labels that
    all paths share are bytes. So memory doesn't grow with texts, and by a byte a turn with turns as soon as paths have met.
    """

    def __init__(self) -> None:
        self.paths, self.known, self.turns = {START: (0, Path(None, ""), None)}, bytearray(), 0
        self._insert()

    def _relax(self, into: dict, state: int, cost: int, path: Path, label: str, out: tuple) -> None:
        old = into.get(state)
        if old and cost > old[0]:
            return
        new = Path(path, label)
        if old is None or cost < old[0] or new.less(old[1]):
            into[state] = (cost, new, out)

    def _insert(self) -> None:
        """Arcs that read no turn, from each state in order of cost; two in a row at most are of use."""
        for _ in range(2):
            for state in sorted(self.paths, key=lambda s: self.paths[s][0]):
                cost, path, hashed = self.paths[state]
                for label, symbol, more in INSERTS:
                    to = GRAMMAR[state].get(symbol)
                    if to is not None:
                        self._relax(self.paths, to, cost + more, path, label, (hashed, f"{ROLES[symbol]}:"))
        self.paths = {s: (c, p, _hashed(h)) for s, (c, p, h) in self.paths.items()}

    def add(self, role: str, text: str, fault: str) -> None:
        new: dict = {}
        for state, (cost, path, hashed) in self.paths.items():
            for label, symbol, more in edits(role[:1], fault):
                to = state if symbol is None else GRAMMAR[state].get(symbol)
                if to is not None:
                    self._relax(new, to, cost + more, path, label, hashed if symbol is None else (hashed, role if label == "K" else ROLES[symbol], text))
        best = min(c for c, _, _ in new.values())
        self.paths = {s: (c, p, _hashed(h)) for s, (c, p, h) in new.items() if c <= best + SLACK}
        self._insert()
        self.turns += 1
        if self.turns % FLUSH == 0:
            self._flush()

    def _flush(self) -> None:
        paths = [p for _, p, _ in self.paths.values()]
        shared = paths[0]
        for p in paths[1:]:
            while shared is not p:
                if shared.depth >= p.depth:
                    shared = shared.before
                else:
                    p = p.before  # noqa: PLW2901
        labels, p = bytearray(), shared
        while p.before:
            labels += p.label.encode()
            p = p.before
        labels.reverse()
        self.known += labels
        shared.before, shared.label = None, ""

    def close(self) -> tuple[int, str, str]:
        """Cost, labels, SHA-256 of the repaired turns."""
        ends = [self.paths[s] for s in FINAL if s in self.paths]
        best = ends[0]
        for other in ends[1:]:
            if other[0] < best[0] or other[0] == best[0] and other[1].less(best[1]):
                best = other
        labels, p = [], best[1]
        while p:
            labels.append(p.label)
            p = p.before
        return best[0], self.known.decode() + "".join(reversed(labels)), (best[2] or hashlib.sha256()).hexdigest()


def _hashed(h: object):
    """The running hash of an output; a tuple is one with a turn's role and text to add."""
    if not isinstance(h, tuple):
        return h
    before = _hashed(h[0])
    out = before.copy() if before else hashlib.sha256()
    out.update(f"{chr(10) if before else ''}{':'.join(h[1:])}".encode())
    return out


def conversations(batches: Iterator[pa.RecordBatch], key: str = "conv_id") -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows that come sorted by key as one iterator a key."""
    rows = (dict(zip(names, values, strict=True)) for b in batches for names in [b.schema.names] for values in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)

    def own(conv):
        nonlocal row
        while row is not None and row[key] == conv:
            yield row
            row = next(rows, None)

    while row is not None:
        conv = row[key]
        group = own(conv)
        yield conv, group
        for _ in group:  # what the caller left
            pass


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, with known faults: by crc32 of `conv_id:turn` modulo 20 a turn is dropped (0: gone, so that its
    conversation is still known), loses its text (1) or `[.!?]` (2), comes twice (3) or is a user's (4). Nulls of the name, role and text are one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), (fate == 0).alias("gone"), fate.alias("fate"))
    return out.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows with `mark` (role and text, as a digest), `late` (an earlier turn has these), `blank` and `cut` (the last visible character ends no sentence)."""
    seen = F.trim(F.col("text"), F.lit(SPACES))
    mark = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumns({"mark": mark, "blank": seen == "", "cut": ~F.substring(seen, -1, 1).isin(".", "!", "?"), "at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    first = rows.where(~F.col("gone")).groupBy(F.col("conv_id").alias("conv"), F.col("mark").alias("first_mark")).agg(F.min("at").alias("first_at"))
    on: Column = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("mark") == F.col("first_mark"))
    return rows.join(first, on, "left").select("conv_id", "turn", "role", "text", "gone", "mark", "blank", "cut", (F.col("at") > F.col("first_at")).alias("late"))


def in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "text")


RESULT = [*(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
TURNS = [T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]


def _batches(rows: Iterable[tuple], schema: T.StructType, size: int = 1000) -> Iterator[pa.RecordBatch]:
    arrow, rows = to_arrow_schema(schema), iter(rows)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)


def repair(rows: DataFrame) -> DataFrame:
    """A row a conversation of `conv_id, turn, role, text` (and `gone`: turns of which only the conversation counts).

    Turns come by `turn`, nulls first, ties by role and text. The first fault of a turn counts: blank (no `[^\\x20\\x09-\\x0D]`), duplicate
    (role and text seen earlier in the conversation), truncated (its last such character is none of `.!?`). `audit` has the initials of
    the cheapest edits, the least string of those with one cost: Keep, Rerole, Delete, Insert. A turn is kept under its own role, whose
    first character counts; a null role or text is one space, an empty role fits nothing. `repaired_sha256` is of `role:text` lines.
    gaps: turn numbers missing between the least and the greatest, nulls left out. illegal: neighbours whose initials aren't su, ua or au.
    A null conv_id is a conversation. One without turns has zeros and an empty audit. No rows: none come out. Other columns are left out.

    A conversation is read by one task, as its hash must be, but as a stream: it is sorted by Spark and never held. Duplicates are
    told by least turns, aggregated before they are shuffled.
    """
    bound_batches(rows.sparkSession)
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), "gone")
    schema = T.StructType([rows.schema["conv_id"], *RESULT])

    def repaired(batches):
        for conv, turns in conversations(batches):
            path, counts, illegal, least, last, distinct, before, mark = Repair(), dict.fromkeys(("blank", "duplicate", "truncated", ""), 0), 0, None, None, 0, None, None
            for t in turns:
                if t["gone"]:
                    continue
                number = t["turn"]
                if number is not None:
                    least, distinct, last = (number if least is None else least), distinct + (number != last), number
                same = mark == (number, t["mark"])
                fault = "blank" if t["blank"] else "duplicate" if t["late"] or same else "truncated" if t["cut"] else ""
                counts[fault] += 1
                illegal += before is not None and before + t["role"][:1] not in LEGAL
                before, mark = t["role"][:1], (number, t["mark"])
                path.add(t["role"], t["text"], fault)
            cost, audit, digest = path.close()
            gaps = last - least + 1 - distinct if distinct else 0
            yield conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest

    return in_order(with_faults(rows)).mapInArrow(tidy(lambda batches: _batches(repaired(batches), schema)), schema)


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations; rows and repaired as of `repair`."""
    bound_batches(rows.sparkSession)
    if "gone" in rows.columns:
        rows = rows.where(~F.col("gone"))
    schema = T.StructType([rows.schema["conv_id"], *TURNS])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    both = rows.select("conv_id", F.lit(1).alias("side"), "turn", role, text).unionByName(repaired.select("conv_id", F.lit(0).alias("side"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")))

    def turns(batches):
        for conv, group in conversations(batches):
            audit = next(group)["text"]
            size = len(audit) - audit.count("D")
            place = 0
            for label in audit:
                row = {"role": "", "text": ""} if label == "I" else next(group)
                if label == "D":
                    continue
                # The number of turns tells whether a system turn is the first, and so the role at each place.
                own = row["role"] if label == "K" else ROLES["ua"[(place - size % 2) % 2]]
                yield conv, place, own, row["text"]
                place += 1

    return in_order(both, "side").mapInArrow(tidy(lambda batches: _batches(turns(batches), schema, 100)), schema)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _added(value: str, cost: str, label: str) -> str:
    return f"printf('%012d', left({value}, 12)::BIGINT + {cost}) || '{label}' || {value}[13:]"


def _cheapest(state: int) -> str:
    """SQL for the least weight from a turn on, in this state, if it is deleted, kept or given another role."""
    stays = [_added(f"v{state}", "2", "D")]
    for symbol, to in GRAMMAR[state].items():
        stays.append(f"CASE WHEN NOT forced AND initial = '{symbol}' THEN {_added(f'v{to}', 'more', 'K')} END")
        if symbol in ROLES:
            stays.append(f"CASE WHEN NOT forced THEN {_added(f'v{to}', '1 + more', 'R')} END")
    return f"least({', '.join(stays)}) AS r{state}"


# Weights are costs of twelve digits with the labels behind them, from the last turn back to the first.
SQL12 = rf"""
WITH RECURSIVE t8(n, i, v) AS (SELECT range, 0, range FROM range(256) UNION ALL
  SELECT n, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t8 WHERE i < 8),
crcs AS MATERIALIZED (SELECT list(v ORDER BY n) AS tab FROM t8 WHERE i = 8),
r AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
step(name, h, pos, crc) AS (SELECT DISTINCT name, hex(encode(name)), 1, 4294967295 FROM r UNION ALL
  SELECT name, h, pos + 2, xor(crc >> 8, tab[1 + (xor(crc, (strpos('0123456789ABCDEF', h[pos]) - 1) * 16 + strpos('0123456789ABCDEF', h[pos + 1]) - 1) & 255)])
  FROM step, crcs WHERE pos < length(h)),
f AS (SELECT r.*, xor(crc, 4294967295) % 20 AS fate FROM r JOIN step USING (name) WHERE pos > length(h)),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
c AS MATERIALIZED (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair,
  CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY 1),
e AS (SELECT conv_id, pos, initial, fault IN ('blank', 'duplicate') AS forced, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM c),
dp(conv_id, pos, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, '000000000000', '000000000010II', '000000000005I', '000000000000' FROM n
  UNION ALL
  SELECT conv_id, pos, least(r0, {_added("s2", "5", "I")}), least(r1, {_added("s2", "5", "I")}), s2, s3 FROM (
    SELECT *, least(r2, {_added("r3", "5", "I")}) AS s2, least(r3, {_added("r2", "5", "I")}) AS s3 FROM (
      SELECT e.conv_id, e.pos, {", ".join(_cheapest(s) for s in GRAMMAR)} FROM dp JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.pos = dp.pos - 1))),
a AS MATERIALIZED (SELECT conv_id, left(v0, 12)::BIGINT AS cost, v0[13:] AS audit FROM dp WHERE pos = 1),
l AS (SELECT conv_id, i, audit[i] AS label, length(translate(audit[1:i], 'I', '')) AS pos, length(translate(audit[1:i - 1], 'D', '')) AS place, length(translate(audit, 'D', '')) AS size
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM a)),
h AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN label = 'K' THEN role WHEN (place - size % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS sha
  FROM l LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.pos = l.pos WHERE label <> 'D' GROUP BY 1)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM g.conv_id
"""
