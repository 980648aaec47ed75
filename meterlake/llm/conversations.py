"""Repair of conversation structure, each distinct signature solved once.

A conversation's rows become a signature: one character a row for its role, upper
case where its text is cut short, ``x`` where the row is blank or a repeat and has
to go. The cheapest edits depend on the signature alone, so Spark solves the
distinct ones, joins the audits back by signature, and replays the edits on the
rows.

Conversations are read as streams of sorted rows, never gathered: a task holds
one conversation's signature and the digests of its rows, not its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, read

#: Fixed costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The replay needs no more than these to know a role.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Bytes of signatures up to which their audits are broadcast.
BROADCAST_BYTES = 4 << 20

#: cost and audit from a state to a state
Table = dict[tuple[int, int], tuple[int, str]]


def _least(table: Table, way: tuple[int, int], cost: int, audit: str) -> None:
    """Keep the cheaper one, of equal costs the ASCII-least audit."""
    if way not in table or (cost, audit) < table[way]:
        table[way] = (cost, audit)


def _inserts() -> Table:
    """Up to two inserts: a third would only lead where one does."""
    out: Table = {(s, s): (0, "") for s in STATES}
    for s in STATES:
        one = NEXT[(s, DUE[s])]
        _least(out, (s, one), INSERT, "I")
        _least(out, (s, NEXT[(one, DUE[one])]), 2 * INSERT, "II")
    return out


def _chain(left: Table, right: Table) -> Table:
    # audits of one stretch and equal cost are never prefixes of each other, so the least of the parts are the least of the whole
    out: Table = {}
    for (a, b), (cost, audit) in left.items():
        for c in STATES:
            if (b, c) in right:
                more, rest = right[(b, c)]
                _least(out, (a, c), cost + more, audit + rest)
    return out


INSERTS = _inserts()


@lru_cache(maxsize=1 << 12)
def _ways(signature: str) -> Table:
    """The cheapest way between any two states over a stretch of rows: of one row, inserts and its edit; of more, two halves."""
    if len(signature) > 1:
        half = len(signature) // 2
        return _chain(_ways(signature[:half]), _ways(signature[half:]))
    own: Table = {(s, s): (DELETE, "D") for s in STATES}
    if signature != "x":
        more = TRUNCATED if signature.isupper() else 0
        for s in STATES:
            _least(own, (s, NEXT[(s, DUE[s])]), REROLE + more, "R")
            if (s, signature.lower()) in NEXT:
                _least(own, (s, NEXT[(s, signature.lower())]), KEEP + more, "K")
    return _chain(INSERTS, own)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, of equal costs the ASCII-least audit.

    Recursion halves the signature, so its depth is the logarithm of the rows, and
    remembers stretches that signatures share.
    """
    ways = _chain(_ways(signature), INSERTS) if signature else INSERTS
    return min(ways[(0, s)] for s in FINAL if (0, s) in ways)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [solve(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.string())], ["signature", "cost", "audit"])


SCANNED = "conv_id {0}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
REPAIRED = SCANNED + ", cost long, audit string, repaired_sha256 string"


class _Scan:
    """Counts of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.signature, self.seen = conv, bytearray(), set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.first, self.last, self.before = 0, 0, None, None, None

    def row(self, turn, initial: str, fault: str, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if fault != "blank" and digest in self.seen:
            fault = "duplicate"
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        letter = initial if initial in ("s", "u", "a") else "o"
        self.signature += (b"x" if fault in ("blank", "duplicate") else letter.upper().encode() if fault else letter.encode())

    def told(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, self.signature.decode(), gaps, *self.counts.values(), self.illegal)


def _scanned(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, out = None, []
        for batch in batches:
            for conv, turn, dropped, initial, fault, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if scan is None or conv != scan.conv:
                    if scan is not None:
                        out.append(scan.told())
                    scan = _Scan(conv)
                if not dropped:
                    scan.row(turn, initial, fault, digest)
            yield _rows(out, schema)
            out = []
        if scan is not None:
            yield _rows([scan.told()], schema)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Replay:
    """Edits of one conversation applied to its rows as they come; only the hash of what is repaired is kept."""

    def __init__(self, audit: str):
        self.edits, self.state, self.hash, self.empty = iter(re.findall(r"I*[KRD]|I+$", audit)), 0, hashlib.sha256(), True

    def _add(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty = False

    def _due(self, text: str) -> None:
        role = DUE[self.state]
        self._add(NAMES[role], text)
        self.state = NEXT[(self.state, role)]

    def row(self, role: str, text: str) -> None:
        edits = next(self.edits)
        for _ in range(len(edits) - 1):
            self._due("")
        if edits[-1] == "K":
            self._add(role, text)
            self.state = NEXT[(self.state, role[0])]
        elif edits[-1] == "R":
            self._due(text)

    def close(self) -> str:
        for _ in next(self.edits, ""):
            self._due("")
        return self.hash.hexdigest()


def _replayed(schema: pa.Schema):
    width = len(schema) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, replay, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                role, text = row[width:]
                if role is None:  # what is known of the next conversation
                    if replay is not None:
                        out.append((*told, replay.close()))
                    told, replay = row[:width], Replay(row[width - 1])
                else:
                    replay.row(role, text)
            yield _rows(out, schema)
            out = []
        if replay is not None:
            yield _rows([(*told, replay.close())], schema)

    return run


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped): one row in four or so damaged by the CRC-32 of its conversation and turn.

    Nulls are one space: null roles and texts in the rows, null keys in the checksum.
    Of 20 remainders, 0 drops the row (it stays as a mark of its conversation), 1
    empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it a user's.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    hurt = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), part.alias("part"))
    hurt = hurt.select(
        "conv_id",
        "turn",
        F.when(F.col("part") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("part") <= 1, F.lit("")).when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("part") == 0).alias("dropped"),
        F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def _fault(text: Column) -> Column:
    return F.when(~text.rlike(WORD), "blank").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, dropped): what is wrong with it, the cheapest repair, and the repaired text's SHA-256.

    Rows come in order of turn (null turns first; rows of one turn by role and
    text, so a repeat follows its original). ``gaps`` counts turns that are missing
    between the first and the last. Rows of a null conv_id are one conversation. A
    conversation whose rows are all dropped has zeros, an empty audit and the hash
    of nothing. Texts of any length are hashed as they stream; an empty table gives
    no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    text, role = F.col("text"), F.col("role")
    order = ["conv_id", "turn", "role", "text"]
    flags = [F.substring("role", 1, 1).alias("initial"), _fault(text).alias("fault"), F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest")]
    sorted_ = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "dropped", *flags)
    scanned = materialize(sorted_.mapInArrow(_scanned(_schema(rows, SCANNED)), SCANNED.format(kind)), "conversations")

    distinct = scanned.groupBy("signature").agg(F.count(F.lit(1)).alias("conversations"))
    solved = materialize(distinct.select("signature").mapInArrow(_solved, "signature string, cost long, audit string"), "audits")
    size = solved.agg(F.sum(F.length("signature") + F.length("audit") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = scanned.join(F.broadcast(solved), "signature")
    else:  # one signature may stand for many conversations: cut over salts
        salts = 64
        salted = solved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = scanned.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int")).join(salted, ["signature", "salt"])
    head = met.select(*[c.split()[0] for c in REPAIRED.split(", ")[:-1]], F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(0).alias("after"))
    body = rows.filter(~F.col("dropped")).select("conv_id", "turn", role, text, F.lit(1).alias("after"))
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "after", "turn", "role", "text")
    known = [c.split()[0] for c in REPAIRED.split(", ")[:-1]]
    return both.select(*known, "role", "text").mapInArrow(_replayed(_schema(rows, REPAIRED)), REPAIRED.format(kind))


def _schema(rows: DataFrame, columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns.format(rows.schema["conv_id"].dataType.simpleString())))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations"))).drop("signature")


#: The same by the least way to each state after each row, with the repaired rows carried along.
SQL = r"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations),
part AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS p FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN p = 4 THEN 'user' ELSE role END AS role, CASE WHEN p = 1 THEN '' WHEN p = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN p = 3 THEN [0, 1] ELSE [0] END) AS copy FROM part WHERE p <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini FROM dam),
flt AS MATERIALIZED (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM ord),
cnt AS (SELECT c.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN flt ON c.conv_id IS NOT DISTINCT FROM flt.conv_id GROUP BY 1),
moves AS (SELECT * FROM (VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])) v(f, k, t, ins)),
ops AS (SELECT * FROM (VALUES (0, 'D', 0, 2, ''), (1, 'D', 1, 2, ''), (2, 'D', 2, 2, ''), (3, 'D', 3, 2, ''), (0, 'R', 2, 1, ''), (1, 'R', 2, 1, ''), (2, 'R', 3, 1, ''), (3, 'R', 2, 1, ''), (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'), (3, 'K', 2, 0, 'u')) v(f, e, t, cost, ini)),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS st, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS b FROM cnt
UNION ALL SELECT d.conv_id, d.i + 1, op.t, min({'c': (d.b.c + 5 * mv.k + op.cost + CASE WHEN r.fault = 't' AND op.e <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'a': d.b.a || repeat('I', mv.k) || op.e, 'o': list_concat(list_concat(d.b.o, mv.ins), CASE op.e WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE op.t WHEN 3 THEN 'assistant:' ELSE 'user:' END || r.text] END)})
FROM dp d JOIN flt r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1 JOIN moves mv ON mv.f = d.st JOIN ops op ON op.f = mv.t AND (op.e <> 'K' OR op.ini = r.ini) AND (op.e = 'D' OR r.fault NOT IN ('b', 'd')) GROUP BY 1, 2, 3),
fin AS (SELECT d.conv_id, min({'c': d.b.c + 5 * mv.k, 'a': d.b.a || repeat('I', mv.k), 'o': list_concat(d.b.o, mv.ins)}) AS b FROM dp d JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM d.conv_id AND cnt.n = d.i JOIN moves mv ON mv.f = d.st AND mv.t IN (0, 3) GROUP BY 1)
SELECT cnt.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit, sha256(array_to_string(b.o, chr(10))) AS repaired_sha256 FROM cnt JOIN fin ON cnt.conv_id IS NOT DISTINCT FROM fin.conv_id"""
