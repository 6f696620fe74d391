"""Conversation structure repair by signature deduplication.

Each row becomes one character, of its role's initial and its first fault, and each conversation the string of them, its
signature. Each distinct signature is solved once: one row's cheapest edits from each state of the grammar to each other,
and longer runs by memoised recursion on their halves. The solutions are joined back, and the rows, sorted, replay the
edits as they stream by, so that no conversation's texts are ever gathered.

Rows are numbered and strung together in runs of neighbouring turns; only a byte a row meets in one place, as the
audit itself does. SHA-256 is one value over all of a conversation's text, so its rows pass through one task, as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandsift.llm.common import materialize, strings

#: White space; what ends a text; a row's character by fault (none, truncated, blank, duplicate), for the
#: initials s, u, a and any other.
_SPACE = " \t\n\x0b\f\r"
_ENDS = ".!?"
FINE, TRUNCATED, BLANK, DUPLICATE = "suax", "SUAX", "0123", "4567"
#: Costs of the edits; Keep costs nothing.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
_RUN = 256

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
_EXPECTS = {0: "u", 1: "u", 2: "a", 3: "u"}
_THEN = {"s": 1, "u": 2, "a": 3}
_CLOSE = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}

#: For (from state, to state) the cheapest edits: their cost and initials.
Solution = dict[tuple[int, int], tuple[int, str]]


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): each row damaged by crc32('conv:turn') % 20, nulls being one space: 0 drops it
    (no copies), 1 empties the text, 2 takes '.!?' away, 3 repeats it (two copies), 4 sets the role 'user'."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said(conv_id), F.lit(":"), said(turn)).cast("binary")) % 20
    return rows.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(draw == 4, F.lit("user")).otherwise(said(role)).alias("role"),
        F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(said(text), _ENDS, "")).otherwise(said(text)).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


def _initial(role: Column) -> Column:
    at = F.instr(F.lit("sua"), F.substring(role, 1, 1))
    return F.when((F.length(role) == 0) | (at == 0), F.lit(4)).otherwise(at)


def signatures(damaged: DataFrame) -> DataFrame:
    """(conv, signature, gaps) of ``damaged`` rows (conv, turn, role, text, copies).

    Rows come in the order of turn (nulls first), role and the text's md5. Equal rows are one light row with their number.
    Whether role and text were there before is the least turn's of (conv, role, md5); characters are strung in runs of
    turns first, then by conversation."""
    ends = F.rtrim(F.col("text"), F.lit(_SPACE))
    light = damaged.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), _initial(F.col("role")).alias("at"), (ends == "").alias("blank"), (F.length(F.translate(F.substring(ends, -1, 1), _ENDS, "")) > 0).alias("cut"), "copies")
    light = light.groupBy("conv", "turn", "role", "digest", "at", "blank", "cut").agg(F.sum("copies").alias("copies"))
    # the first of each role and text, found and joined back, so that a text that fills a conversation can be split
    when = F.struct(F.col("turn").isNotNull(), "turn")
    first = light.where("copies > 0").groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(when).alias("_first"))
    light = light.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left").withColumn("again", F.coalesce(when > F.col("_first"), F.lit(False)))
    one = lambda chars: F.substring(F.lit(chars), F.col("at"), F.lit(1))
    first = F.when(F.col("blank"), one(BLANK)).when(F.col("again"), one(DUPLICATE)).when(F.col("cut"), one(TRUNCATED)).otherwise(one(FINE))
    rest = F.when(F.col("blank"), one(BLANK)).otherwise(one(DUPLICATE))
    shown = F.when(F.col("copies") == 0, F.lit("")).otherwise(F.concat(first, F.repeat(rest, (F.col("copies") - 1).cast("int"))))
    # runs of neighbouring turns, so that no task numbers a whole conversation; ties in one turn are cut by number
    light = light.select("conv", "turn", "role", "digest", "copies", shown.alias("shown"), F.floor(F.col("turn") / _RUN).alias("run"))
    own = Window.partitionBy("conv", "run").orderBy("turn", "role", "digest")
    held = F.when(F.col("copies") > 0, F.col("turn"))
    # rows of one turn are dropped together, so the row before tells whether a turn is new
    fresh = (held.isNotNull() & ~F.lag("turn").over(own).eqNullSafe(F.col("turn"))).cast("long")
    light = light.withColumns({"place": F.row_number().over(own), "fresh": fresh, "held": held})
    parts = light.groupBy("conv", "run", F.floor(F.col("place") / 1024).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("rows"), F.min("held").alias("low"), F.max("held").alias("high"), F.sum("fresh").alias("turns"))
    parts = parts.select("conv", F.struct("run", "part", F.array_join(F.transform("rows", lambda r: r["shown"]), "").alias("shown")).alias("piece"), "low", "high", "turns")
    whole = parts.groupBy("conv").agg(F.array_sort(F.collect_list("piece"), lambda a, b: _first(a, b)).alias("pieces"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"))
    gaps = F.when(F.col("high").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    return whole.select("conv", F.array_join(F.transform("pieces", lambda p: p["shown"]), "").alias("signature"), gaps.alias("gaps"))


def _first(a: Column, b: Column) -> Column:
    """Order of two pieces: by run, null runs first, then by part."""
    x, y = F.coalesce(a["run"], F.lit(-(2**63))), F.coalesce(b["run"], F.lit(-(2**63)))
    null = b["run"].isNull().cast("int") - a["run"].isNull().cast("int")
    return F.when(null != 0, null).when(x < y, -1).when(x > y, 1).when(a["part"] < b["part"], -1).when(a["part"] > b["part"], 1).otherwise(0)


@lru_cache(maxsize=None)
def _row(char: str) -> Solution:
    """Of one row, with up to two rows inserted before it."""
    fault = next(kind for kind in (FINE, TRUNCATED, BLANK, DUPLICATE) if char in kind)
    role = FINE[fault.index(char)]
    out: Solution = {}
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(3):
            options = [(DELETE, "D", state)]
            if fault in (FINE, TRUNCATED):
                extra = CUT * (fault == TRUNCATED)
                if role == _EXPECTS[state] or role == "s" and state == 0:
                    options.append((extra, "K", _THEN[role]))
                options.append((REROLE + extra, "R", _THEN[_EXPECTS[state]]))
            for more, edit, end in options:
                found = (cost + more, edits + edit)
                out[start, end] = min(out.get((start, end), found), found)
            state, cost, edits = _THEN[_EXPECTS[state]], cost + INSERT, edits + "I"
    return out


def _joined(a: Solution, b: Solution) -> Solution:
    """Of equal cost the ASCII-least stays. That is safe: of two edits of the same rows between the same states neither
    begins with the other, unless it costs more."""
    out: Solution = {}
    for (start, middle), (x, one) in a.items():
        for end in range(4):
            if (middle, end) in b:
                y, two = b[middle, end]
                old = out.get((start, end))
                if old is None or x + y < old[0] or x + y == old[0] and one + two < old[1]:
                    out[start, end] = (x + y, one + two)
    return out


@lru_cache(maxsize=20_000)
def _short(signature: str) -> Solution:
    return _solved(signature)


def _solved(signature: str) -> Solution:
    if len(signature) == 1:
        return _row(signature)
    middle = len(signature) // 2
    left, right = signature[:middle], signature[middle:]
    return _joined(*((_short if len(s) <= 32 else _solved)(s) for s in (left, right)))


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if not signature:
        return 0, ""
    return min((cost + _CLOSE[end][0], edits + _CLOSE[end][1]) for (start, end), (cost, edits) in _solved(signature).items() if start == 0)


def _illegal(signature: str) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    roles = signature.translate(str.maketrans(TRUNCATED + BLANK + DUPLICATE, FINE * 3))
    return sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def solved(found: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = strings(batch.column(0))
            results = [solve(s) for s in own]
            counts = [[sum(map(s.count, kind)) for s in own] for kind in (BLANK, DUPLICATE, TRUNCATED)]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (*counts, [_illegal(s) for s in own], [c for c, _ in results])), pa.array([a for _, a in results], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Replay:
    """Replays one conversation's edits on its rows as they come, and hashes the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.begun, self.sha = audit, 0, 0, False, hashlib.sha256()

    def _say(self, role: str, text: str) -> None:
        if self.begun:
            self.sha.update(b"\n")
        self.begun = True
        self.sha.update(f"{role}:{text}".encode("utf-8", "replace"))

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._say(self._next(), "")
            self.at += 1

    def _next(self) -> str:
        expected = _EXPECTS[self.state]
        self.state = _THEN[expected]
        return {"u": "user", "a": "assistant"}[expected]

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _THEN[role[0]]
            self._say(role, text)
        elif edit == "R":
            self._say(self._next(), text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def replay(heads: DataFrame, damaged: DataFrame) -> DataFrame:
    """(conv, the figures, audit, repaired_sha256). ``heads``: one row for each conversation; ``damaged``: its rows. Both
    are sorted together, a head before its rows, and stream by."""
    kind = heads.schema["conv"].dataType
    arrow = to_arrow_type(kind)
    rows = damaged.where("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text", *[F.lit(None).cast("long").alias(c) for c in _FIGURES], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    first = heads.select("conv", F.lit(0).alias("kind"), F.lit(None).cast(damaged.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), *_FIGURES, F.lit(0).alias("copy"))
    both = first.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
    names = ["conv", *_FIGURES, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now = None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:-2]), *(pa.array(c, pa.string()) for c in columns[-2:])], names=names)

        for batch in batches:
            for conv, kind_, role, text, *figures in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind_ == 0:
                    if now is not None:
                        done.append((*head, now.audit, now.digest()))
                    head, now = (conv, *figures), Replay(text)
                else:
                    now.row(role, text)
            if len(done) >= 1000:
                yield out()
        if now is not None:
            done.append((*head, now.audit, now.digest()))
        if done:
            yield out()

    schema = heads.select("conv", *_FIGURES, "audit").schema.add("repaired_sha256", "string")
    return both.select("conv", "kind", "role", "text", *_FIGURES).mapInArrow(run, schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in ``rows``,
    which are damaged first.

    Null ids are a conversation of their own; null roles and texts are one space; null turns come first and do not count
    as gaps; rows of one turn come in the order of role and md5 of the text; rows that repeat are each a row, and duplicates
    after the first; a text of any length counts whole; a conversation that has lost all rows has zeros, no audit and the
    hash of nothing; an empty table gives an empty result; other columns, whatever their names, are ignored."""
    damaged = damage(rows, conv_id, turn, role, text)
    found = materialize(signatures(damaged))
    answers = materialize(solved(found))
    # common signatures are on many conversations: broadcast where the answers are few and short, else a join that can split
    bound = answers.agg(F.coalesce(F.sum(F.length("signature") + F.length("audit") + 100), F.lit(0))).first()[0]
    heads = found.join(F.broadcast(answers) if bound < 64_000_000 else answers, "signature")
    out = replay(heads, damaged)
    return out.withColumnRenamed("conv", conv_id)
