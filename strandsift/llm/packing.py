"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of token ids, its documents one after another. Round-robin visits the queues once per window
and serves each its quantum, ``length`` times its target proportion; what a whole number of tokens leaves over is the
queue's deficit, below one token, and is carried to the next window. With fixed proportions the served total of a queue
before window w has a closed form: with X_s the summed quanta of queues 1 to s as a fixed-point number, queue s has
been served floor(w X_s) - floor(w X_(s-1)) tokens. The windows are full by construction, the deficits carry over any
number of windows and partitions, and each document finds its pieces from nothing but the place where it starts in its
queue. So partitions need no hand-over but one prefix sum per queue.

A queue that cannot serve its next quantum in full retires, and round-robin goes on with the others, their proportions
scaled up to full windows. So the closed form holds in phases, one for each time that queues retire, each of which starts
with no deficits. What retired queues still had, less than a quantum each, and queues of no proportion follow at the end,
queue by queue, again in full windows: no token is dropped, and only the last window is padded.

Queues whose quantum would be under one token are pooled into one, document by document, which bounds the number of
queues by ``length`` + 1 however many sources there are."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandsift.llm.common import encoded, materialize, small, stored

#: Bits after the point of the quanta; with 26 bits before it, over 10^11 windows fit in a long.
_POINT = 16
_POOL = "\0pool"


class Encoder:
    """Ids of a byte-level BPE in the tokenizers JSON format, its special tokens' strings being ordinary text.

    The merges are applied by tiktoken from the same vocabulary, which gives the same ids several times faster; a
    file that is not such a BPE, or a text that tiktoken refuses, is encoded by tokenizers itself."""

    def __init__(self, path: str):
        self.path = path
        self._fast = self._slow = None
        self._tried = False

    def __getstate__(self):
        return {"path": self.path, "_fast": None, "_slow": None, "_tried": False}

    def _slowly(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def _prepare(self):
        import json

        import tiktoken

        self._tried = True
        with open(self.path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return
        # the printable stand-ins of the 256 bytes, by the byte-level rule
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        back = {c: b for b, c in stand.items()}
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        vocabulary = spec["model"]["vocab"]
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        order = {"".join(m if isinstance(m, list) else m.split(" ")): None for m in spec["model"]["merges"]}
        if [vocabulary[t] for t in order] != sorted(vocabulary[t] for t in order):
            return  # ids do not follow the merges' order
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not self._tried:
            self._prepare()
        if self._fast is not None:
            try:
                return self._fast.encode_ordinary(text)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001  its regex engine gives up on some runs, by an error or by a panic
                pass
        return self._slowly(text)


def tokenize(docs: DataFrame, encoder: Encoder, id_column: str, text_column: str, source_column: str | None, end_id: int) -> DataFrame:
    """(id, queue, part, start, tokens, ids): the ids of each document with ``end_id`` after them, and how many ids of
    its queue come before it in its partition. ids: little-endian unsigned 16-bit where they fit, else 32-bit."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                queues = [q or "" for q in batch.column(2).to_pylist()]
                start, count, ids = [], [], []
                for queue, text in zip(queues, encoded(batch.column(1)), strict=True):
                    own = np.array([*encoder(text.decode("utf-8", "replace")), end_id], np.uint32)
                    start.append(before.get(queue, 0))
                    count.append(len(own))
                    before[queue] = start[-1] + len(own)
                    ids.append((own.astype("<u2") if own.max() < 65536 else own.astype("<u4")).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(queues, pa.string()), pa.array([part] * len(ids), pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], names=["id", "queue", "part", "start", "tokens", "ids"])

    source = F.col(source_column).cast("string") if source_column in docs.columns else F.lit("")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), source.alias("queue"))
    return rows.mapInArrow(run, f"id {kind}, queue string, part long, start long, tokens long, ids binary")


class Plan:
    """Where each queue's ids go. ``totals``: ids by queue, in the queues' order; ``weights``: target proportions."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, length: int):
        self.length = length
        self.place = {n: s for s, n in enumerate(totals)}
        left = np.array([int(x) for x in totals.values()], np.int64)
        share = np.array([(weights or totals)[n] for n in totals], float)
        #: of each phase: its first window, its windows, and where each queue's quantum starts and ends in fixed point
        self.first: list[int] = []
        self.windows: list[int] = []
        self.edges: list[np.ndarray] = []
        before = [np.zeros(len(left), np.int64)]
        active = (share > 0) & (left > 0)
        while active.any():
            own = np.where(active, share, 0.0)
            edges = np.r_[0, np.round(np.cumsum(own / own.sum()) * length * 2**_POINT)].astype(np.int64)
            edges[np.flatnonzero(active)[-1] + 1 :] = length << _POINT
            most = self._last(edges, left, active)
            full = int(most[active].min())
            if full:
                self.first.append(sum(self.windows))
                self.windows.append(full)
                self.edges.append(edges)
                served = _served(edges, full)
                before.append(before[-1] + served)
                left = left - served
            active &= most > full
        #: of each queue, its ids before each phase; the last row: before the end part
        self.before = np.array(before)
        self.full = sum(self.windows)
        self.tail = np.r_[0, np.cumsum(left)]

    @staticmethod
    def _last(edges: np.ndarray, left: np.ndarray, active: np.ndarray) -> np.ndarray:
        """The most windows for which each active queue has its quanta; 0 of others."""
        rate = np.diff(edges)
        low = np.zeros(len(left), np.int64)
        high = np.array([(int(n) + 2 << _POINT) // int(r) + 2 if on and r else 0 for n, r, on in zip(left, rate, active, strict=True)], np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = ((mid * edges[1:]) >> _POINT) - ((mid * edges[:-1]) >> _POINT) <= left
            low, high = np.where(fits, mid, low), np.where(fits, high, np.maximum(mid - 1, low))
        return low

    def pieces(self, queue: str, start: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start in the document, length, window, offset) of what lies at ``start`` to ``start + tokens`` of a queue."""
        s = self.place[queue]
        marks = self.before[:, s]
        at = []
        for k in range(max(0, int(np.searchsorted(marks, start, "right")) - 1), len(self.windows)):
            if marks[k] >= start + tokens:
                break
            if marks[k + 1] <= start or marks[k + 1] == marks[k]:
                continue
            edges, base = self.edges[k], int(marks[k])
            rate = int(edges[s + 1] - edges[s])
            begin, end = max(start, base) - base, min(start + tokens, int(marks[k + 1])) - base
            w = np.arange(max(0, (begin << _POINT) // rate - 2), min(self.windows[k], (end << _POINT) // rate + 3) + 1)
            cut = ((w * edges[s + 1]) >> _POINT) - ((w * edges[s]) >> _POINT)
            a, b = np.maximum(cut[:-1], begin), np.minimum(cut[1:], end)
            some = b > a
            w, a, b, first = w[:-1][some], a[some], b[some], cut[:-1][some]
            ahead = (((w + 1) * edges[s]) >> _POINT) - ((w * edges[s]) >> _POINT)
            at.append((a + base - start, b - a, w + self.first[k], ahead + a - first))
        mixed = int(marks[-1])
        if start + tokens > mixed:
            begin = max(start, mixed)
            place, n = int(self.tail[s]) + begin - mixed, start + tokens - begin
            cut = np.unique(np.r_[place, np.arange(-(-place // self.length), (place + n) // self.length + 1) * self.length, place + n])
            cut = cut[(cut >= place) & (cut <= place + n)]
            at.append((cut[:-1] - place + begin - start, np.diff(cut), self.full + cut[:-1] // self.length, cut[:-1] % self.length))
        return tuple(np.concatenate(x) for x in zip(*at, strict=True))


def _served(edges: np.ndarray, windows: int) -> np.ndarray:
    """Ids of each queue in so many windows."""
    return np.diff((windows * edges) >> _POINT)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, weights: dict[str, float] | None = None, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, source): one row per piece.

    ``weights`` gives the target proportion of each source (default: its share of all ids). Sources that it lacks are
    packed after the mixture. Null texts are empty and still have their end id; null sources are one queue of their
    own with the empty source; repeated rows are packed each; an empty table gives no piece; without a source column
    there is one queue; other columns are ignored."""
    spark = docs.sparkSession
    rows = stored(tokenize(docs, Encoder(tokenizer_path), id_column, text_column, source_column, end_id))
    sums = materialize(rows.groupBy("queue", "part").agg(F.sum("tokens").alias("tokens")))
    totals = sums.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    if weights is None:
        large = totals.where(F.col("tokens") * length >= F.lit(everything))  # at most ``length`` of them
    else:
        known = [k for k, v in weights.items() if v * length >= sum(weights.values())]
        large = totals.where(F.col("queue").isin(known))
    totals = {r.queue: r.tokens for r in large.orderBy("queue").collect()}
    rest = everything - sum(totals.values())
    own = F.when(F.col("queue").isin(list(totals)), F.col("queue")).otherwise(F.lit(_POOL))
    if rest:
        totals[_POOL] = rest
    if weights is not None:
        weights = {k: float(weights.get(k, 0.0)) for k in totals}
    plan = Plan(totals, weights, length)
    # where each partition's share of a queue starts; pooled queues follow one another within a partition
    sums = sums.withColumn("pool", own)
    by_part = sums.groupBy("pool", "part").agg(F.sum("tokens").alias("tokens"))
    earlier = by_part.withColumn("before", F.sum("tokens").over(Window.partitionBy("pool").orderBy("part")) - F.col("tokens")).select("pool", "part", "before")
    within = sums.withColumn("within", F.sum("tokens").over(Window.partitionBy("pool", "part").orderBy("queue")) - F.col("tokens"))
    bases = within.join(earlier, ["pool", "part"]).select("queue", "part", "pool", (F.col("before") + F.col("within")).alias("base"))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                yield _cut(whole.slice(k, 256), plan)

    placed = rows.join(small(materialize(bases)), ["queue", "part"]).select("id", "pool", (F.col("base") + F.col("start")).alias("start"), "tokens", "ids", "queue")
    out = placed.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
    return out.select(F.col("id").alias(id_column), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def _cut(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    row, columns, crc = [], [[], [], [], []], []
    assert sys.byteorder == "little"
    for i, (pool, start, tokens, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True)):
        own = np.frombuffer(ids, "<u2" if len(ids) == 2 * tokens else "<u4").astype("<u4")
        found = plan.pieces(pool, start, tokens)
        for column, values in zip(columns, found, strict=True):
            column.append(values)
        view = memoryview(own).cast("B")
        crc.extend(zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(found[0].tolist(), found[1].tolist(), strict=True))
        row.append(np.full(len(found[0]), i))
    where = pa.array(np.concatenate([np.zeros(0, np.int64), *row]))
    start, length, window, offset = (pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in columns)
    return pa.RecordBatch.from_arrays([batch.column(0).take(where), start, length, pa.array(crc, pa.int64()), batch.column(3).take(where), window, offset, batch.column(5).take(where)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])
