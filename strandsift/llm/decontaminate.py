"""Benchmark decontamination by a prefix-filtered join with exact verification.

A window of a benchmark item is ``window`` consecutive words (an item of fewer words is one window). A window is found
in a document only if all of its 3-word shingles are, so for containment 1.0 the prefix that a join needs is a single
shingle, and the rarest is the cheapest:

1. Count, over all documents, every shingle that the windows hold (map-side combined; the table is no larger than the
   windows' shingles).
2. Each window is indexed under its rarest shingle, with that shingle's place in the window (the positional bound: a
   hit at word p of a document can only be the window that starts at p - place).
3. A document's shingles probe the index; candidates that would overhang the document are dropped (the length bound);
   the rest are compared word by word.

Windows go to the tasks in blocks of at most about ``block_windows``. With one block, as usual, hits are found in the scan
that goes on with the rows. With more, each block has a pass of its own that writes the rows with hits and gives its
memory back before the next, so that driver and tasks hold one block whatever the size of the benchmark; what was found
is then summed by row and joined to the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from strandsift.llm.common import encoded, free_name, keyed_rows, materialize, small

#: ASCII letters are lower-cased; ASCII other than letters and digits separates words; bytes above 127 belong to them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SHINGLE = 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def item_windows(text: bytes, window: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


class Index:
    """One block of windows. ``frequency``: shingle -> rows in the corpus; without it any prefix serves."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[str]]], window: int, frequency: dict[tuple[bytes, ...], int] | None = None):
        self.items = [ids for _, ids in windows]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for ws, _ in windows for x in ws}))}
        codes = np.zeros((len(windows), window), np.int64)
        self.lengths = np.array([len(ws) for ws, _ in windows], np.int64)
        for k, (ws, _) in enumerate(windows):
            codes[k, : len(ws)] = [self.vocabulary[x] for x in ws]
        self.codes = codes
        frequency = frequency or {}
        prefix, place = [], []
        for ws, _ in windows:
            spans = [ws[p : p + _SHINGLE] for p in range(max(1, len(ws) - _SHINGLE + 1))]
            p = min(range(len(spans)), key=lambda i: (frequency.get(spans[i], 0), spans[i], i))
            prefix.append(spans[p])
            place.append(p)
        keys = np.array([self.key([self.vocabulary[x] for x in s]) for s in prefix], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.place = keys[order], order, np.array(place, np.int64)[order]
        self.widths = sorted({len(s) for s in prefix})

    @staticmethod
    def key(codes) -> np.uint64:
        with np.errstate(over="ignore"):
            return np.uint64((np.array(codes, np.uint64) * _MIX[: len(codes)]).sum(dtype=np.uint64))

    def find(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, window, first word), in no order. Documents are joined into one array, one gap between two."""
        look = self.vocabulary.get
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = np.zeros(int(sizes.sum()) + len(documents) + self.codes.shape[1], np.int64)
        for s, d in zip(starts.tolist(), documents, strict=True):
            codes[s : s + len(d)] = [look(x, 0) for x in d]
        own = codes.astype(np.uint64)
        found = []
        for width in self.widths:
            n = len(codes) - width + 1
            whole = np.ones(n, bool)
            for k in range(width):
                whole &= codes[k : n + k] > 0
            at = np.flatnonzero(whole)
            key = np.zeros(len(at), np.uint64)
            for k in range(width):
                key += own[at + k] * _MIX[k]
            low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
            count = high - low
            to = np.cumsum(count)
            entry = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(low - (to - count), count)
            found.append((np.repeat(at, count), entry))
        at, entry = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        window, start = self.which[entry], at - self.place[entry]
        fits = start >= 0
        window, start = window[fits], start[fits]
        same = np.ones(len(start), bool)
        for k in range(self.codes.shape[1]):
            inside = self.lengths[window] > k
            same &= ~inside | (codes[np.minimum(start + k, len(codes) - 1)] == self.codes[window, k])
        window, start = window[same], start[same]
        document = np.searchsorted(starts, start, "right") - 1
        return document, window, start - starts[document]


def _shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]]) -> DataFrame:
    """(shingle, rows): in how many documents each wanted shingle occurs."""
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for s in wanted for x in s}))}
    names = sorted(wanted)
    keys = np.array([Index.key([vocabulary[x] for x in s]) for s in names], np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for text in encoded(batch.column(0)):
                codes = np.array([vocabulary.get(x, 0) for x in words(text)], np.uint64)
                for width in (1, 2, 3):
                    n = len(codes) - width + 1
                    if n < 1:
                        break
                    key = sum((codes[k : n + k] * _MIX[k] for k in range(width)), np.zeros(n, np.uint64))
                    key = np.unique(key[np.logical_and.reduce([codes[k : n + k] > 0 for k in range(width)])])
                    if len(key):
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        total[at[keys[at] == key]] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(names[order[k]]) for k in seen], pa.binary()), pa.array(total[seen])], names=["shingle", "rows"])

    return docs.select("text").mapInArrow(run, "shingle binary, rows long").groupBy("shingle").agg(F.sum("rows").alias("rows"))


_SPAN = StructType().add("first", "long").add("end", "long")
_FOUND = StructType().add("items", ArrayType(StringType())).add("spans", ArrayType(_SPAN)).add("n_words", "long")
_NOTHING = {"items": [], "spans": [], "n_words": 0}


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(window, items): each distinct window and the item ids, as text, that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, sorted(b" ".join(w) for w in item_windows(t, window))) for i, t in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, ws in rows for _ in ws], pa.string()), pa.array([w for _, ws in rows for w in ws], pa.binary())], names=["item", "window"])

    cuts = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "item string, window binary")
    return materialize(cuts.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")))


def mark(docs: DataFrame, items: DataFrame, window: int = 10, block_windows: int = 200_000, text_column: str = "text", output: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``output``: items, spans and n_words, as contamination() describes, with the same
    results for nulls, empty and long texts, repeats and empty tables. Every row stays, also where rows repeat. A column
    that already has the output's name is replaced; others may have any name. Nothing of ``docs`` is shuffled while the
    benchmark is one block."""
    columns = [c for c in docs.columns if c != output]
    docs = docs.select(columns)
    windows = _windows(items, window)
    blocks = max(1, -(-windows.count() // block_windows))
    text = F.col(text_column).cast("string").alias("text")

    def index_of(block: int):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).orderBy("window").collect()  # about block_windows rows
        known = [(tuple(bytes(r.window).split(b" ")), list(r["items"])) for r in part]
        wanted = {ws[p : p + _SHINGLE] for ws, _ in known for p in range(max(1, len(ws) - _SHINGLE + 1))}
        frequency = {tuple(bytes(r.shingle).split(b" ")): r.rows for r in _shingle_counts(docs.select(text), wanted).collect()} if wanted else {}
        return docs.sparkSession.sparkContext.broadcast(Index(known, window, frequency))

    def adding(index, at: int, names: list[str], before: int | None = None, only_hits: bool = False):
        kind = pa.struct([("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("n_words", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    piece = batch.slice(k, 256)
                    known = [_NOTHING] * piece.num_rows if before is None else _merged(piece.column(before).to_pylist())
                    found = _hits(piece.column(at), known, index.value if index else None)
                    kept = [i for i, x in enumerate(found) if x["spans"] or not only_hits]
                    own = [c for i, c in enumerate(piece.columns) if i != before]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(found, kind)], names=names).take(pa.array(kept, pa.int64()))

        return run

    if blocks == 1:
        schema = StructType([*docs.schema.fields, StructField(output, _FOUND)])
        return docs.mapInArrow(adding(index_of(0), columns.index(text_column), [*columns, output]), schema)
    rows = keyed_rows(docs)
    texts = rows.select("file", "index", F.col("row")[text_column].cast("string").alias("text"))
    passes = []
    for block in range(blocks):
        index = index_of(block)
        hits = texts.mapInArrow(adding(index, 2, ["file", "index", "text", "found"], only_hits=True), f"file string, index long, text string, found {_FOUND.simpleString()}")
        passes.append(materialize(hits.select("file", "index", "found")))
        index.destroy()
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    by_row = small(materialize(every.groupBy("file", "index").agg(F.collect_list("found").alias("before"))))  # at most one for each block
    joined = rows.join(by_row, ["file", "index"], "left").select("row", F.col("row")[text_column].cast("string").alias("text"), "before")
    schema = StructType([*joined.select("row", "text").schema.fields, StructField("found", _FOUND)])
    return joined.mapInArrow(adding(None, 1, ["row", "text", "found"], before=2), schema).select("row.*", F.col("found").alias(output))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_windows: int = 200_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: the id, n_words, n_hit, items (array of the item ids found, as text, sorted), hit_spans
    (array of [first word, end word) of the merged hits).

    Null and empty texts have no words and no hits; items that are null, empty or have no word are never found; an
    item id that occurs in several rows counts once, with the windows of all of them; a null item id is left out; an
    empty benchmark finds nothing; other columns are ignored."""
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = mark(base, items, window, block_windows).select("id", "contamination.*")
    return out.select(F.col("id").alias(id_column), "n_words", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.first)").alias("n_hit"), "items", F.col("spans").alias("hit_spans"))


def _merged(before: list) -> list[dict]:
    """What several blocks have found in each text, as one."""
    every = [[x for x in row or [] if x] for row in before]
    return [{"items": [i for x in row for i in x["items"]], "spans": [s for x in row for s in x["spans"]], "n_words": 0} for row in every]


def _hits(texts: pa.Array, known: list[dict], index: Index | None) -> list[dict]:
    """``known`` (items, spans, n_words) with the hits of ``index`` added, spans merged and items sorted."""
    documents = [words(t) for t in encoded(texts)]
    by: list[list[tuple[int, int]]] = [[(s["first"], s["end"]) for s in x["spans"]] for x in known]
    ids: list[set[str]] = [set(x["items"]) for x in known]
    if index is not None:
        document, window, start = index.find(documents)
        for d, w, s, n in zip(document.tolist(), window.tolist(), start.tolist(), index.lengths[window].tolist(), strict=True):
            by[d].append((s, s + n))
            ids[d].update(index.items[w])
    out = []
    for found, items, d in zip(by, ids, documents, strict=True):
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out.append({"items": sorted(items), "spans": [{"first": a, "end": b} for a, b in merged], "n_words": len(d)})
    return out


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a whole window of a benchmark item. Null and empty texts, and all texts if the
    benchmark is empty, stay; rows that repeat are judged each; columns may have any name."""
    found = free_name(docs, "contamination")
    return mark(docs, items, window, output=found).where(F.size(f"{found}.spans") == 0).drop(found)
