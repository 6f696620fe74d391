"""Sequence encoders: an interface, and a hashing encoder that needs no weights."""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

POOLINGS = ("mean", "cls")
#: Tokens of a batch of sequences without a limit of length.
_BATCH_TOKENS = 65_536
#: Letters of a token up to which the vectors of all tokens are one table.
_DENSE_WIDTH = 3


class Encoder(Protocol):
    """Loaded once per worker; gives token vectors for a batch of sequences."""

    dim: int

    def info(self) -> dict: ...

    def hidden(self, sequences: list[str], max_length: int | None, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(batch, tokens, dim) and the mask (batch, tokens), special tokens included."""
        ...


class KmerEncoder:
    """A deterministic stand-in for a learned model: a token's vector hashes the k-mers around it. Sequences get a
    first and a last token of their own, as learned encoders have."""

    def __init__(self, dim: int = 64, k: int = 3, layers: int = 2):
        self.dim, self.k, self.layers = dim, k, layers
        self.known: dict[str, np.ndarray] = {}  # token vectors of this process
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # those of letters, by place, and which are known

    def info(self) -> dict:
        return {"name": f"kmer-{self.k}", "hidden_size": self.dim, "num_layers": self.layers, "num_attention_heads": 0, "vocab_size": 26**self.k, "max_position_embeddings": None}

    def __getstate__(self):
        return {"dim": self.dim, "k": self.k, "layers": self.layers, "known": {}, "tables": {}}

    def _vector(self, token: str) -> np.ndarray:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[token] = self._hashed(token)
        return found

    def _hashed(self, token: str) -> np.ndarray:
        raw = b"".join(xxhash.xxh64_digest(token.encode(), seed) for seed in range(-(-self.dim // 8)))
        return (np.frombuffer(raw, np.uint8)[: self.dim].astype(np.float32) - 127.5) / 127.5

    def hidden(self, sequences: list[str], max_length: int | None = 1022, layer: int = -1) -> tuple[np.ndarray, np.ndarray]:
        if not -self.layers <= layer < self.layers:
            raise ValueError(f"layer {layer} of {self.layers}")
        width = 1 + layer % self.layers * (self.k - 1)  # deeper layers see more context
        if width <= _DENSE_WIDTH and all(map(str.isascii, sequences)) and (letters := "".join(sequences)).isupper() == bool(letters) and letters.isalpha() == bool(letters):
            return self._hidden_letters(sequences, max_length, width)
        tokens = [["<s>", *(s[i : i + width] for i in range(len(s) if max_length is None else min(len(s), max_length))), "</s>"] for s in sequences]
        place: dict[str, int] = {}
        at = [[place.setdefault(t, len(place)) for t in row] for row in tokens]
        table = np.stack([self._vector(t) for t in place]) if place else np.zeros((1, self.dim), np.float32)
        longest = max(map(len, at), default=0)
        index = np.array([row + [0] * (longest - len(row)) for row in at], np.int64).reshape(len(at), longest)
        mask = (np.arange(longest) < np.array([len(row) for row in at])[:, None]).astype(np.float32)
        return table[index] * mask[:, :, None], mask

    def _hidden_letters(self, sequences: list[str], max_length: int | None, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of sequences of A to Z, whose tokens are numbers in base 27: places of a table."""
        cut = [np.frombuffer((s if max_length is None else s[:max_length + width - 1]).encode(), np.uint8).astype(np.int64) - 64 for s in sequences]
        sizes = [len(s) if max_length is None else min(len(s), max_length) for s in sequences]
        first, last = 27**width, 27**width + 1  # the places of the two tokens of their own
        index = np.zeros((len(cut), max(sizes, default=-2) + 2), np.int64)
        for row, (x, n) in enumerate(zip(cut, sizes, strict=True)):
            x = np.append(x, np.zeros(width, np.int64))  # tokens at the end are shorter
            index[row, 0], index[row, n + 1] = first, last
            for i in range(width):
                index[row, 1 : n + 1] = index[row, 1 : n + 1] * 27 + x[i : i + n]
        mask = (np.arange(index.shape[1]) < np.array(sizes, np.int64)[:, None] + 2).astype(np.float32)
        if width not in self.tables:
            self.tables[width] = np.zeros((last + 1, self.dim), np.float32), np.zeros(last + 1, bool)
        table, filled = self.tables[width]
        met = np.zeros(last + 1, bool)
        met[index] = True
        for place in np.flatnonzero(met & ~filled).tolist():
            table[place], filled[place] = self._hashed("<s>" if place == first else "</s>" if place == last else _letters(place)), True
        out = table.take(index, axis=0)
        for row, n in enumerate(sizes):
            out[row, n + 2 :] = 0
        return out, mask


def _letters(place: int) -> str:
    out = ""
    while place:
        place, c = divmod(place, 27)
        out = (chr(64 + c) if c else "") + out
    return out


class FolderEncoder:
    """A learned encoder from a folder in the transformers layout, or a model name that library can resolve.

    The model is loaded at the first batch of each worker process, so only the folder's name travels; the folder must be
    readable by every executor. transformers and torch are needed there and nowhere else."""

    _loaded: ClassVar[dict[tuple, tuple]] = {}

    def __init__(self, folder: str, half_precision: bool = True, device: str = "cpu"):
        self.folder, self.half_precision, self.device = folder, half_precision, device

    def _model(self) -> tuple:
        key = (self.folder, self.half_precision, self.device)
        if key not in self._loaded:
            import torch
            from transformers import AutoModel, AutoTokenizer

            model = AutoModel.from_pretrained(self.folder).eval().to(torch.device(self.device))
            self._loaded[key] = (torch, AutoTokenizer.from_pretrained(self.folder), model.half() if self.half_precision else model)
        return self._loaded[key]

    @property
    def dim(self) -> int:
        return self._model()[2].config.hidden_size

    def info(self) -> dict:
        config = self._model()[2].config
        return {"name": self.folder, "hidden_size": config.hidden_size, "num_layers": config.num_hidden_layers, "num_attention_heads": config.num_attention_heads, "vocab_size": config.vocab_size, "max_position_embeddings": config.max_position_embeddings}

    def hidden(self, sequences: list[str], max_length: int | None = 1022, layer: int = -1) -> tuple[np.ndarray, np.ndarray]:
        torch, tokenizer, model = self._model()
        cut = {"truncation": True, "max_length": max_length} if max_length is not None else {}
        given = {k: v.to(torch.device(self.device)) for k, v in tokenizer(sequences, return_tensors="pt", padding=True, **cut).items()}
        with torch.no_grad():
            states = model(**given, output_hidden_states=True).hidden_states[layer]
        return states.float().cpu().numpy(), given["attention_mask"].float().cpu().numpy()


def pool(hidden: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    if how == "cls":
        return hidden[:, 0]
    return (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)


def encode(df: DataFrame, encoder: Encoder, sequence: str = "seq", output: str = "embedding", batch_size: int = 32, max_length: int | None = 1022, pooling: str = "mean", layer: int = -1, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with an array<float> column ``output``. Longer sequences are cut to ``max_length`` (None: never);
    null ones give null. Without a limit, batches are of like length, and those of long sequences have fewer of them. ``keep``:
    the columns to be returned beside ``output`` (default: all), as texts that nobody reads need not come back from Python."""
    if pooling not in POOLINGS:
        raise ValueError(f"unknown pooling {pooling!r}; known: {', '.join(POOLINGS)}")
    columns = [c for c in df.columns if c != output]
    kept = [c for c in columns if keep is None or c in keep]
    schema = df.select(kept).schema.add(output, T.ArrayType(T.FloatType()))
    at = columns.index(sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at).to_pylist()
            vectors: list = [None] * len(given)
            order = sorted(range(len(given)), key=lambda i: len(given[i] or "")) if max_length is None else list(range(len(given)))
            values = [given[i] for i in order]
            k = 0
            while k < len(values):
                part, longest = values[k : k + batch_size], 0
                for i, s in enumerate(part):
                    longest = max(longest, len(s or "") if max_length is None else 0)
                    if i and (i + 1) * longest > _BATCH_TOKENS:
                        part = part[:i]
                        break
                hidden, mask = encoder.hidden([s or "" for s in part], max_length, layer)
                for i, s, v in zip(order[k:], part, pool(hidden, mask, pooling), strict=False):
                    vectors[i] = None if s is None else v.tolist()
                k += len(part)
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in kept), pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, output])

    # the work per byte is far above a shuffle's; a small table would otherwise be encoded in one task. Rows are dealt in
    # turn, whatever they hold, to a stated number of tasks, which Spark does not merge
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.select(columns).repartition(tasks).mapInArrow(run, schema)


def encode_single(spark, seq: str, encoder: Encoder, max_length: int = 1022) -> list[float]:
    """The mean-pooled last layer of one sequence."""
    return encode(spark.createDataFrame([(seq,)], "seq string"), encoder, max_length=max_length).select("embedding").first()[0]


_REGISTRY = {"kmer": KmerEncoder, "folder": FolderEncoder}


def register_encoder(name: str, make) -> None:
    _REGISTRY[name] = make


def load_encoder(name: str = "kmer", **options) -> Encoder:
    return _REGISTRY[name](**options)


def model_info(name: str = "kmer", **options) -> dict:
    return load_encoder(name, **options).info()


def encode_fasta(spark, source: str, target: str, encoder: Encoder, **options) -> None:
    """FASTA to a Parquet table (seq_no, id, embedding)."""
    from strandsift.sources.fasta import read_fasta

    encode(read_fasta(spark, source), encoder, **options).select("seq_no", "id", "embedding").write.mode("overwrite").parquet(target)
