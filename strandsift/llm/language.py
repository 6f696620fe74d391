"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the UTF-8 bytes of one word at a time (lower-cased, with a space on either side; longer words in
pieces), forwards and backwards, and labels every position with a distribution over the languages; a document's
distribution is the mean over all its positions. As the state starts anew at each word, equal words have equal labels:
a task computes each word once, keeps its summed labels in a cache of bounded size, and pools documents by counting.

Training back-propagates through time on words of labelled documents, with the document's language at every position.
The words come from at most ``sample_docs`` documents, and at most ``frequent`` + ``rare`` of them reach the driver."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import first_by_hash, materialize, strings


def _ranges(kinds: str) -> str:
    """The characters of these Unicode categories as ranges of a pattern's class."""
    member = np.array([unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(np.r_[False, member, False])).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


#: Letters and the marks that combine with them.
_WORD = re.compile(f"[{_ranges('LM')}]+")
_PIECE = 30
UNKNOWN = "und"
#: Of a worker's cache: cells (words x languages) and words.
_CELLS, _WORDS = 4_000_000, 400_000


def letters(text: str) -> list[str]:
    """The lower-cased words of a text that have a letter."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def pieces(word: str) -> list[bytes]:
    data = word.encode("utf-8", "replace")
    return [b" " + data[k : k + _PIECE] + b" " for k in range(0, len(data), _PIECE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """One gated recurrent layer in each direction and a softmax over ``labels`` at each position."""

    def __init__(self, labels: int, hidden: int = 16, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p[f"x{way}"] = draw.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"h{way}"] = (draw.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"c{way}"] = np.zeros(3 * hidden, np.float32)
        self.p["o"] = draw.normal(0, 0.2, (2 * hidden, labels)).astype(np.float32)
        self.p["b"] = np.zeros(labels, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (time, batch, hidden) of one direction; ``x`` and ``mask`` (time, batch) come in reading order."""
        k = self.hidden
        wx, wh, c = self.p[f"x{way}"], self.p[f"h{way}"], self.p[f"c{way}"]
        h = np.zeros((x.shape[1], k), np.float32)
        states, saved = np.empty((*x.shape, k), np.float32), []
        for t in range(len(x)):
            a = wx[x[t]] + c
            gates = _sigmoid(a[:, : 2 * k] + h @ wh[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(a[:, 2 * k :] + (r * h) @ wh[:, 2 * k :])
            new = h + mask[t][:, None] * z * (n - h)
            if keep:
                saved.append((h, z, r, n))
            h = states[t] = new
        return (states, saved) if keep else states

    def _back(self, way: str, x: np.ndarray, mask: np.ndarray, saved: list, d: np.ndarray, grad: dict) -> None:
        """Back-propagation through time of the loss's gradient ``d`` by this direction's states."""
        k = self.hidden
        wh = self.p[f"h{way}"]
        gx, gh = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(wh)
        gc = np.zeros(3 * k, np.float32)
        carried = np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n = saved[t]
            g = carried + d[t]
            m = mask[t][:, None]
            dn = g * m * z * (1 - n * n)
            dz = g * m * (n - h) * z * (1 - z)
            drh = dn @ wh[:, 2 * k :].T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            carried = g * (1 - m * z) + drh * r + da[:, : 2 * k] @ wh[:, : 2 * k].T
            gh[:, : 2 * k] += h.T @ da[:, : 2 * k]
            gh[:, 2 * k :] += (r * h).T @ dn
            gc += da.sum(0)
            np.add.at(gx, x[t], da)
        grad[f"x{way}"], grad[f"h{way}"], grad[f"c{way}"] = gx, gh, gc

    @staticmethod
    def _batch(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, mask) forwards and (bytes, mask) backwards, (time, batch), padded at the end of reading."""
        longest = max(map(len, words))
        x = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        mask = np.arange(longest) < lengths[:, None]
        back = np.take_along_axis(x, np.maximum(lengths[:, None] - 1 - np.arange(longest), 0), 1)
        return x.T.astype(np.int64), mask.T.astype(np.float32), back.T.astype(np.int64), lengths

    def _states(self, words: list[bytes], keep: bool = False):
        x, mask, xb, lengths = self._batch(words)
        forward, backward = self._run("f", x, mask, keep), self._run("b", xb, mask, keep)
        place = np.maximum(lengths - 1 - np.arange(len(x))[:, None], 0)  # reading order -> text order and back
        return x, mask, xb, place, forward, backward

    def labels_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, probabilities), each summed over the positions of each word: (words, labels)."""
        logs = np.zeros((len(words), self.labels), np.float32)
        sums = np.zeros((len(words), self.labels), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for k in range(0, len(order), 2048):
            at = order[k : k + 2048]
            _, mask, _, place, forward, backward = self._states([words[i] for i in at])
            both = np.concatenate([forward, np.take_along_axis(backward, place[:, :, None], 0)], 2)
            score = both @ self.p["o"] + self.p["b"]
            score -= score.max(2, keepdims=True)
            score -= np.log(np.exp(score).sum(2, keepdims=True))
            logs[at] = (score * mask[:, :, None]).sum(0)
            sums[at] = (np.exp(score) * mask[:, :, None]).sum(0)
        return logs, sums

    def fit(self, words: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 5) -> BiGRU:
        """Adam on the weighted cross-entropy at every position."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(words) // batch)
        k = self.hidden
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        weights = (weights / weights.mean()).astype(np.float32)
        for _ in range(epochs):
            order = np.argsort(lengths + draw.random(len(words)) * 3, kind="stable")
            chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
            for c in draw.permutation(len(chunks)):
                at = chunks[c]
                x, mask, xb, place, (forward, sf), (backward, sb) = self._states([words[i] for i in at], keep=True)
                both = np.concatenate([forward, np.take_along_axis(backward, place[:, :, None], 0)], 2)
                score = both @ self.p["o"] + self.p["b"]
                score = np.exp(score - score.max(2, keepdims=True))
                score /= score.sum(2, keepdims=True)
                score[:, np.arange(len(at)), labels[at]] -= 1
                share = mask * weights[at]
                d = score * (share / max(share.sum(), 1e-6))[:, :, None]
                grad = {"o": both.reshape(-1, 2 * k).T @ d.reshape(-1, self.labels), "b": d.sum((0, 1))}
                dh = d @ self.p["o"].T
                back = np.zeros_like(backward)
                index = np.where(mask > 0, place, np.arange(len(x))[:, None])  # a bijection also where padded
                np.put_along_axis(back, np.broadcast_to(index[:, :, None], back.shape), dh[:, :, k:] * mask[:, :, None], 0)
                self._back("f", x, mask, sf, dh[:, :, :k], grad)
                self._back("b", xb, mask, sb, back, grad)
                step += 1
                speed = rate * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * step / steps)))
                for name, g in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] -= (speed * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


class LanguageModel:
    def __init__(self, languages: list[str], network: BiGRU | None):
        self.languages, self.network = languages, network
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return {"languages": self.languages, "network": self.network, "cache": {}}

    def _rows(self, words: list[str], limit: int) -> None:
        """The summed labels of ``words``, of which there are at most ``limit``, come into the cache, which is emptied
        before it would hold more."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > limit or not self.cache:
            self.cache, new = {}, words
            self.table = np.zeros((0, len(self.languages)), np.float32)
        if not new:
            return
        cut = [pieces(w) for w in new]
        _, sums = self.network.labels_of([p for c in cut for p in c])
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        n = len(self.table)
        self.table = np.concatenate([self.table, np.add.reduceat(sums, starts, axis=0)])
        self.cache.update(zip(new, range(n, n + len(new)), strict=True))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The most probable language of each text and its share of the pooled probability; ``und`` and 0.0 for a text
        without letters or a model without languages. The texts' words are looked up in parts that the cache can hold."""
        counts = [Counter(letters(t)) for t in texts]
        words = list(dict.fromkeys(w for c in counts for w in c))
        if self.network is None or not words:
            only = self.languages[0] if len(self.languages) == 1 else UNKNOWN
            return [only if c else UNKNOWN for c in counts], [1.0 if c and only != UNKNOWN else 0.0 for c in counts]
        limit = min(_WORDS, max(1, _CELLS // len(self.languages)))
        totals = np.zeros((len(texts), len(self.languages)))
        for begin in range(0, len(words), limit):
            part = words[begin : begin + limit]
            self._rows(part, limit)
            look, own = self.cache, set(part) if len(part) < len(words) else None
            for i, c in enumerate(counts):
                c = c if own is None else {w: n for w, n in c.items() if w in own}
                if c:
                    at = np.fromiter((look[w] for w in c), np.int64, len(c))
                    totals[i] += np.fromiter(c.values(), np.float64, len(c)) @ self.table[at].astype(np.float64)
        names, scores = [], []
        for c, total in zip(counts, totals, strict=True):
            best = int(total.argmax())
            names.append(self.languages[best] if c else UNKNOWN)
            scores.append(float(min(1.0, total[best] / total.sum())) if c else 0.0)
        return names, scores


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", key_column: str = "doc_id", sample_docs: int = 6000, frequent: int = 12_000, rare: int = 48_000, languages: int = 300, hidden: int = 16, epochs: int = 6) -> LanguageModel:
    """Learns from rows with a key, a text and a language. Of these, one row of each of the first ``sample_docs`` keys in
    the order of the key's hash is used, that with the least hash of its text, and of their (word, language) pairs the ``frequent`` most frequent and ``rare`` others in the order of a
    hash; the ``languages`` most frequent languages can be predicted."""
    usable = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    chosen = first_by_hash(usable.select(F.col(key_column).alias("key")), "key", sample_docs)
    sample = usable.select(F.col(key_column).alias("key"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).join(F.broadcast(chosen), "key", "left_semi")
    # a key on many rows is one row before its rows come together, so that rows are bounded as keys are
    sample = sample.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "lang", "text")).alias("least")).select("least.text", "least.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, lang in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(letters(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    words = materialize(sample.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    known = sorted(r.lang for r in words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect())
    if len(known) < 2:
        return LanguageModel(known, None)
    top = words.orderBy(F.desc("n"), "word", "lang").limit(frequent)
    others = words.join(top.select("lang", "word"), ["lang", "word"], "left_anti").orderBy(F.xxhash64("word"), "word", "lang").limit(rare)
    place = {lang: i for i, lang in enumerate(known)}
    rows = sorted((r.word, r.lang, r.n) for r in [*top.collect(), *others.collect()] if r.lang in place)
    cut = [(p, place[lang], n) for w, lang, n in rows for p in pieces(w)]
    weights = np.minimum(np.array([n for _, _, n in cut], float), 200) ** 0.6
    network = BiGRU(len(known), hidden).fit([p for p, _, _ in cut], np.array([i for _, i, _ in cut]), weights, epochs)
    return LanguageModel(known, network)


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text", name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its pooled probability, 0 to 1.

    ``und`` and 0.0 where the text is null, empty or has no letter; rows that repeat are predicted each; columns that
    already have the outputs' names are replaced; an empty table gives an empty result."""
    columns = [c for c in docs.columns if c not in (name, score)]
    schema = docs.select(columns).schema.add(name, "string").add(score, "double")
    at = columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                names, scores = model.predict(strings(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, name, score])

    return docs.select(columns).mapInArrow(run, schema)
