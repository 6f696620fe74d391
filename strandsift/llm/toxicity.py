"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

A small fixed word list seeds the lexicon; the rest is learned from the labelled rows, as words and word beginnings
that toxic texts hold far more often than others. Every text then becomes one dense row: lexicon densities and counts,
second-person proximity, capitals, punctuation and obfuscation rates. Training sees a bounded sample of labelled rows
(``sample_rows``); scoring streams whole texts through Arrow batches with the model, whose size is bounded by
``lexicon_size`` and the number of trees, in the task's closure."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import first_by_hash, materialize, strings
from strandsift.llm.gbt import Boosted, Isotonic

#: Insults that a general lexicon would start from.
SEED_LEXICON = frozenset("idiot idiots idiotic moron moronic stupid dumb imbecile fool loser losers scum trash garbage worthless pathetic disgusting clown filth vermin coward liar ugly hate kill die".split())
#: Second-person pronouns of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
#: Signs that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "*": ""})

_WORD = re.compile(r"\w+")
_OBFUSCATED = re.compile(r"[^\W\d_]++(?:[@*$!0-9]++[^\W\d_]++)+")
_SIGN = re.compile(r"[@*$!0-9]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_STRETCHED = re.compile(r"([^\W\d_])\1\1+")
_BEGINNINGS = (4, 5, 6, 7, 8)
_NEAR = 4
_FOLDS = 4

FEATURES = ("log_words", "log_chars", "seed_count", "seed_density", "strong_count", "strong_density", "weak_count", "weak_density", "weight_sum", "weight_density", "weight_most", "beginning_most", "distinct_hits",
            "near_second_person", "second_person_density", "capital_words", "capital_letters", "exclamation", "question", "punctuation", "symbols", "obfuscated", "obfuscated_hits", "repeated_letters", "digits", "non_ascii", "word_length")


def grams(word: str) -> list[str]:
    """What may enter the learned lexicon: the word itself ('=word') and longer words' beginnings ('word*')."""
    return [f"={word}", *(f"{word[:k]}*" for k in _BEGINNINGS if len(word) > k)]


def squeezed(word: str) -> list[str]:
    """What a word with stretched letters may stand for: each run of three or more as one or two letters (from the
    ninth run on as one; no learned beginning is longer)."""
    runs = len(_STRETCHED.findall(word))
    out = []
    for lengths in itertools.product((1, 2), repeat=min(runs, 8)) if runs else ():
        left = iter(lengths)
        out.append(_STRETCHED.sub(lambda m: m[1] * next(left, 1), word))  # noqa: B023
    return out


class Features:
    """Turns texts into rows of ``FEATURES``. ``lexicon``: learned gram -> log odds."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[bool, float, str]] = {}

    def _look(self, word: str) -> tuple[bool, float, str]:
        """Whether the seed list has it; its weight; the gram that gave it."""
        found = self.known.get(word)
        if found is None:
            forms = [word, *squeezed(word)]
            best = max(((self.lexicon[g], g) for f in forms for g in grams(f) if g in self.lexicon), default=(0.0, ""))
            found = (any(f in SEED_LEXICON for f in forms), *best)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def row(self, text: str) -> list[float]:
        words = _WORD.findall(text)
        n, chars = max(len(words), 1), max(len(text), 1)
        lower = [w.lower() for w in words]
        seed = strong = weak = near = 0
        weight = most = 0.0
        by_gram: Counter[str] = Counter()
        you = 0
        look, known = self._look, self.known
        for i, w in enumerate(lower):
            is_seed, value, gram = known.get(w) or look(w)
            if w in SECOND_PERSON:
                you += 1
            if not (is_seed or gram):
                continue
            seed += is_seed
            strong += value >= 2.0
            weak += value > 0
            weight += value
            most = max(most, value)
            by_gram[gram or w] += 1
            near += any(x in SECOND_PERSON for x in lower[max(0, i - _NEAR) : i + _NEAR + 1])
        letters = sum(map(len, words))
        capitals = sum(w.isupper() and len(w) > 1 for w in words)
        shown = _OBFUSCATED.findall(text) if _SIGN.search(text) else []
        hidden = sum(bool(look(x.lower().translate(LOOKALIKES))[0] or look(x.lower().translate(LOOKALIKES))[2]) for x in shown)
        marks = {c: text.count(c) for c in "!?.,;:#*$%&|<>\"'()-"}
        beginnings = max((c for g, c in by_gram.items() if g.endswith("*")), default=0)
        ascii_bytes = len(text.encode("utf-8", "replace"))
        return [
            math.log1p(len(words)), math.log1p(len(text)), seed, 100 * seed / n, strong, 100 * strong / n, weak, 100 * weak / n, weight, 100 * weight / n, most, beginnings, len(by_gram),
            near, 100 * you / n, capitals / n, sum(map(str.isupper, text)) / chars, 100 * marks["!"] / n, 100 * marks["?"] / n, sum(marks[c] for c in "!?.,;:\"'()-") / n, sum(marks[c] for c in "#*$%&|<>") / n,
            100 * len(shown) / n, hidden, 100 * len(_REPEATED.findall(text)) / n, sum(w.isdigit() for w in words) / n, (ascii_bytes - len(text)) / chars, letters / n,
        ]

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, calibration: Isotonic | None, rate: float):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, texts: list[str], features: Features) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate)
        return np.clip(self.calibration(self.trees.margin(features(texts))), 0.0, 1.0)


def _gram_counts(texts: DataFrame, kept: frozenset[str] | None) -> DataFrame:
    """(gram, fold, toxic, rows): in how many toxic and in how many texts of each fold each gram occurs; of all grams or
    of ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int]] = Counter()
            toxic: Counter[tuple[str, int]] = Counter()
            for text, label, fold in zip(strings(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {g for w in set(_WORD.findall(text.lower())) for g in grams(w)}
                own = [(g, fold) for g in (own if kept is None else own & kept)]
                counts.update(own)
                if label:
                    toxic.update(own)
            columns = {"gram": [g for g, _ in counts], "fold": [f for _, f in counts], "toxic": [toxic[g] for g in counts], "rows": list(counts.values())}
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("gram", pa.string()), ("fold", pa.int32()), ("toxic", pa.int64()), ("rows", pa.int64())]))

    return texts.select("text", "label", "fold").mapInArrow(run, "gram string, fold int, toxic long, rows long").groupBy("gram", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))


def _least(toxic: int) -> int:
    """Toxic texts that must hold a gram of the lexicon."""
    return max(3, round(0.004 * toxic))


def _lexicon(names: list[str], toxic: np.ndarray, rows: np.ndarray, all_toxic: int, all_rows: int, size: int) -> dict[str, float]:
    """The ``size`` grams that tell most, and their log odds less what a count of that size may give by itself."""
    odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((rows - toxic + 0.5) / (all_rows - all_toxic + 1)) - 1 / np.sqrt(np.maximum(toxic, 1))
    kept = [i for i in np.flatnonzero((odds > 0.7) & (toxic >= _least(all_toxic))).tolist()]
    kept.sort(key=lambda i: (-odds[i] * np.log1p(toxic[i]), names[i]))
    return {names[i]: float(odds[i]) for i in kept[:size]}


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = 12_000, lexicon_size: int = 600) -> ToxicityModel:
    """Learns from ``docs`` that ``labels`` (id column, label 0/1) marks. At most ``sample_rows`` labels are used, the
    first in the order of the id's hash, so that the labels, and not the texts, travel to the join, and one row of each
    id, that with the smallest hash of its text; the lexicon keeps at most ``lexicon_size`` grams. The calibration is fit
    on margins of rows that neither the trees nor the lexicon behind them have seen. Other labels, null ids and null
    labels teach nothing; a null text is an empty one. Without both labels the score is the share of toxic rows (0.0 of
    none)."""
    spark = docs.sparkSession
    labels = labels.where(F.col("label").isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("key"), F.col("label").cast("int").alias("label"))
    chosen = labels.join(F.broadcast(first_by_hash(labels, "key", sample_rows)), "key").groupBy("key").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_column).alias("key"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # at most sample_rows rows: of an id on several rows one text, chosen before rows of one id come together
    one = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    fold = F.pmod(F.xxhash64(F.concat(F.lit("fold"), F.col("key").cast("string"))), F.lit(_FOLDS)).cast("int")
    sample = one.select("key", F.col("least.text").alias("text"), "label", fold.alias("fold"))
    sample = materialize(sample.repartition(max(4, spark.sparkContext.defaultParallelism), "key"))
    sizes = {r.fold: (r.rows, r.toxic) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("toxic")).collect()}
    total, toxic = sum(n for n, _ in sizes.values()), sum(t for _, t in sizes.values())
    if toxic < 3 or total - toxic < 3:
        return ToxicityModel({}, None, None, toxic / total if total else 0.0)
    first = _gram_counts(sample.where("label = 1"), None).groupBy("gram").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= 3).orderBy(F.desc("rows"), "gram").limit(20 * lexicon_size)
    names = sorted(r.gram for r in first.select("gram").collect())
    place = {g: i for i, g in enumerate(names)}
    seen, hits = np.zeros((_FOLDS, len(names))), np.zeros((_FOLDS, len(names)))
    for r in _gram_counts(sample, frozenset(names)).collect():  # at most 20 * lexicon_size grams in each fold
        seen[r.fold, place[r.gram]], hits[r.fold, place[r.gram]] = r.rows, r.toxic
    # one lexicon of the rows outside each fold, and one of all
    lexicons = []
    for k in (*range(_FOLDS), None):
        others = [f for f in range(_FOLDS) if f != k]
        lexicons.append(_lexicon(names, hits[others].sum(0), seen[others].sum(0), sum(sizes.get(f, (0, 0))[1] for f in others), sum(sizes.get(f, (0, 0))[0] for f in others), lexicon_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [Features(x) for x in lexicons]
        for batch in batches:
            own = strings(batch.column(0))
            x = np.concatenate([make(own) for make in makers], 1)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "fold"])

    rows = sample.select("text", "label", "fold").mapInArrow(run, "x array<double>, label int, fold int").toPandas()
    x, y, fold = np.array(rows["x"].tolist(), np.float64), rows["label"].to_numpy(np.float64), rows["fold"].to_numpy()
    order = np.lexsort(np.column_stack([fold, y, x]).T)  # tasks return rows in any order
    x, y, fold = x[order].reshape(len(y), _FOLDS + 1, -1), y[order], fold[order]
    margins = np.zeros(len(y))
    for k in range(_FOLDS):
        train = fold != k
        if 0 < y[train].sum() < train.sum():
            margins[~train] = Boosted().fit(x[train, k], y[train]).margin(x[~train, k])
    return ToxicityModel(lexicons[-1], Boosted().fit(x[:, -1], y), Isotonic().fit(margins, y), toxic / total)


def score(docs: DataFrame, model: ToxicityModel, text_column: str = "text", output: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``output``, the calibrated probability of toxicity of each whole text; null and
    empty texts get the score of a text without words; rows that repeat are scored each; an empty table gives an empty
    result. A column that already has that name is replaced."""
    columns = [c for c in docs.columns if c != output]
    schema = docs.select(columns).schema.add(output, "double")
    at = columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon)
        for batch in batches:
            values = np.concatenate([np.zeros(0), *(model.score(strings(batch.column(at).slice(k, 512)), features) for k in range(0, batch.num_rows, 512))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*columns, output])

    return docs.select(columns).mapInArrow(run, schema)
