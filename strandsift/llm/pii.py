"""Personal data by aggregating weak labelers.

Base spans (e-mail, IP, card, phone) come from fixed patterns with their checks and always stay. Besides them, wider
patterns propose candidates: assigned secrets, spelled-out e-mails, phones without a plus, national ids, IBANs. On each
candidate, base or not, labelers vote yes, no or nothing: regular expressions for the strict form, gazetteers (domain
endings, calling codes, issuer prefixes, names of secrets) and context labelers (words before the span, what it is glued
to). Votes are counted over all texts by pattern of votes, a table of bounded size; expectation-maximisation over these
counts estimates each labeler's reliability and each pattern's probability; a logistic classifier over votes and span
shape is then trained on those soft labels and decides which candidates become spans."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import materialize, strings

BASE = ("email", "ip", "card", "phone")
#: Further kinds, in the order in which equal starts are listed.
KINDS = (*BASE, "secret", "national_id", "iban")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails at its start fails everywhere in it, so runs are taken possessively
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# runs are possessive and have no upper bound; a name of more than three parts is found by its last three
_SECRET = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z_]{2,}+(?:-[A-Za-z_]++){0,2})\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_\-]{12,}+={0,2})(?![A-Za-z0-9+/])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{2,}+)\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?([A-Za-z0-9-]{2,}+)\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?([A-Za-z]{2,}+)(?![0-9])", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.\-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Gazetteers.
DOMAIN_ENDINGS = frozenset("com org net edu gov mil int info io co ai app dev biz de fr es it nl be ch at uk us ca au eu pt pl se no dk fi ie mx ar br jp cn in ru".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 359 420 421".split())
ISSUERS = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 30 6011 65 35 62 50 56 57 58".split())
SECRET_NAMES = frozenset("token secret key apikey api_key api-key access_key access-key secret_key secret-key password passwd pwd auth bearer credential credentials private_key client_secret access_token".split())
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "GB": 22, "IE": 22, "PT": 25, "PL": 28, "SE": 24, "NO": 15, "DK": 18, "FI": 18, "LU": 20}
CONTEXT = {
    "email": "email e-mail mail contact correo courriel kontakt write".split(),
    "ip": "ip address host server client addr adresse".split(),
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment".split(),
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono ring".split(),
    "secret": "token secret key password passwd api auth credential bearer".split(),
    "national_id": "ssn social security insurance id number".split(),
    "iban": "iban account konto compte cuenta bank".split(),
}
_CONTEXT = {k: re.compile(r"(?<!\w)(?:" + "|".join(v) + r")(?!\w)", re.I) for k, v in CONTEXT.items()}


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    extra: str = ""


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds in code points, by start, then kind."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        done = at = 0
        while (at := text.find("@", at)) >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                out.append(("email", start, domain.end()))
                done = domain.end()
            else:
                done = max(done, at)  # no later match can start before this sign
            at += 1
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def candidates(text: str) -> list[Candidate]:
    """Base spans and what the wider patterns propose, without proposals that overlap a base span of any kind."""
    base = base_spans(text)
    out = [Candidate(k, a, b, True) for k, a, b in base]
    found: list[Candidate] = []
    if "=" in text or ":" in text:
        found += [Candidate("secret", m.start(2), m.end(2), False, m[1].lower()) for m in _SECRET.finditer(text)]
    if "at" in text or "AT" in text:
        low = text.lower()
        if ("(at)" in low or "[at]" in low or " at " in low) and ("(dot)" in low or "[dot]" in low or " dot " in low):
            found += [Candidate("email", m.start(), m.end(), False, m[3].lower()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        found += [Candidate("national_id", m.start(), m.end(), False) for m in _NATIONAL.finditer(text)]
        found += [Candidate("phone", m.start(), m.end(), False) for m in _LOCAL_PHONE.finditer(text)]
        found += [Candidate("iban", m.start(), m.end(), False) for m in _IBAN.finditer(text)]
    starts = [c.start for c in out]
    reach = list(itertools.accumulate((c.end for c in out), max))
    taken = []
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        # a secret may hold what looks like a card number; anything else yields to the base
        k = bisect.bisect_left(starts, c.end)  # base spans that start before this one ends
        if c.kind != "secret" and k and reach[k - 1] > c.start or taken and c.start < taken[-1].end:
            continue
        taken.append(c)
    return out + taken


def _strict(text: str, c: Candidate) -> int:
    """The form, strictly: 1 yes, -1 no."""
    s = text[c.start : c.end]
    if c.kind == "email":
        local = s.split("@")[0] if "@" in s else s.split()[0]
        return 1 if not local.startswith(".") and not local.endswith(".") and ".." not in local and len(local) <= 64 else -1
    if c.kind == "ip":
        return 1 if all(p == "0" or p[0] != "0" for p in s.split(".")) else -1
    if c.kind == "card":
        return 1 if len(_digits(s)) in (13, 14, 15, 16, 19) and len(set(_digits(s))) > 2 else -1
    if c.kind == "phone":
        return 1 if len(_digits(s)) >= 10 and s.count("(") == s.count(")") and len(set(_digits(s))) > 2 else -1
    if c.kind == "secret":
        return 1 if any(x.isdigit() for x in s) and any(x.isalpha() for x in s) and len(set(s.lower())) >= 8 else -1
    if c.kind == "national_id":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    packed = s.replace(" ", "")
    return 1 if int("".join(str(int(x, 36)) for x in packed[4:] + packed[:4])) % 97 == 1 else -1


def _gazetteer(text: str, c: Candidate) -> int:
    """What lists say: 1 yes, -1 no, 0 nothing."""
    s = text[c.start : c.end]
    if c.kind == "email":
        return 1 if (c.extra or s.rsplit(".", 1)[-1].lower()) in DOMAIN_ENDINGS else -1
    if c.kind == "ip":
        return -1 if s.split(".")[0] in ("0", "127", "255") else 0
    if c.kind == "card":
        return 1 if _digits(s).startswith(ISSUERS) else -1
    if c.kind == "phone":
        return (1 if _digits(s).startswith(CALLING_CODES) else -1) if c.base else (1 if _digits(s)[0] not in "01" else -1)
    if c.kind == "secret":
        return 1 if c.extra in SECRET_NAMES or c.extra.split("_")[-1].split("-")[-1] in SECRET_NAMES else -1
    if c.kind == "iban":
        return 1 if IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")) else -1
    return 0


def _context(text: str, c: Candidate) -> int:
    """Telling words in the 40 characters before the span."""
    return 1 if _CONTEXT[c.kind].search(text[max(0, c.start - 40) : c.start]) else 0


def _glued(text: str, c: Candidate) -> int:
    """Part of something longer: letters, digits or a path on either side."""
    before, after = text[c.start - 1 : c.start], text[c.end : c.end + 1]
    if c.kind == "secret":
        return 1 if before in ("'", '"') and after == before else 0
    return -1 if before.isalnum() or before in ("/", "_", "=") or after.isalnum() or after in ("/", "_") else 1


def _varied(text: str, c: Candidate) -> int:
    """Few distinct characters for its length is filler."""
    s = text[c.start : c.end]
    return -1 if len(set(s)) * 4 < min(len(s), 24) else 0


LABELERS = (_strict, _gazetteer, _context, _glued, _varied)


def features(text: str, c: Candidate) -> tuple[int, ...]:
    """The votes, then the span's shape in small classes: length, share of digits, of letters, whether base."""
    s = text[c.start : c.end]
    n = len(s)
    shape = (min(n // 6, 6), 4 * sum(x.isdigit() for x in s) // n, 4 * sum(x.isalpha() for x in s) // n, int(c.base))
    return (*(f(text, c) for f in LABELERS), *shape)


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation for independent labelers that may abstain: the probability of each row of ``votes``
    (values -1, 0, 1), which stands for ``weight`` candidates. Starts from the majority, with a weak prior that a
    labeler is right more often than not."""
    score = votes.sum(1)
    p = 1 / (1 + np.exp(-score.astype(float)))
    for _ in range(rounds):
        prior = np.clip((weight @ p + 1) / (weight.sum() + 2), 0.02, 0.98)
        log = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for value in (-1, 1):
                at = votes[:, j] == value
                yes = (weight[at] @ p[at] + (3 if value > 0 else 1)) / (weight @ p + 5)
                no = (weight[at] @ (1 - p[at]) + (1 if value > 0 else 3)) / (weight @ (1 - p) + 5)
                log[at] += np.log(yes / no)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p


def _design(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
    votes = x[:, : len(LABELERS)]
    shape = x[:, len(LABELERS) :]
    return np.column_stack([np.ones(len(x)), votes > 0, votes < 0, shape / 6.0, *(kind == k for k in range(len(KINDS)))]).astype(float)


class SpanClassifier:
    """Logistic regression on votes and shape, trained on the estimated probabilities."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[tuple, float] = {}

    @classmethod
    def fit(cls, kind: np.ndarray, x: np.ndarray, weight: np.ndarray, steps: int = 25) -> SpanClassifier:
        target = np.zeros(len(x))
        for k in range(len(KINDS)):
            at = kind == k
            if at.any():
                target[at] = estimate(x[at, : len(LABELERS)], weight[at])
        design = _design(kind, x)
        w = np.zeros(design.shape[1])
        scaled = weight / max(weight.sum(), 1) * len(weight) if len(weight) else weight
        for _ in range(steps):  # Newton's method with a ridge
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (scaled * (p - target)) + 0.1 * w
            hessian = (design.T * (scaled * np.maximum(p * (1 - p), 1e-4))) @ design + 0.1 * np.eye(len(w))
            w -= np.linalg.solve(hessian, gradient)
        return cls(w)

    def probability(self, kind: str, x: tuple[int, ...]) -> float:
        key = (kind, x)
        if key not in self.known:
            self.known[key] = float(1 / (1 + np.exp(-np.clip(_design(np.array([KINDS.index(kind)]), np.array([x]))[0] @ self.weights, -30, 30))))
        return self.known[key]

    def spans(self, text: str, threshold: float = 0.5) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, base) by start, then kind: base spans, and candidates that the classifier takes."""
        out = [(c.kind, c.start, c.end, c.base) for c in candidates(text) if c.base or self.probability(c.kind, features(text, c)) >= threshold]
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def fit(docs: DataFrame, text_column: str = "text", patterns: int = 20_000) -> SpanClassifier:
    """Learns from the candidates of all texts. What comes to the driver is one row per pattern of kind, votes and
    shape; the ``patterns`` most frequent train the classifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple] = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                counts.update((KINDS.index(c.kind), features(text, c)) for c in candidates(text))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.int32()), pa.array([list(x) for _, x in counts], pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], names=["kind", "x", "n"])

    rows = docs.select(F.col(text_column).cast("string")).mapInArrow(run, "kind int, x array<int>, n long").groupBy("kind", "x").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "x").limit(patterns).collect()
    x = np.array([r.x for r in rows], np.int64).reshape(len(rows), len(LABELERS) + 4)
    return SpanClassifier.fit(np.array([r.kind for r in rows], np.int64), x, np.array([r.n for r in rows], float))


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SpanClassifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id column, base, spans) for every row: arrays of struct(kind, start, end) in code points, end exclusive, by
    start, then kind. Null and empty texts have none; rows that repeat get a row each; an empty table gives an empty
    result; other columns are ignored."""
    kind = docs.schema[id_column].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.spans(t) for t in strings(batch.column(1))]
            base = [[{"kind": k, "start": a, "end": b} for k, a, b, own in row if own] for row in found]
            every = [[{"kind": k, "start": a, "end": b} for k, a, b, _ in row] for row in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, item), pa.array(every, item)], names=["id", "base", "spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, base {spans}, spans {spans}")
    return out.select(F.col("id").alias(id_column), "base", "spans")


def redacted(text: str, spans) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, done = [], 0
    end, name = 0, None
    start = 0
    for kind, a, b in [*spans, ("", len(text) + 1, len(text) + 1)]:
        if name is not None and a < end:
            end = max(end, b)
            continue
        if name is not None:
            out.append(text[done:start])
            out.append(f"[{name.upper()}]")
            done = end
        name, start, end = kind, a, b
    out.append(text[done:])
    return "".join(out)


def redact(docs: DataFrame, model: SpanClassifier, text_column: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_column`` replaced by its kind; null texts stay null."""
    columns = docs.columns
    at = columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, [s[:3] for s in model.spans(t)]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)], names=columns)

    return docs.mapInArrow(run, docs.schema)


def digest(base: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_listed(base).encode()).hexdigest()
