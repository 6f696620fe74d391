import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandsift.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def slow():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(rows, texts, slow, length=1024):
    """Exact round trip: each id in exactly one piece, sequences gapless, all but the last full."""
    ids = {k: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for k, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(ids[k][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[k])
    assert sorted(seqs) == list(range(len(seqs)))
    for s, own in seqs.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == len(seqs) - 1 and at < length
    return seqs


def test_round_trip(spark, small, texts, slow):
    check(queries.op3_packing(spark, small).collect(), texts, slow)


def test_every_window_has_the_target_mixture(spark, documents, texts, slow):
    seqs = check(packing.pack(documents, PATH).collect(), texts, slow)
    total, share = sum(r.length for s in seqs.values() for r in s), defaultdict(int)
    for s in seqs.values():
        for r in s:
            share[r.source] += r.length / total
    for s in list(seqs)[:-2]:
        own = defaultdict(int)
        for r in seqs[s]:
            own[r.source] += r.length
        assert all(abs(own[q] - 1024 * p) < 2 for q, p in share.items() if 1024 * p >= 1 and s < len(seqs) - 3)


def test_given_weights_and_rare_sources(spark, slow):
    rows = [(i, f"word {i} " * 60, "big") for i in range(40)] + [(100 + i, "a few words", f"rare{i}") for i in range(50)] + [(200 + i, "other text " * 80, "mid") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    texts = {i: t for i, t, _ in rows}
    for weights in (None, {"big": 1, "mid": 3}, {"mid": 1.0}, {"absent": 1.0}):
        seqs = check(packing.pack(df, PATH, length=64, weights=weights).collect(), texts, slow, 64)
        if weights == {"big": 1, "mid": 3}:
            own = [sum(r.length for r in seqs[s] if r.source == "mid") for s in range(20)]
            assert all(abs(x - 48) <= 1 for x in own)


@pytest.mark.parametrize("text", ["", " ", "Hello  world\n\n x", "<|endoftext|> stays text", "naïve café ÀÉ 日本語 😀 ́", "\t\t  \r\n", "it's we'll I'D 1234567 3.14", "a" * 3000, " " * 2000, "  x​"])
def test_ids_equal_the_tokenizer(text, slow):
    e = packing.Encoder(PATH)
    assert e(text) == slow.encode(text, add_special_tokens=False).ids and e._fast is not None


def test_other_tokenizers_fall_back():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = packing.Encoder(path)
    want = Tokenizer.from_file(path)
    want.encode_special_tokens = True
    assert e("Hello there") == want.encode("Hello there", add_special_tokens=False).ids and e._fast is None


def test_odd_rows(odd, empty, slow):
    got = packing.pack(odd, PATH).collect()
    assert sum(r.length for r in got) == sum(len(slow.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert {r.doc_tokens for r in got if r.doc_id in (3, 4)} == {1}
    assert packing.pack(empty, PATH).count() == 0
    assert packing.pack(odd.drop("source"), PATH).count() > 0


def test_plan_for_a_huge_corpus():
    """The closed form stays exact where the totals no longer fit in 32 bits."""
    plan = packing.Plan({"a": 10**13, "b": 3 * 10**12, "c": 7}, {"a": 10, "b": 3, "c": 1e-9}, 1024)
    start, length, window, offset = plan.pieces("a", 5 * 10**12 + 3, 100_000)
    assert length.sum() == 100_000 and (np.diff(start) == length[:-1]).all() and (np.diff(window) >= 0).all() and (offset + length <= 1024).all()


def plain_round_robin(totals, weights, length):
    """Window by window: what each queue serves; then what retired queues still have. Quanta have 16 binary places."""
    left, windows = dict(totals), []

    def quanta(k):
        return Fraction(round(Fraction(sum(weights[p] for p in active[: k + 1]) * length * 2**16, whole)), 2**16)

    active = [q for q in totals if weights[q] > 0 and totals[q]]
    while active:
        whole = sum(weights[q] for q in active)
        credit = dict.fromkeys(active, Fraction(0))  # of the queue and those before it, since the phase began
        while True:
            serve, before = {}, 0
            for k, q in enumerate(active):
                ahead = int(credit[q] + quanta(k)) - int(credit[q])
                serve[q], before = ahead - before, ahead
            if any(serve[q] > left[q] for q in active):
                active = [q for q in active if serve[q] <= left[q]]
                break
            for k, q in enumerate(active):
                credit[q] += quanta(k)
                left[q] -= serve[q]
            windows.append(serve)
    return windows, left


@pytest.mark.parametrize(
    ("totals", "weights"),
    [({"a": 1000, "b": 9000, "c": 9500}, {"a": 1, "b": 1, "c": 1}), ({"a": 77, "b": 0, "c": 5000, "d": 3}, {"a": 2, "b": 1, "c": 5, "d": 8}), ({"a": 640, "b": 1280, "c": 500}, {"a": 1, "b": 2, "c": 0}), ({"a": 63}, {"a": 1})],
)
def test_plan_equals_plain_round_robin(totals, weights):
    length = 64
    plan = packing.Plan(totals, weights, length)
    windows, left = plain_round_robin(totals, weights, length)
    got, taken = defaultdict(lambda: defaultdict(int)), defaultdict(set)
    draw = random.Random(1)
    for q, n in totals.items():
        at = 0
        while at < n:  # documents of any size
            size = min(n - at, draw.choice((1, 5, 60, 900)))
            start, part, window, offset = plan.pieces(q, at, size)
            assert start.tolist() == [0, *np.cumsum(part).tolist()[:-1]] and part.sum() == size
            for p, w, o in zip(part.tolist(), window.tolist(), offset.tolist(), strict=True):
                got[w][q] += p
                assert not taken[w] & set(range(o, o + p))
                taken[w] |= set(range(o, o + p))
            at += size
    assert plan.full == len(windows)
    for w, serve in enumerate(windows):
        assert got[w] == {q: n for q, n in serve.items() if n}
    assert sum(sum(got[w].values()) for w in got if w >= len(windows)) == sum(left.values())
    assert all(taken[w] == set(range(length)) for w in range(sum(totals.values()) // length))


def test_very_long_runs_of_spaces(spark, slow):
    text = "a" + " " * 2_000_000 + "b"
    got = packing.pack(spark.createDataFrame([(1, text, "s"), (2, "c", "s")], "doc_id long, text string, source string"), PATH).where("doc_id = 1").collect()
    assert sum(r.length for r in got) == len(slow.encode(text, add_special_tokens=False).ids) + 1
