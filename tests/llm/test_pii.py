import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandsift.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_query_equals_brute_force(spark, small, texts):
    got = queries.op9_pii(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = stated(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.BASE]
        assert set(listed) <= set(r.spans.split(","))  if listed else True


@settings(max_examples=400, deadline=None)
@given(st.text("a@.1+- ()_9é", max_size=40))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == stated(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y", "a@@b.c", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824.", "+12", "+1234567890123456", "a@b.c-", "+1.2.3.4.5.6.7.8.9", "9" * 5000 + ".1.1.1", "0" * 5000 + ".1.1.1", "a@b.c.d@e.f"])
def test_base_edges(text):
    assert pii.base_spans(text) == stated(text)


def test_hard_input_takes_linear_time():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 50_000, "1 " * 100_000, "a=" * 50_000, "a-" * 200_000, "aa:" * 200_000, "x at " * 100_000, "1.1.1.1 key=abcdefabcdefabcdef " * 20_000, "a_" * 200_000 + "=", "--" * 200_000):
        pii.candidates(text)


def test_expectation_maximisation_finds_the_good_labelers():
    draw = np.random.default_rng(2)
    truth = draw.random(4000) < 0.4
    quality = (0.95, 0.9, 0.6, 0.55)
    votes = np.column_stack([np.where(draw.random(4000) < 0.2, 0, np.where((draw.random(4000) < q) == truth, 1, -1)) for q in quality])
    p = pii.estimate(votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.9 and ((p > 0.5) == truth).mean() >= ((votes.sum(1) > 0) == truth).mean()


def test_candidates_beyond_the_base(spark):
    rows = [(i, f'token = "{"%040x" % (i * 7919 * 10**40 % 2**160)}" and write to jo.doe{i} at example dot com or call (555) 010-{1000 + i} and id 123-45-{6000 + i}') for i in range(60)]
    rows += [(100 + i, f"color = aaaaaaaaaaaaaaaa and name: somethingplainhere {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: {(s.kind) for s in r.spans} for r in pii.find(df, pii.fit(df)).collect()}
    assert all("secret" in found[i] and "email" in found[i] for i in range(60)) and not any(found[100 + i] for i in range(60))


def test_redaction():
    text = "mail a@b.co, 10.0.0.1 or +1 (743) 555-3824"
    spans = pii.base_spans(text)
    assert pii.redacted(text, spans) == "mail [EMAIL], [IP] or [PHONE]"
    assert pii.redacted("abcdef", [("card", 1, 4), ("ip", 2, 5)]) == "a[CARD]f" and pii.redacted("abc", []) == "abc"


def test_odd_rows(odd, empty):
    model = pii.fit(odd)
    got = pii.find(odd, model).collect()
    assert len(got) == odd.count() and pii.find(empty, pii.fit(empty)).count() == 0
    assert all(not r.spans for r in got if r.doc_id in (3, 4, 5))
    out = pii.redact(odd, model)
    assert out.columns == odd.columns and out.where("doc_id = 3 and text is null").count() == 1


@pytest.mark.parametrize("n", [20, 250, 300, 5000])
def test_runs_have_no_upper_bound(n):
    value = ("a1B2c3D4e5" * (n // 10 + 1))[:n]
    text = f"set api_key={value} and write to {value} at {value} dot com now"
    assert {(c.kind, text[c.start : c.end]) for c in pii.candidates(text)} == {("secret", value), ("email", f"{value} at {value} dot com")}
