import time

import numpy as np
import pytest

from strandsift.llm import licenses, queries

LINES = {"Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License", "All-rights-reserved": "All rights reserved", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def test_query_finds_every_planted_line(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op6_licenses(spark, folder).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = sorted((t.find(line, p), name) for name, line in LINES.items() for p in [k for k in range(len(t)) if t.startswith(line, k)])
        found = sorted((int(s.split(":")[1]), s.split(":")[0]) for s in got[i].spans.split(",") if s)
        assert found == want
        assert got[i].n_matches == len(want)


def test_every_template_is_found_whole(scanner):
    for name, text in licenses.TEMPLATES.items():
        page = f"some words before it. {text} and some after"
        found = scanner.scan(page.encode())
        assert any(n == name and c == 1.0 for n, _, _, c in found), name


def test_edited_notice_still_aligns(scanner):
    text = licenses.TEMPLATES["MIT-text"].replace("free of charge", "gratis").replace("publish, distribute,", "publish & give out,").replace("without limitation", "")
    (name, a, b, share), *rest = scanner.scan(f"é {text} tail".encode())
    assert name == "MIT-text" and 0.85 < share < 1 and not rest
    assert f"é {text} tail"[a:b].startswith("Permission is hereby") and f"é {text} tail"[a:b].endswith("portions of the Software")


def test_half_a_notice_is_none(scanner):
    half = " ".join(licenses.TEMPLATES["BSD-text"].split()[:12])
    assert scanner.scan(half.encode()) == [] and licenses.Scanner(coverage=0.3).scan(half.encode())[0][0] == "BSD-text"


def test_repeats_are_counted(scanner):
    assert len(scanner.scan(b"All rights reserved. All rights reserved. All rights reserved.")) == 3


def test_winnowing_guarantee():
    draw = np.random.default_rng(0)
    for _ in range(200):
        shared = draw.integers(1, 2**60, licenses.GRAM + licenses.WINDOW - 1).astype(np.uint64)
        a = np.r_[draw.integers(1, 2**60, 5).astype(np.uint64), shared, draw.integers(1, 2**60, 5).astype(np.uint64)]
        hashes = licenses.grams(a)
        assert set(hashes[licenses.winnow(hashes)].tolist()) & set(licenses.grams(shared).tolist())


def test_alignment_equals_whole_table():
    """A band as wide as the table gives the unbanded optimum."""
    def table(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h

    def of_matches(a, b):
        """Of alignments of all of ``b`` with a run of ``a``: the score of the best, and how many words each such best matches."""
        best = {(i, 0): {0: {0}} for i in range(len(a) + 1)}
        for j in range(len(b) + 1):
            for i in range(len(a) + 1):
                if j == 0:
                    continue
                ways: dict = {}
                for key, gain, hit in (((i - 1, j - 1), 2 if i and a[i - 1] == b[j - 1] else -1, int(i > 0 and a[i - 1] == b[j - 1])), ((i - 1, j), -1, 0), ((i, j - 1), -1, 0)):
                    for score, counts in best.get(key, {}).items():
                        ways.setdefault(score + gain, set()).update(c + hit for c in counts)
                best[i, j] = {max(ways): ways[max(ways)]} if ways else {}
        ends = [x for i in range(len(a) + 1) for x in best[i, len(b)].items()]
        top = max(s for s, _ in ends)
        return top, set().union(*(c for s, c in ends if s == top))

    draw = np.random.default_rng(3)
    for _ in range(60):
        a, b = draw.integers(1, 5, draw.integers(1, 9)).astype(np.uint64), draw.integers(1, 5, draw.integers(1, 12)).astype(np.uint64)
        h = table(a, b)
        matched, first, end = licenses.align(a, b, 0, 99)
        if not h.max():
            assert matched == 0
            continue
        score, counts = of_matches(a, b[first:end])
        assert h[:, end].max() == h.max() == score and matched in counts


def test_odd_rows(odd, empty):
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    assert licenses.scan(odd).where("size(matches) > 0").count() == 0


def test_repeated_phrases_make_few_regions():
    """A template that repeats a phrase, in a text that repeats the template."""
    scanner = licenses.Scanner({"chorus": "one two three four and one two three four and one two three four end"})
    text = " then ".join(["one two three four and one two three four and one two three four end"] * 50)
    found = scanner.scan(text.encode())
    assert len(found) == 50 and all(n == "chorus" and c == 1.0 for n, _, _, c in found)


def test_many_matches_take_little_time():
    begun = time.perf_counter()
    assert len(licenses.Scanner().scan(b"All rights reserved. " * 20_000)) == 20_000
    assert time.perf_counter() - begun < 30
