import re
from collections import Counter

from pyspark.sql import functions as F

from strandsift.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stated(text):
    w = WORD.findall(text or "")
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_query_equals_brute_force(spark, small, texts):
    got = queries.op5_quality(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        want = stated(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_figures_at_the_edges(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d", "x\nx\n\nx \n\t\nx", "a b c d e f a b c d e f a b c", "# $% &|<>*", "\x0bq\x0cq\rq", "a b c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(df, []).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stated(texts[r.doc_id])


def test_order_never_changes_the_verdict(spark, documents):
    rules = list(quality.RULES)
    a = {r.doc_id: r.kept for r in quality.judge(documents, rules).collect()}
    b = {r.doc_id: r.kept for r in quality.judge(documents, rules[::-1]).collect()}
    order = quality.plan(documents)
    assert a == b and sorted(r.name for r in order) == sorted(r.name for r in rules)


def test_good_documents_stay_and_junk_goes(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    met = quality.judge(documents, list(quality.RULES)).join(labels, "doc_id")
    assert met.where("quality = 1 and not base_failed and not kept").count() == 0
    assert met.where("quality = 0 and kept").count() == 0


def test_each_rule_rejects_its_own_case(spark):
    clean = "these are some quite ordinary words in a sentence that nobody would ever want to reject from a corpus"
    cases = {"symbols": clean + " ##### |||| ****", "duplicate_lines": "\n".join(f"again\nword{x} term{x} noun{x} verb{x} name{x}" for x in range(6)), "word_length": " ".join("abcdefghij"), "exclamation": clean.replace(" ", "! "), "capitals": clean.upper(), "letters": " ".join(str(i * 7919) for i in range(40)), "stuttering": " ".join(f"{x} {x}" for x in clean.split()), "ellipsis_lines": "\n".join(x + "..." for x in ("one two three", "four five six", "seven eight nine", "ten more words")), "bullet_lines": "\n".join(f"- item {x}one {x}two {x}three" for x in "abcdefg")}
    df = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    for rule in quality.RULES:
        got = {r.doc_id: r.failed_rule for r in quality.judge(df, [rule]).collect()}
        assert got[rule.name] == rule.name, rule.name
    assert quality.judge(spark.createDataFrame([(1, clean)], "doc_id long, text string"), list(quality.RULES)).first().kept


def test_odd_rows_and_native_plan(odd, empty):
    got = quality.judge(odd.withColumn("base", F.lit(1)).withColumn("kept", F.lit(1)))
    assert got.count() == odd.count() and quality.judge(empty).count() == 0
    assert got.where("doc_id in (3, 4, 5) and kept").count() == 0 and got.where("doc_id = 1 and kept").count() == 1
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_cheapest_first_is_conditional():
    """The second rule rejects what the first one does, and the third little, but of the rest."""
    rows = {(True, True, False): 50, (False, False, True): 5, (False, True, False): 1, (False, False, False): 44}
    patterns = lambda *costs: {v: (n, [n * c for c in costs]) for v, n in rows.items()}
    assert quality.cheapest_first(patterns(1.0, 1.0, 1.0)) == [1, 2, 0]
    assert quality.cheapest_first(patterns(1.0, 100.0, 1.0)) == [0, 2, 1]
    assert quality.cheapest_first({(False, False): (3, [4.0, 4.0])}) == [0, 1]  # a tie
    assert quality.cheapest_first({}) == []


def test_two_plans_agree(spark, documents, empty):
    """On the same sample, however its rows are dealt."""
    first, second = quality.plan(documents), quality.plan(documents)
    assert [r.name for r in first] == [r.name for r in second]
    assert [r.name for r in quality.plan(empty)] == [r.name for r in quality.RULES]
    dear = tuple(quality.Rule(r.name, r.rejects, 0.0 if r.name == "stuttering" else 1e6) for r in quality.RULES)
    rejecting = spark.createDataFrame([(i, " ".join(f"{w}{i} {w}{i}" for w in "ab cd ef gh ij kl".split())) for i in range(60)], "doc_id long, text string")
    assert quality.plan(rejecting, dear)[0].name == "stuttering"
