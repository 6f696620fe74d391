import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.llm import queries, toxicity
from strandsift.llm.gbt import Boosted, Isotonic


def test_boosting_learns_an_interaction():
    draw = np.random.default_rng(0)
    x = draw.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    margin = Boosted(rounds=40, depth=3).fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == y[1500:]).mean() > 0.97


def test_isotonic_is_monotone_and_calibrated():
    draw = np.random.default_rng(1)
    m = draw.normal(size=4000)
    y = (draw.random(4000) < 1 / (1 + np.exp(-3 * m))).astype(float)
    f = Isotonic().fit(m, y)
    grid = f(np.linspace(-4, 4, 100))
    assert (np.diff(grid) >= 0).all() and 0 < grid[0] < 0.1 and 0.9 < grid[-1] < 1
    near = np.abs(m) < 0.2
    assert abs(f(m[near]).mean() - y[near].mean()) < 0.06


def test_features_see_what_they_name():
    f = toxicity.Features({"=badword": 3.0, "vile*": 2.5})
    row = dict(zip(toxicity.FEATURES, f.row("YOU absolute badword, you vilest b4dword!!! sooo id!ot"), strict=True))
    assert row["strong_count"] == 2 and row["near_second_person"] >= 2 and row["capital_words"] > 0
    assert row["obfuscated"] > 0 and row["obfuscated_hits"] == 2 and row["exclamation"] > 0 and row["repeated_letters"] > 0
    assert len(f.row("")) == len(toxicity.FEATURES)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op2_toxicity(spark, folder)
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    met = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count(F.lit(1))).first()
    assert met[1] > 50 and met[0] >= 0.9


def test_labels_of_the_fold_do_not_matter(spark, small, tmp_path):
    """Turning round every held-out label changes no score."""
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "labels":
            df = df.withColumn("toxic", F.when(queries.crc_remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    a = {r.doc_id: r.score for r in queries.op2_toxicity(spark, small).collect()}
    b = {r.doc_id: r.score for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert a == b


def test_odd_rows(spark, odd, empty, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(documents, labels)
    got = toxicity.score(odd, model, output="score")
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"] and got.count() == odd.count()
    scores = [r.score for r in got.collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert len({r.score for r in got.where("coalesce(text, '') = ''").collect()}) == 1
    assert toxicity.score(empty, model).count() == 0
    marked = odd.select("doc_id", F.lit(1).alias("label"))
    assert toxicity.fit(odd, marked).rate == 1.0 and toxicity.fit(empty, marked).rate == 0.0
    assert toxicity.score(odd, toxicity.fit(odd, marked.limit(0))).where("toxicity <> 0").count() == 0


@pytest.mark.parametrize("text", ["", "x", "!!!", "\U0001f600"])
def test_model_without_trees(text):
    assert toxicity.ToxicityModel({}, None, None, 0.25).score([text], toxicity.Features({})).tolist() == [0.25]


def test_features_need_no_other_sign():
    """Each sign counts by itself, whatever else the text holds."""
    row = lambda text: dict(zip(toxicity.FEATURES, toxicity.Features({"=kill": 3.0}).row(text), strict=True))
    stretched = row("what a stuuupid thing to kiiilll")
    assert stretched["repeated_letters"] > 0 and stretched["seed_count"] == 2 and stretched["strong_count"] == 1
    assert row("a w8rd here")["obfuscated"] == row("a w8rd here $")["obfuscated"] > 0
    assert row("The House of Anna")["capital_letters"] > 0


def test_rows_of_one_id_teach_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 10 + [(2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    assert toxicity.fit(docs, labels).rate == pytest.approx(1 / 3)


def plain_features(text, lexicon):
    """Each figure by its own plain count over the text."""
    words = re.findall(r"\w+", text)
    n, chars = max(len(words), 1), max(len(text), 1)

    def forms(word):
        out = {""}
        for letter, run in itertools.groupby(word):
            k = len(list(run))
            out = {o + letter * m for o in out for m in ((1, 2) if k > 2 and letter.isalpha() else (k,))}
        return out if max((len(list(g)) for c, g in itertools.groupby(word) if c.isalpha()), default=0) > 2 else {word}

    def look(word):
        every = {word} | forms(word)
        hits = {g: lexicon[g] for f in every for g in [f"={f}", *(f"{f[:k]}*" for k in range(4, 9) if len(f) > k)] if g in lexicon}
        best = max(((v, g) for g, v in hits.items()), default=(0.0, ""))
        return bool(every & toxicity.SEED_LEXICON), *best

    lower = [w.lower() for w in words]
    told = [look(w) for w in lower]
    hit = [i for i, (seed, _, gram) in enumerate(told) if seed or gram]
    named = [told[i][2] or lower[i] for i in hit]
    you = [w in toxicity.SECOND_PERSON for w in lower]
    shown = re.findall(r"[^\W\d_]+(?:[@*$!0-9]+[^\W\d_]+)+", text)
    plain = [look(x.lower().translate(toxicity.LOOKALIKES)) for x in shown]
    count = lambda signs: sum(text.count(c) for c in signs)
    values = [told[i][1] for i in hit]
    seeds, strong, weak = sum(told[i][0] for i in hit), sum(v >= 2.0 for v in values), sum(v > 0 for v in values)
    return [
        np.log1p(len(words)), np.log1p(len(text)), seeds, 100 * seeds / n, strong, 100 * strong / n, weak, 100 * weak / n, sum(values), 100 * sum(values) / n, max(values, default=0.0),
        max((named.count(g) for g in named if g.endswith("*")), default=0), len(set(named)), sum(any(you[max(0, i - 4) : i + 5]) for i in hit), 100 * sum(you) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n, sum(c.isupper() for c in text) / chars, 100 * count("!") / n, 100 * count("?") / n, count("!?.,;:\"'()-") / n, count("#*$%&|<>") / n,
        100 * len(shown) / n, sum(bool(s or g) for s, _, g in plain), 100 * len(re.findall(r"([^\W\d_])\1\1", text)) / n, sum(w.isdigit() for w in words) / n, (len(text.encode()) - len(text)) / chars, sum(map(len, words)) / n,
    ]


def test_features_equal_plain_counts(texts):
    lexicon = {"=badword": 3.0, "vile*": 2.5, "=idiot": 1.5, "stupi*": 2.1, "=the": 0.8}
    made = ["", "!!!", "YOU absolute badword, you vilest b4dword!!! sooo id!ot", "stuuupid viiile vileness stupidity, toi ÉTÉ 12 #1 $$ <b> idiot idiots"]
    f = toxicity.Features(lexicon)
    for text in [*made, *list(texts.values())[:60]]:
        assert f.row(text) == pytest.approx(plain_features(text, lexicon)), text[:80]


def test_margins_come_from_rows_that_the_lexicon_has_not_seen(spark, monkeypatch):
    """A word that is in the toxic texts of one fold alone is in no feature of that fold's own rows."""
    fold = lambda key: F.pmod(F.xxhash64(F.concat(F.lit("fold"), F.col(key).cast("string"))), F.lit(toxicity._FOLDS))
    ids = spark.range(400).select("id", fold("id").alias("fold"), (F.col("id") % 2).cast("int").alias("label"))
    text = F.concat(F.lit("some plain words here "), F.when((F.col("label") == 1) & (F.col("fold") == 0), "plantedword").when(F.col("label") == 1, "nastyterm").otherwise("calm"))
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text"))
    made = []

    class Kept(toxicity.Features):
        def __init__(self, lexicon):
            made.append(lexicon)
            super().__init__(lexicon)

    rows = []

    class Trees:
        def fit(self, x, y):
            rows.append((x, y))
            return self

        def margin(self, x):
            rows.append((x, None))
            return x[:, 0] * 0

    monkeypatch.setattr(toxicity, "Boosted", Trees)
    model = toxicity.fit(docs, ids.select(F.col("id").alias("doc_id"), "label"))
    assert "=plantedword" in model.lexicon and "=nastyterm" in model.lexicon
    at = toxicity.FEATURES.index("weight_most")
    unseen = [x for x, y in rows if y is None]
    assert len(unseen) == toxicity._FOLDS
    assert unseen[0][:, at].max() == 0  # planted words of fold 0 weigh nothing there
    assert all(x[:, at].max() > 0 for x in unseen[1:])


def test_null_ids_teach_nothing(spark):
    docs = spark.createDataFrame([(None, "x"), (1, "y")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1)] * 5 + [(1, 0)], "doc_id long, label int")
    assert toxicity.fit(docs, labels).rate == 0.0


def test_no_module_defines_a_name_twice():
    import ast
    import pathlib

    for path in pathlib.Path(toxicity.__file__).parent.glob("*.py"):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path.name
