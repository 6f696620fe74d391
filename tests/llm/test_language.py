import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.llm import language, queries


def test_gradients_equal_differences():
    """Back-propagation through time against central differences, in double precision."""
    net = language.BiGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, labels, k = [b" abc ", b" x ", b" hello "], np.array([0, 2, 1]), 4

    def states(keep):
        x, mask, xb, lengths = net._batch(words)
        place = np.maximum(lengths - 1 - np.arange(len(x))[:, None], 0)
        out = []
        for way, own in (("f", x), ("b", xb)):
            h, saved, rows = np.zeros((x.shape[1], k)), [], []
            for t in range(len(own)):
                a = net.p[f"x{way}"][own[t]] + net.p[f"c{way}"]
                g = 1 / (1 + np.exp(-(a[:, : 2 * k] + h @ net.p[f"h{way}"][:, : 2 * k])))
                z, r = g[:, :k], g[:, k:]
                n = np.tanh(a[:, 2 * k :] + (r * h) @ net.p[f"h{way}"][:, 2 * k :])
                saved.append((h, z, r, n))
                h = h + mask[t][:, None] * z * (n - h)
                rows.append(h)
            out.append((np.array(rows), saved))
        return x, mask, xb, place, out

    def loss():
        x, mask, xb, place, ((f, _), (b, _)) = states(False)
        both = np.concatenate([f, np.take_along_axis(b, place[:, :, None], 0)], 2)
        s = both @ net.p["o"] + net.p["b"]
        s = s - np.log(np.exp(s).sum(2, keepdims=True))
        return -(s[:, np.arange(3), labels] * mask).sum()

    x, mask, xb, place, ((f, sf), (b, sb)) = states(True)
    both = np.concatenate([f, np.take_along_axis(b, place[:, :, None], 0)], 2)
    s = both @ net.p["o"] + net.p["b"]
    s = np.exp(s) / np.exp(s).sum(2, keepdims=True)
    s[:, np.arange(3), labels] -= 1
    d = s * mask[:, :, None]
    dh = d @ net.p["o"].T
    index = np.where(mask > 0, place, np.arange(len(x))[:, None])
    back = np.zeros_like(b)
    np.put_along_axis(back, np.broadcast_to(index[:, :, None], back.shape), dh[:, :, k:] * mask[:, :, None], 0)
    grad = {}
    net._back("f", x, mask, sf, dh[:, :, :k], grad)
    net._back("b", xb, mask, sb, back, grad)
    draw = np.random.default_rng(1)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb"):
        p = net.p[name]
        for _ in range(12):
            at = (ord("l"), draw.integers(12)) if name[0] == "x" else tuple(draw.integers(n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-4), (name, at)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op10_language(spark, folder)
    assert got.count() == 1000 and got.where("score < 0 or score > 1").count() == 0
    met = got.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert met.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.98


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents, epochs=3)


def test_every_position_counts_once(model):
    """Pooling cached words equals labelling the words of the text one by one."""
    text = "The the une der and with with " * 3
    name, score = model.predict([text])
    words = text.lower().split()
    _, sums = model.network.labels_of([p for w in words for p in language.pieces(w)])
    total = sums.astype(float).sum(0)
    assert name == [model.languages[int(total.argmax())]] and score[0] == pytest.approx(total.max() / total.sum(), abs=1e-5)


def test_odd_rows(odd, empty, model):
    got = language.identify(odd.withColumn("lang_pred", F.lit("x")), model)
    assert got.count() == odd.count() and language.identify(empty, model).count() == 0
    rows = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert all((rows[i].lang_pred, rows[i].lang_score) == ("und", 0.0) for i in (3, 4, 5))
    assert model.predict(["\u00b2 12 _ \u2167", "\u00b2a"])[0][0] == "und" != model.predict(["\u00b2a"])[0][0]
    assert all(rows[i].lang_pred in model.languages for i in (1, 6, 7, 8))


def test_too_few_languages(spark, odd, empty):
    assert language.fit(empty).languages == []
    one = language.fit(odd.where("lang = 'en'"))
    assert one.predict(["abc", "", "12"]) == (["en", "und", "und"], [1.0, 0.0, 0.0])
    assert language.LanguageModel([], None).predict(["abc"]) == (["und"], [0.0])


def test_held_out_rows_teach_nothing(spark, small, tmp_path):
    df = spark.read.parquet(f"{small}/documents.parquet")
    df.withColumn("lang", F.when(queries.crc_remainder("doc_id", 3) == 1, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ({r.doc_id: r.lang_pred for r in queries.op10_language(spark, f).collect()} for f in (small, str(tmp_path)))
    assert a == b and "xx" not in set(b.values())


def test_rows_of_one_id_take_one_place(spark):
    rows = [(1, "one two three", "en")] * 5 + [(2, "eins zwei drei", "de")] * 5
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=2, epochs=1)
    assert model.languages == ["de", "en"]


def plain_states(net, way, data):
    """One direction's states, a byte and a unit at a time."""
    k = net.hidden
    wx, wh, c = net.p[f"x{way}"].astype(float), net.p[f"h{way}"].astype(float), net.p[f"c{way}"].astype(float)
    h, out = np.zeros(k), []
    for byte in data:
        z, r, n = np.zeros(k), np.zeros(k), np.zeros(k)
        for u in range(k):
            z[u] = 1 / (1 + np.exp(-(wx[byte, u] + c[u] + h @ wh[:, u])))
            r[u] = 1 / (1 + np.exp(-(wx[byte, k + u] + c[k + u] + h @ wh[:, k + u])))
        for u in range(k):
            n[u] = np.tanh(wx[byte, 2 * k + u] + c[2 * k + u] + (r * h) @ wh[:, 2 * k + u])
        h = (1 - z) * h + z * n
        out.append(h)
    return out


def test_predictions_equal_a_plain_network(spark, documents, model):
    """Whole documents, word by word and byte by byte, without batches, padding or caches."""
    rows = documents.select("doc_id", "text").orderBy("doc_id").limit(6).collect()
    got = {r.doc_id: r for r in language.identify(documents.where(F.col("doc_id").isin([r.doc_id for r in rows])), model).collect()}
    net = model.network
    for row in rows:
        total, known = np.zeros(net.labels), {}
        for word in language.letters(row.text):
            if word not in known:
                known[word] = np.zeros(net.labels)
                for data in language.pieces(word):
                    forward, backward = plain_states(net, "f", data), plain_states(net, "b", data[::-1])[::-1]
                    for a, b in zip(forward, backward, strict=True):
                        s = np.exp(np.concatenate([a, b]) @ net.p["o"].astype(float) + net.p["b"])
                        known[word] += s / s.sum()
            total += known[word]
        assert got[row.doc_id].lang_pred == model.languages[int(total.argmax())]
        assert got[row.doc_id].lang_score == pytest.approx(total.max() / total.sum(), abs=1e-4)


def test_marks_belong_to_their_words():
    assert language.letters("नमस्ते दुनिया, é é 12 _a1b") == ["नमस्ते", "दुनिया", "é", "é", "a", "b"] and language.letters("́ 1") == []


def test_rows_are_bounded_as_keys_are(spark):
    """An id on 500 rows teaches one of them: that with the least hash of its text."""
    rows = [(7, f"hotword{i} other", "xx") for i in range(500)] + [(i, f"plain{i} words", "yy") for i in range(100, 118)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    least = df.where("doc_id = 7").orderBy(F.xxhash64("text")).first().text
    seen = []

    class Seen:
        def __init__(self, *a): ...
        def fit(self, words, *a):
            seen.extend(words)
            return self

    before, language.BiGRU = language.BiGRU, Seen
    try:
        language.fit(df, sample_docs=20)
    finally:
        language.BiGRU = before
    hot = {w for w in seen if b"hotword" in w or b"hot" in w}
    assert hot == {b" " + w.encode() + b" " for w in language.letters(least) if w != "other"}


def test_small_caches_change_nothing(model, texts):
    some = [t or "" for t in list(texts.values())[:40]]
    want = model.predict(some)
    before = language._WORDS
    try:
        language._WORDS = 7
        model.cache = {}
        got = model.predict(some)
        assert len(model.cache) <= 7
    finally:
        language._WORDS = before
        model.cache = {}
    assert got[0] == want[0]
    assert got[1] == pytest.approx(want[1], abs=1e-6)
