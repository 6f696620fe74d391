"""The registered queries over the given tables, and the DuckDB SQL that checks them.

Searches take every row whose id is divisible by 50 as a query, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.functions import sequence, vector
from strandsift.functions.substitution import parity
from strandsift.operators import align, encode, ivf, metrics, pq, search, seeds, split, tiles, trace
from strandsift.sources import fasta, ranges
from strandsift.sources.shared import scratch

K = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _queries(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).where("id % 50 = 0")


def _sequences(spark, sf_dir, name="documents", key="doc_id") -> DataFrame:
    """(seq_no, id, seq): texts as cleaned sequences, in the order of their id."""
    text = sequence.strip_upper(F.col("text"))
    return _table(spark, sf_dir, name).select(F.col(key).alias("seq_no"), F.col(key).alias("id"), sequence.clean(text).alias("seq"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})


def _long(column) -> F.Column:
    return column.cast("long")


def l2_normalize(spark, sf_dir):
    df = _vectors(spark, sf_dir).select("id", F.posexplode(vector.l2_normalize(F.col("embedding"))).alias("position", "value"))
    return _rounded(df.select("id", _long(F.col("position")).alias("position"), "value"), "value")


def dot_scores(spark, sf_dir):
    return _rounded(search.dot_scores(_queries(spark, sf_dir), _vectors(spark, sf_dir)), "score")


def cosine_scores(spark, sf_dir):
    return _rounded(search.cosine_scores(_queries(spark, sf_dir), _vectors(spark, sf_dir)), "score")


def _hits(spark, sf_dir, k=K, **options):
    return search.search(_queries(spark, sf_dir), _vectors(spark, sf_dir), k, **options)


def _shown(hits: DataFrame) -> DataFrame:
    return _rounded(hits.withColumn("rank", _long(F.col("rank"))), "score")


def topk_cosine(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, 10, strategy="blocks"))


def topk_cosine_native(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, 10, strategy="native"))


def topk_cosine_exclude_self(spark, sf_dir):
    return _shown(_hits(spark, sf_dir, 10, strategy="blocks", exclude_self=True))


def topk_dot(spark, sf_dir):
    return _shown(search.top_k_dot(_queries(spark, sf_dir), _vectors(spark, sf_dir), 100))


def gather_candidates(spark, sf_dir):
    met = search.gather(_hits(spark, sf_dir, 10), _vectors(spark, sf_dir))
    return met.select("query_id", _long(F.col("rank")).alias("rank"), "db_id", F.posexplode(F.col("embedding")).alias("position", "value")).select("query_id", "rank", "db_id", _long(F.col("position")).alias("position"), (F.round(F.col("value").cast("double"), 6) + 0.0).alias("value"))


def seq_clean(spark, sf_dir):
    return _sequences(spark, sf_dir).select("id", _long(F.length("seq")).alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def _coded(spark, sf_dir, max_len=None):
    """Codes of the upper-cased texts, other characters being unknown residues."""
    text = F.regexp_replace(sequence.strip_upper(F.col("text")), "[^A-Z]", "*")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sequence.encode(text, max_len).alias("codes"))


def _codes_shown(df):
    joined = F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")
    return df.select("id", _long(F.size("codes")).alias("n"), F.md5(joined.cast("binary")).alias("digest"))


def seq_encode(spark, sf_dir):
    return _codes_shown(_coded(spark, sf_dir))


def seq_pad(spark, sf_dir):
    return _codes_shown(_coded(spark, sf_dir, 1024))


def seq_decode(spark, sf_dir):
    return _coded(spark, sf_dir).select("id", F.md5(sequence.decode(F.col("codes")).cast("binary")).alias("digest"))


def seq_filter(spark, sf_dir):
    return fasta.filter_fasta(_sequences(spark, sf_dir), 100, 1000).select("id", _long(F.length("seq")).alias("n"))


def seq_stats(spark, sf_dir):
    return _rounded(fasta.fasta_stats(_sequences(spark, sf_dir)).select("count", _long(F.col("min_len")).alias("min_len"), _long(F.col("max_len")).alias("max_len"), "mean_len", "total_residues"), "mean_len")


def split_train_val(spark, sf_dir):
    return split.train_val_split(_sequences(spark, sf_dir).select("id"), 0.1, 42)


def split_three_way(spark, sf_dir):
    return split.three_way_split(_sequences(spark, sf_dir).select("id"), 0.8, 0.1, 42)


def train_difference(spark, sf_dir):
    ids = _sequences(spark, sf_dir).select("id")
    return split.difference(ids, split.train_val_split(ids, 0.1, 42).where("split = 'val'"))


def pair_product_capped(spark, sf_dir):
    out = split.pair_product(_sequences(spark, sf_dir, "benchmark", "item_id"), _sequences(spark, sf_dir), max_pairs=5000)
    return out.select("i", "j", "query_id", "db_id", _long(F.length("query_seq")).alias("query_len"), _long(F.length("db_seq")).alias("db_len"))


def family_relevance(spark, sf_dir):
    return metrics.family_relevance(_queries(spark, sf_dir), _vectors(spark, sf_dir))


def _annotated(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("annotations"))


def annotation_relevance(spark, sf_dir):
    docs = _annotated(spark, sf_dir)
    return metrics.annotation_relevance(docs.where("id % 50 = 0"), docs)


def _evaluated(spark, sf_dir):
    q, d = _queries(spark, sf_dir), _vectors(spark, sf_dir)
    return q.select(F.col("id").alias("query_id")), _hits(spark, sf_dir, exclude_self=True), metrics.family_judgement(q, d)


def recall_at_k(spark, sf_dir):
    return _rounded(metrics.recall_at_k(*_evaluated(spark, sf_dir), 10), "recall")


def precision_at_k(spark, sf_dir):
    return _rounded(metrics.precision_at_k(*_evaluated(spark, sf_dir), 10), "precision")


def mean_reciprocal_rank(spark, sf_dir):
    return _rounded(metrics.mean_reciprocal_rank(*_evaluated(spark, sf_dir)), "mrr")


def ndcg_at_k(spark, sf_dir):
    return _rounded(metrics.ndcg_at_k(*_evaluated(spark, sf_dir), 10), "ndcg")


def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(*_evaluated(spark, sf_dir)), "ap")


def mean_average_precision(spark, sf_dir):
    return _rounded(metrics.mean_average_precision(*_evaluated(spark, sf_dir)), "map")


def retrieval_metrics(spark, sf_dir):
    return _rounded(metrics.retrieval_metrics(*_evaluated(spark, sf_dir), (1, 5, 10, 50)), "value")


def evaluate_families(spark, sf_dir):
    q, d = _queries(spark, sf_dir), _vectors(spark, sf_dir)
    return _rounded(metrics.evaluate_families(_hits(spark, sf_dir), q, d, (1, 5, 10, 50)), "value")


def _noted(df):
    """Vectors with two annotations each, the first of which few share and the second many."""
    return df.select("id", "embedding", F.array(F.concat(F.lit("label:"), F.col("label").cast("string")), F.concat(F.lit("group:"), (F.col("id") % 3).cast("string"))).alias("annotations"))


def evaluate_annotations(spark, sf_dir):
    q, d = _noted(_queries(spark, sf_dir)), _noted(_vectors(spark, sf_dir))
    return _rounded(metrics.evaluate_annotations(_hits(spark, sf_dir), q, d, (1, 5, 10, 50)), "value")


def ranking_annotations(spark, sf_dir):
    """All branches of the ranking evaluation at once."""
    q, d = (_noted(x).join(_named(x).select("id", "label", "name"), "id") for x in (_queries(spark, sf_dir), _vectors(spark, sf_dir)))
    return _rounded(metrics.ranking_metrics(q, d, (1, 5, 10, 50)).where("task = 'annotation'"), "value")


def _named(df):
    return df.withColumn("name", F.concat(F.lit("label"), F.col("label").cast("string")))


def exact_match_recovery(spark, sf_dir):
    q, d = _named(_queries(spark, sf_dir)), _named(_vectors(spark, sf_dir))
    return _rounded(metrics.exact_match_recovery(_hits(spark, sf_dir, 1, exclude_self=True), q, d), "exact_match")


def ranking_metrics(spark, sf_dir):
    return _rounded(metrics.ranking_metrics(_named(_queries(spark, sf_dir)), _named(_vectors(spark, sf_dir)), (1, 5, 10, 50)), "value")


def family_dense_label(spark, sf_dir):
    out = split.dense_label(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family")))
    return out.withColumn("label", _long(F.col("label")))


def batch_collate(spark, sf_dir):
    out = split.batches(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_no"), "lang"), 32)
    return out.select("batch", _long(F.size("rows")).alias("n"), F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["seq_no"].cast("string"), r["lang"])), ",").alias("items"))


def batch_budget(spark, sf_dir):
    """Each document's place in batches of at most 16,384 padded letters."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("length"))
    return split.budget_batches(docs, 16_384, mix=False).select("id", "batch", "slot", "width")


def fasta_roundtrip(spark, sf_dir):
    path = scratch(spark, "fasta")
    fasta.write_fasta(_sequences(spark, sf_dir), path)
    return fasta.read_fasta(spark, path).select(F.col("id").cast("long").alias("id"), _long(F.length("seq")).alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def fasta_ranges(spark, sf_dir):
    """The same by byte ranges, each read by one task."""
    path = scratch(spark, "fasta")
    fasta.write_fasta(_sequences(spark, sf_dir), path)
    return ranges.read_ranges(spark, path, range_bytes=1 << 22).select(F.col("id").cast("long").alias("id"), _long(F.length("seq")).alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def sw_scores(spark, sf_dir):
    return align.align_all(_sequences(spark, sf_dir, "benchmark", "item_id").where("id % 50 = 0"), _sequences(spark, sf_dir), max_length=None)


def sw_pairs(spark, sf_dir):
    items, docs = _sequences(spark, sf_dir, "benchmark", "item_id"), _sequences(spark, sf_dir)
    pairs = items.select(F.col("id").alias("query_id")).join(docs.select(F.col("id").alias("db_id")), F.col("query_id") == F.col("db_id"))
    return align.align_listed(pairs, items, docs, max_length=None)


def sw_items(spark, sf_dir):
    """Each benchmark item aligned with the next one, whole."""
    items = _sequences(spark, sf_dir, "benchmark", "item_id")
    pairs = items.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("db_id"))
    return align.align_listed(pairs, items, items, max_length=None)


def sw_tiled(spark, sf_dir):
    """The same pairs in tiles of 64 letters, as two long sequences would be."""
    items = _sequences(spark, sf_dir, "benchmark", "item_id")
    pairs = items.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("db_id"))
    return tiles.align_tiled(pairs, items, items, size=64).select("query_id", "db_id", "sw_score")


def sw_trace(spark, sf_dir):
    """The spans of the same alignments, and what they are worth letter by letter."""
    items = _sequences(spark, sf_dir, "benchmark", "item_id")
    pairs = items.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("db_id"))
    traced = trace.align_trace(pairs, items, items)
    worth = trace.rescored(traced, items, items)
    met = pairs.join(items.select(F.col("id").alias("db_id")), "db_id").join(worth, ["query_id", "db_id"], "left")
    return met.select("query_id", "db_id", F.coalesce("sw_score", F.lit(0)).alias("sw_score"))


def sw_seeded(spark, sf_dir):
    """The candidates that two seeds on a diagonal give each item among all documents, aligned. Of the twenty best
    by all alignments it finds 0.975 on sf0.01 (eight items), aligning 45 pairs of 100."""
    items, docs = _sequences(spark, sf_dir, "benchmark", "item_id"), _sequences(spark, sf_dir)
    return seeds.search_seeded(items, docs, least=60, neighbour=12)


def topk_ivf(spark, sf_dir):
    """As topk_cosine, from an index whose bounds leave out what cannot be a hit."""
    index = ivf.build_index(_vectors(spark, sf_dir))
    return _shown(ivf.search_index(index, _queries(spark, sf_dir), k=10))


def topk_pq(spark, sf_dir):
    """As topk_cosine, from a scan over codes whose bounds leave out what cannot be a hit."""
    return _shown(pq.search_pq(pq.build_pq(_vectors(spark, sf_dir)), _queries(spark, sf_dir), k=10))


def topk_pq_short(spark, sf_dir):
    """The ten nearest among the hundred rows of the best look-up scores."""
    return _shown(pq.search_pq(pq.build_pq(_vectors(spark, sf_dir)), _queries(spark, sf_dir), k=10, shortlist=100))


def _encoded(df):
    return encode.encode(df.select("id", "seq"), encode.KmerEncoder(), max_length=None, keep=("id",))


def encode_kmer(spark, sf_dir):
    """Each document's vector, as its norm and its first component."""
    out = _encoded(_sequences(spark, sf_dir))
    return out.select("id", F.size("embedding").alias("dim"), F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def sw_rerank(spark, sf_dir):
    """Embedding search of every item over all documents, the candidates then ranked by alignment."""
    items, docs = _sequences(spark, sf_dir, "benchmark", "item_id"), _sequences(spark, sf_dir)
    path = scratch(spark, "encoded")  # the search counts its rows before it reads them
    _encoded(docs).write.parquet(path)
    hits = search.search(_encoded(items), spark.read.schema("id long, embedding array<float>").parquet(path), 20)
    return _rounded(align.rerank(hits, items, docs, max_length=None), "score")


def substitution_scores(spark, sf_dir):
    """Which letters stand side by side in the items, how often, and the score of each such pair."""
    letters = _sequences(spark, sf_dir, "benchmark", "item_id").where("length(seq) > 1")
    pairs = letters.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - 1), lambda k: F.substring(F.col("seq"), k, F.lit(2)))).alias("ab"))
    counted = pairs.groupBy("ab").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.substring("ab", 1, 1), F.substring("ab", 2, 1)
    return counted.select(a.alias("a"), b.alias("b"), "n", align.substitution_score(a, b).alias("score"))


def quantise_fp16(spark, sf_dir):
    """The largest change that half precision makes to each vector's components."""
    df = _vectors(spark, sf_dir).withColumn("half", vector.quantise_fp16("embedding"))
    change = F.array_max(F.zip_with("embedding", "half", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return df.select("id", F.round(change, 9).alias("largest_change"))


_FUNCTIONS = (l2_normalize, dot_scores, cosine_scores, topk_cosine, topk_cosine_native, topk_cosine_exclude_self, topk_dot, gather_candidates, seq_clean, seq_encode, seq_pad, seq_decode, seq_filter, seq_stats, split_train_val, split_three_way, train_difference, pair_product_capped, family_relevance, annotation_relevance, recall_at_k, precision_at_k, mean_reciprocal_rank, ndcg_at_k, average_precision, mean_average_precision, retrieval_metrics, evaluate_families, evaluate_annotations, ranking_annotations, exact_match_recovery, ranking_metrics, family_dense_label, batch_collate, batch_budget, fasta_roundtrip, fasta_ranges, sw_scores, sw_pairs, sw_items, sw_tiled, sw_trace, sw_seeded, topk_ivf, topk_pq, topk_pq_short, sw_rerank, encode_kmer, substitution_scores, quantise_fp16)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


_EMB = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12 AS n FROM embeddings)"
_SCORED = f"{_EMB}, s AS (SELECT q.id AS query_id, d.id AS db_id, list_dot_product(q.v, d.v) / (q.n * d.n) AS score FROM e q, e d WHERE q.id % 50 = 0)"
_SHOW = "query_id, rank, db_id, round(score, 6) + 0.0 AS score"


def _top(k: int, where: str = "", name: str = "h") -> str:
    return f"{name} AS (SELECT query_id, db_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, db_id) AS rank FROM s {where} QUALIFY rank <= {k})"


_TEXT = "upper(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'ß', 'ss'))"
_DOCS = f"d AS (SELECT doc_id AS id, regexp_replace({_TEXT}, '[^A-Z]', '', 'g') AS seq FROM documents)"
_ALPHABET = sequence.ALPHABET
_CODES = f"c AS (SELECT doc_id AS id, list_transform(string_split(regexp_replace({_TEXT}, '[^A-Z]', 'X', 'g'), ''), lambda x: strpos('{_ALPHABET}', x) - 1) AS codes FROM documents)"
_CODE_DIGEST = "md5(array_to_string(codes, ','))"
_SPLIT = "r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)"


_WIDTHS = """u AS (SELECT *, greatest(64, (2 ** greatest(length(bin(n - 1)) - 4, 0))::BIGINT) AS unit FROM d),
w AS (SELECT id, h, (n + unit - 1) // unit * unit AS width FROM u),
r AS (SELECT id, width, greatest(16384 // width, 1) AS per, row_number() OVER (PARTITION BY width ORDER BY h, id) - 1 AS p FROM w),
b AS (SELECT width, sum(batches) OVER (ORDER BY width) - batches AS first FROM (SELECT width, max(p // per) + 1 AS batches FROM r GROUP BY width))"""
_BY_LABEL = "SELECT q.query_id, e.id AS db_id FROM q JOIN e USING (label)"
_BY_NOTE = "SELECT q.query_id, e.id AS db_id FROM q, e WHERE q.label = e.label OR q.query_id % 3 = e.id % 3"


def _metrics_sql(where: str = "WHERE query_id <> db_id", relevant: str = _BY_LABEL) -> str:
    """CTEs up to m (one row per query): hits of the 50 best, relevance by label or as given."""
    per_k = ", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) AS dcg{k}" for k in (1, 5, 10, 50))
    return f"""WITH {_SCORED}, {_top(50, where)},
    q AS (SELECT id AS query_id, label FROM e WHERE id % 50 = 0),
    rel AS ({relevant}),
    nr AS (SELECT query_id, count(*) AS nr FROM rel GROUP BY 1),
    x AS (SELECT h.query_id, rank, rel.db_id IS NOT NULL AS hit, sum(CASE WHEN rel.db_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY h.query_id ORDER BY rank) AS so_far FROM h LEFT JOIN rel ON rel.query_id = h.query_id AND rel.db_id = h.db_id),
    g AS (SELECT query_id, {per_k}, min(rank) FILTER (hit) AS first, coalesce(sum(so_far / rank) FILTER (hit), 0) AS ap_sum FROM x GROUP BY 1),
    m AS (SELECT query_id, nr, coalesce(1.0 / first, 0) AS mrr, ap_sum / nr AS ap, h1, h5, h10, h50, dcg10 / list_sum(list_transform(range(1, least(nr, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10, dcg50 / list_sum(list_transform(range(1, least(nr, 50) + 1), lambda i: 1 / log2(i + 1))) AS ndcg50 FROM q JOIN nr USING (query_id) JOIN g USING (query_id))"""


def _r(expression: str, name: str) -> str:
    return f"(round({expression}, 6) + 0.0)::DOUBLE AS {name}"


_ALL_METRICS = " UNION ALL ".join(f"SELECT '{n}' AS metric, {_r(e, 'value')} FROM m" for n, e in [*((f"{kind}@{k}", f"avg(h{k} / {by})") for k in (1, 5, 10, 50) for kind, by in (("recall", "nr"), ("precision", k))), ("mrr", "avg(mrr)"), ("map", "avg(ap)"), ("ndcg@10", "avg(ndcg10)"), ("ndcg@50", "avg(ndcg50)")])


# Alignment as the textbook has it, a row of the table at a time: t without gaps along the row, then the best of those gaps
_SW = f"""WITH RECURSIVE b AS (SELECT item_id AS id, regexp_replace({_TEXT}, '[^A-Z]', '', 'g') AS seq FROM benchmark),
m AS (SELECT '{parity().letters}' AS letters, {parity().table.ravel().tolist()} AS scores),
c AS (SELECT id, list_transform(string_split(seq, ''), lambda x: strpos(letters, x)) AS codes FROM b, m),
p AS (SELECT q.id AS query_id, d.id AS db_id, q.codes AS qc, d.codes AS dc FROM c q JOIN c d ON d.id = q.id + 1),
r AS (SELECT query_id, db_id, qc, dc, 0 AS i, list_transform(range(len(dc) + 1), lambda x: 0) AS h, list_transform(range(len(dc) + 1), lambda x: -1000000) AS e, 0 AS best FROM p
  UNION ALL SELECT query_id, db_id, qc, dc, i, h, e, greatest(best, list_max(h)) FROM (
    SELECT query_id, db_id, qc, dc, i, best, e, list_transform(t, lambda v, j: greatest(v, coalesce(list_max(list_transform(range(1, j), lambda k: t[k] - 11 - (j - 1 - k))), 0))) AS h FROM (
      SELECT query_id, db_id, qc, dc, i, best, e, list_transform(range(1, len(dc) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(0, e[j], h[j - 1] + CASE WHEN qc[i] = 0 OR dc[j - 1] = 0 THEN -4 ELSE scores[(qc[i] - 1) * 24 + dc[j - 1]] END) END) AS t FROM (
        SELECT query_id, db_id, qc, dc, i + 1 AS i, best, h, list_transform(h, lambda v, j: greatest(v - 11, e[j] - 1)) AS e FROM r WHERE i < len(qc)), m)))
SELECT query_id, db_id, best::INTEGER AS sw_score FROM r WHERE i = len(qc)"""


def oracle_sql() -> dict[str, str]:
    return {
        "l2_normalize": f"WITH {_EMB}, u AS (SELECT id, unnest(list_transform(v, lambda x: x / n)) AS value, unnest(range(len(v))) AS position FROM e) SELECT id, position, round(value, 6) + 0.0 AS value FROM u",
        "dot_scores": f"WITH {_EMB} SELECT q.id AS query_id, d.id AS db_id, round(list_dot_product(q.v, d.v), 6) + 0.0 AS score FROM e q, e d WHERE q.id % 50 = 0",
        "cosine_scores": f"WITH {_SCORED} SELECT query_id, db_id, round(score, 6) + 0.0 AS score FROM s",
        "topk_cosine": f"WITH {_SCORED}, {_top(10)} SELECT {_SHOW} FROM h",
        "topk_cosine_native": f"WITH {_SCORED}, {_top(10)} SELECT {_SHOW} FROM h",
        "topk_cosine_exclude_self": f"WITH {_SCORED}, {_top(10, 'WHERE query_id <> db_id')} SELECT {_SHOW} FROM h",
        "topk_dot": f"WITH {_EMB}, s AS (SELECT q.id AS query_id, d.id AS db_id, list_dot_product(q.v, d.v) AS score FROM e q, e d WHERE q.id % 50 = 0), {_top(100)} SELECT {_SHOW} FROM h",
        "gather_candidates": f"WITH {_SCORED}, {_top(10)}, u AS (SELECT query_id, rank, db_id, unnest(v) AS value, unnest(range(len(v))) AS position FROM h JOIN e ON e.id = h.db_id) SELECT query_id, rank, db_id, position, round(value, 6) + 0.0 AS value FROM u",
        "seq_clean": f"WITH {_DOCS} SELECT id, length(seq)::BIGINT AS n, md5(seq) AS digest FROM d",
        "seq_encode": f"WITH {_CODES} SELECT id, len(codes)::BIGINT AS n, {_CODE_DIGEST} AS digest FROM c",
        "seq_pad": f"WITH {_CODES}, p AS (SELECT id, list_concat(codes[1:1024], list_transform(range(greatest(0, 1024 - len(codes))), lambda i: 20)) AS codes FROM c) SELECT id, len(codes)::BIGINT AS n, {_CODE_DIGEST} AS digest FROM p",
        "seq_decode": f"SELECT doc_id AS id, md5(regexp_replace({_TEXT}, '[^A-Z]', 'X', 'g')) AS digest FROM documents",
        "seq_filter": f"WITH {_DOCS} SELECT id, length(seq)::BIGINT AS n FROM d WHERE length(seq) BETWEEN 100 AND 1000",
        "seq_stats": f"WITH {_DOCS} SELECT count(*) AS count, min(length(seq))::BIGINT AS min_len, max(length(seq))::BIGINT AS max_len, round(avg(length(seq)), 6) + 0.0 AS mean_len, sum(length(seq))::BIGINT AS total_residues FROM d",
        "split_train_val": f"WITH {_SPLIT} SELECT id, CASE WHEN p < floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r",
        "split_three_way": f"WITH {_SPLIT} SELECT id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' WHEN p < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r",
        "train_difference": f"WITH {_SPLIT} SELECT id FROM r WHERE p >= floor(n * 0.1::DOUBLE)",
        "pair_product_capped": f"WITH {_DOCS}, b AS (SELECT item_id AS id, regexp_replace({_TEXT}, '[^A-Z]', '', 'g') AS seq FROM benchmark) SELECT b.id AS i, d.id AS j, b.id AS query_id, d.id AS db_id, length(b.seq)::BIGINT AS query_len, length(d.seq)::BIGINT AS db_len FROM b, d WHERE b.seq <> '' AND d.seq <> '' ORDER BY i, j LIMIT 5000",
        "family_relevance": f"WITH {_EMB} SELECT q.id AS query_id, d.id AS db_id FROM e q JOIN e d USING (label) WHERE q.id % 50 = 0",
        "annotation_relevance": "WITH a AS (SELECT doc_id AS id, ['lang:' || lang, 'source:' || source] AS notes FROM documents) SELECT q.id AS query_id, d.id AS db_id FROM a q, a d WHERE q.id % 50 = 0 AND list_has_any(q.notes, d.notes)",
        "recall_at_k": f"{_metrics_sql()} SELECT {_r('avg(h10 / nr)', 'recall')} FROM m",
        "precision_at_k": f'{_metrics_sql()} SELECT {_r("avg(h10 / 10)", chr(34) + "precision" + chr(34))} FROM m',
        "mean_reciprocal_rank": f"{_metrics_sql()} SELECT {_r('avg(mrr)', 'mrr')} FROM m",
        "ndcg_at_k": f"{_metrics_sql()} SELECT {_r('avg(ndcg10)', 'ndcg')} FROM m",
        "average_precision": f"{_metrics_sql()} SELECT query_id, {_r('ap', 'ap')} FROM m",
        "mean_average_precision": f'{_metrics_sql()} SELECT {_r("avg(ap)", chr(34) + "map" + chr(34))} FROM m',
        "retrieval_metrics": f"{_metrics_sql()} {_ALL_METRICS}",
        "evaluate_families": f"{_metrics_sql('')} {_ALL_METRICS}",
        "evaluate_annotations": f"{_metrics_sql('', _BY_NOTE)} {_ALL_METRICS}",
        "ranking_annotations": f"{_metrics_sql('', _BY_NOTE)} SELECT 'annotation' AS task, metric, value FROM ({_ALL_METRICS})",
        "sw_items": _SW,
        "sw_tiled": _SW,
        "sw_trace": _SW,
        "topk_pq": f"WITH {_SCORED}, {_top(10)} SELECT {_SHOW} FROM h",
        "topk_ivf": f"WITH {_SCORED}, {_top(10)} SELECT {_SHOW} FROM h",
        "substitution_scores": f"WITH s AS (SELECT '{parity().letters}' AS letters, {parity().table.ravel().tolist()} AS scores), i AS (SELECT regexp_replace({_TEXT}, '[^A-Z]', '', 'g') AS seq FROM benchmark), p AS (SELECT seq[k] AS a, seq[k + 1] AS b FROM (SELECT seq, unnest(range(1, length(seq))) AS k FROM i)), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL) SELECT a, b, n, (CASE WHEN strpos(letters, a) = 0 OR strpos(letters, b) = 0 THEN -4 ELSE scores[(strpos(letters, a) - 1) * 24 + strpos(letters, b)] END)::INTEGER AS score FROM c, s",
        "ranking_metrics": f"{_metrics_sql('')} SELECT 'family' AS task, metric, value FROM ({_ALL_METRICS}) UNION ALL SELECT 'exact_match', 'exact_match', {_r('avg(CASE WHEN q.label = e.label THEN 1.0 ELSE 0.0 END)', 'value')} FROM q JOIN h ON h.query_id = q.query_id AND h.rank = 1 JOIN e ON e.id = h.db_id",
        "exact_match_recovery": f"WITH {_SCORED}, {_top(1, 'WHERE query_id <> db_id')} SELECT {_r('avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END)', 'exact_match')} FROM h JOIN e a ON a.id = h.query_id JOIN e b ON b.id = h.db_id",
        "family_dense_label": "SELECT doc_id AS id, source AS family, dense_rank() OVER (ORDER BY source) - 1 AS label FROM documents",
        "batch_collate": "WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) SELECT p // 32 AS batch, count(*) AS n, string_agg(doc_id || ':' || lang, ',' ORDER BY p) AS items FROM r GROUP BY 1",
        "batch_budget": f"WITH d AS (SELECT doc_id AS id, greatest(coalesce(length(text), 0), 1) AS n, md5(concat('42:', doc_id)) AS h FROM documents), {_WIDTHS} SELECT id, (first + p // per)::BIGINT AS batch, (p % per)::BIGINT AS slot, width::BIGINT AS width FROM r JOIN b USING (width)",
        "fasta_ranges": f"WITH {_DOCS} SELECT id, length(seq)::BIGINT AS n, md5(seq) AS digest FROM d",
        "fasta_roundtrip": f"WITH {_DOCS} SELECT id, length(seq)::BIGINT AS n, md5(seq) AS digest FROM d",
    }
