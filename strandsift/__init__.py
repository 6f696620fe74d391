"""Similarity search over sequences and embeddings on Spark, and operators for training data.

The public names of the search engine; the training-data operators live in their own subpackage."""

from strandsift.functions.sequence import clean, decode, encode
from strandsift.functions.vector import cosine, dot, l2_normalize, quantise_fp16
from strandsift.operators.align import align_all, align_listed, align_pairs, rerank
from strandsift.operators.encode import encode_fasta, encode_single, load_encoder, model_info
from strandsift.operators.metrics import annotation_relevance, average_precision, evaluate_annotations, evaluate_families, exact_match_recovery, family_relevance, mean_average_precision, mean_reciprocal_rank, ndcg_at_k, precision_at_k, ranking_metrics, recall_at_k, retrieval_metrics
from strandsift.operators.pq import build_pq, search_pq
from strandsift.operators.search import cosine_scores, dot_scores, gather, search, top_k
from strandsift.operators.split import batches, dense_label, pair_product, three_way_split, train_val_split
from strandsift.sources.fasta import family_dataset, fasta_stats, filter_fasta, load_sequences, read_fasta, sequence_dataset, split_fasta, write_fasta
from strandsift.sources.files import format_metrics, load_embeddings, load_metrics, save_embeddings, save_metrics
from strandsift.sources.ranges import FastaSource, read_ranges, stream_ranges

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("functions", "operators", "sources")]
