"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from . import blocks, decontaminate, jaccard, langid, lexical, licenses, mixing, parsing, periodic, quality, simhash, topk, toxicity
from .shared import documents


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.components(documents(spark, sf_dir))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir), across_lines=True)


def op4_license_text(spark, sf_dir):
    """op4_license_scan under the name it had when that one kept to lines."""
    return op4_license_scan(spark, sf_dir)


def op4_license_lines(spark, sf_dir):
    """Blocks that end at each line: templates wrapped over lines are missed."""
    return licenses.scan(documents(spark, sf_dir))


def op5_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op6_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op7_quality(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_block_dedup(spark, sf_dir):
    return blocks.remove_repeats(documents(spark, sf_dir))


def op9_parse_dedup(spark, sf_dir):
    return parsing.remove_repeats(documents(spark, sf_dir))


def op10_exact_top_k(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(documents(spark, sf_dir))))


def op12_simhash(spark, sf_dir):
    return simhash.components(documents(spark, sf_dir))


def op13_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), benchmark(spark, sf_dir)).select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_mix_sources, op4_license_scan, op5_language_id, op6_benchmark_decontamination, op7_quality, op8_block_dedup, op9_parse_dedup, op10_exact_top_k, op11_periodic_runs, op12_simhash, op13_lexical_search, op4_license_text, op4_license_lines)}
ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op4_license_scan": licenses.ORACLE_TEXT,
    "op4_license_text": licenses.ORACLE_TEXT,
    "op4_license_lines": licenses.ORACLE,
    "op8_block_dedup": blocks.ORACLE,
    "op9_parse_dedup": parsing.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
