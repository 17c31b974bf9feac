"""Queries of this subpackage, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwood.functions.workers import spread

from . import ball_tree, url_rules, warc
from .shared import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """Where the public vocabularies are; their folder can be set by an environment variable."""
    import os

    folder = os.environ.get("KELPWOOD_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, page_responses

    return derivatives(page_responses(spread(table(spark, sf_dir, "pages")))).withColumnRenamed("source_id", "page_id")


def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    scored = quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return scored.select("doc_id", "host", "path", "evidence", "site_prior", "quality_score", F.col("accepted").cast("int").alias("predicted"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls, query_rules

    return judge_urls(spread(table(spark, sf_dir, "pages")).select("page_id", "url"), query_rules()).drop("url")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg_audio import text_media

    return text_media(documents(spark, sf_dir))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op6_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_pieces import encode_pieces

    return encode_pieces(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), check_every=50)


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import held_out
    from .toxicity import toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify
    from .sampling import held_out

    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_tree import ranked_search

    return ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pair_bitmaps import align_tokenizers

    return align_tokenizers(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff_automaton import lm_scores

    return lm_scores(documents(spark, sf_dir))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_quality_bayes": op2_quality_bayes,
    "op3_url_rules": op3_url_rules,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_sentencepiece_bpe": op6_sentencepiece_bpe,
    "op7_toxicity_ftrl": op7_toxicity_ftrl,
    "op8_language_bloom": op8_language_bloom,
    "op9_bestfit_pack": op9_bestfit_pack,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ball_tree_search": op11_ball_tree_search,
    "op12_pair_bitmaps": op12_pair_bitmaps,
    "op13_backoff_automaton": op13_backoff_automaton,
}

SQL = {
    "op1_warc_derivatives": warc.oracle(),
    "op3_url_rules": url_rules.oracle(),
    "op10_exact_dedup": OP10_SQL,
    "op11_ball_tree_search": ball_tree.SQL,
}
