"""The corpus queries of the driver and their SQL."""

from __future__ import annotations

from . import bpe, dart_minhash, divergence, euclidean_lsh, histogram_shards, html_crf, language_id, mixing, token_counts, url_rules
from .common import table
from .oracles import ORACLES  # noqa: F401

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_divergence(spark, sf_dir):
    return divergence.judge(table(spark, sf_dir, "documents"))


def op2_euclidean_lsh(spark, sf_dir):
    return euclidean_lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op5_dart_minhash(spark, sf_dir):
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_crf(spark, sf_dir):
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_histogram_shards(spark, sf_dir):
    return histogram_shards.shard(table(spark, sf_dir, "documents")).drop("key")


QUERIES = {f.__name__: f for f in (op1_divergence, op2_euclidean_lsh, op3_language_id, op4_url_rules, op5_dart_minhash, op6_html_crf, op7_mixing, op8_token_counts, op9_byte_bpe, op10_histogram_shards)}
