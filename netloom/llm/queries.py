"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import contexttree, decontaminate, exactdedup, htmltext, langid, linededup, ngramjoin, pieces, pii, secrets
from .common import documents


def op1_ngram_jaccard(spark, sf_dir):
    return ngramjoin.jaccard_join(documents(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    return langid.language_digest(documents(spark, sf_dir))


def op3_private_data(spark, sf_dir):
    return pii.private_digest(documents(spark, sf_dir))


def op4_decontamination(spark, sf_dir):
    return decontaminate.leaks_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.pieces_digest(documents(spark, sf_dir))


def op6_secret_scan(spark, sf_dir):
    return secrets.secrets_digest(documents(spark, sf_dir))


def op7_line_dedup(spark, sf_dir):
    return linededup.lines_digest(documents(spark, sf_dir))


def op8_exact_dedup(spark, sf_dir):
    return exactdedup.exact_groups(documents(spark, sf_dir))


def op9_main_text(spark, sf_dir):
    return htmltext.pages_digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_context_tree(spark, sf_dir):
    return contexttree.scored(documents(spark, sf_dir))


QUERIES = {k: f for k, f in globals().items() if k.startswith("op")}
ORACLES = {"op7_line_dedup": linededup.ORACLE, "op8_exact_dedup": exactdedup.ORACLE}
