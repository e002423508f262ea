"""Queries of this subpackage's operators over their whole tables, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plinth.llm import bpe, chat, langid, merkle, ngramjoin, packing, pii, suffixdedup, topk, urlfilter
from plinth.llm.shared import PATTERN, table

def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; a parameter of each operator that needs one."""
    return public_tokenizers.path(name)


def _over(name: str, f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(table(spark, sf_dir, name))

    return run


def queries() -> dict:
    return {
        "op1_suffix_array_dedup": _over("documents", suffixdedup.query),
        "op2_pii": _over("documents", pii.query),
        "op3_chat_formatting": _over("conversations", chat.query),
        "op4_exact_top_k": _over("embeddings", topk.query),
        "op5_ngram_jaccard_join": _over("documents", ngramjoin.query),
        "op6_packing": _over("documents", lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json"), PATTERN)),
        "op7_url_filters": _over("pages", urlfilter.query),
        "op8_document_fingerprints": _over("documents", merkle.query),
        "op9_language_id": _over("documents", lambda d: langid.query(d, vocabulary("piece_bpe_32k.model"))),
        "op10_byte_bpe": _over("documents", lambda d: bpe.query(d, vocabulary("byte_bpe_50k.tiktoken"), PATTERN)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": chat.ORACLE, "op4_exact_top_k": topk.ORACLE}
