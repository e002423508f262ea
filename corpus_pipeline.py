"""A corpus pipeline over `documents`: language ID, near-duplicate join, suffix-array dedup, PII, packing.

Each stage takes what its predecessor kept, whole, and writes its decisions into the rows; all but the last return the
columns of documents. run() applies them one after the other, each written to the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import langid, ngramjoin, packing, pii, suffixdedup
from plinth.llm.registry import PATTERN, vocabulary
from plinth.llm.shared import table, written


#: Passages that repeat: matched by PASSAGE_BYTES (with anchors of so many), cut out from PASSAGE_WORDS on (parts of words at the ends count).
PASSAGE_BYTES, PASSAGE_ANCHOR, PASSAGE_WORDS = 200, 24, 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of a doubtful one, go.

    Null and empty texts and texts without a letter go. Without a labelled row nothing is known and all go. Repeated rows are judged
    each, alike; of languages that score alike the first by name counts. An empty table gives no rows; other columns stay, whatever their names.
    """
    return langid.accepted(docs, vocabulary("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, 0.8) stays: that of the least doc_id, nulls last; of equal ids the least row name.

    Of repeated rows one stays. Null and empty texts, and texts of white space, have no copies and all stay. An empty table gives no
    rows; other columns stay, whatever their names.
    """
    return ngramjoin.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (and of PASSAGE_BYTES or more) that occur again are cut out of every text; n_chars follows.

    All documents stay. Null texts stay null, empty and short ones as they are. Repeated rows repeat each other. An empty table gives
    no rows; other columns stay, whatever their names.
    """
    return suffixdedup.cut_out(docs, length=PASSAGE_BYTES, k=PASSAGE_ANCHOR, least_words=PASSAGE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that give it away are masked; n_chars follows.

    All documents stay. Null and empty texts stay as they are. Repeated rows are documents each. An empty table gives no rows; other columns
    stay, whatever their names.
    """
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 1024 tokens.

    Null and empty texts hold the end id alone. Repeated rows are packed each; ties go by doc_id, then checksum. An empty table gives no rows;
    columns other than doc_id and text are left behind.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), PATTERN)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("pii", personal_data), ("packing", packed)]
#: Language models, MinHash and packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
