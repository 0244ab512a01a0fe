"""A training-data pipeline over the documents table, stage by stage.

Each stage works on all that the one before kept, and is written and read again between
them.  The order: texts of no known language go, one document of each group of near
copies stays, documents that share a passage with the benchmark go, credentials are
replaced, and the rest is packed into windows of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm import common, decontamination, language, packing, secrets, simhash

#: A text that no learned language codes in fewer bits than its bytes have is in no known
#: language; the fewer bytes there are to tell by, the more bits are let pass: twice as
#: many for ``SHORT_BYTES``, a margin that falls with the square of the length.
BITS_OF_A_BYTE = 8.0
SHORT_BYTES = 16


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those without a letter and those that no language explains.

    A null text or an empty one has no letter and goes; long texts are judged whole; rows
    without an id stay if their text does; repeated rows are judged alike; an empty table
    gives an empty one; columns of any other name stay as they are."""
    judged = language.identify(docs, keep=True)
    limit = BITS_OF_A_BYTE * (1 + F.pow(SHORT_BYTES / F.octet_length("row.text"), 2))
    noise = F.col("bits_per_byte") >= limit
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & ~F.coalesce(noise, F.lit(False))).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose 5-word shingles are alike to 0.8 or more, that
    of the smallest doc_id; a null doc_id counts as the largest.

    Texts without a word, null ones too, are one group; a text of fewer words is one
    shingle; of rows that repeat id and text one stays; an empty table gives an empty one;
    columns of any other name stay as they are."""
    return simhash.keep_first(docs, shingle=5, similarity=(4, 5))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    Null and empty texts have no words and stay; long texts are searched whole; repeated
    rows are judged alike; without documents or items nothing goes; columns of any other
    name stay as they are."""
    return decontamination.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their credentials replaced by a mark.

    Rows without a credential, null texts too, come back as they are; n_chars follows a text
    that changes; long texts are scanned whole; repeated rows are treated alike; an empty
    table gives an empty one; columns of any other name stay as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of tokens.

    A null or empty text is its end id alone; long texts span windows; repeated rows are
    documents of their own; an empty table gives no piece; other columns are left out."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark", uncontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
