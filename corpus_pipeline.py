"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and judges the rows that it is given; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table, written
from palimpsest.llm.decontaminate import clean
from palimpsest.llm.language_id import languages, train
from palimpsest.llm.line_dedup import apply_keep
from palimpsest.llm.near_dedup import near_duplicates
from palimpsest.llm.piece_encoding import piece_ids

#: How certain a document's windows must be, on average, of some language of the labels. Of 10000 labelled rows of sf0.1 the least certain, of
#: one word, has 0.32, so that none goes.
LEAST = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language, learnt from the labels of docs. Null texts and texts without a letter go; if no row has a
    label there is nothing to judge by, and only those go. A text in several of the languages stays: each window counts by its own."""
    net = train(docs)
    found = languages(docs, net, keep=True, names=("__pal_lang", "__pal_score", "__pal_certain"))
    if net is None:
        return docs.filter(F.coalesce("text", F.lit("")).rlike("\\p{L}"))
    return found.filter((F.col("__pal_lang") != "und") & (F.col("__pal_certain") >= LEAST)).drop("__pal_lang", "__pal_score", "__pal_certain")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each text less the lines that an earlier document has; n_chars follows the text where docs has it."""
    kept = apply_keep(docs, names=("__pal_lines", "__pal_lost"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__pal_lost") > 0, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return kept.select([f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of smallest id; repeated rows of it all stay, as do null ids."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__pal_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__pal_id")), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digest, and the digest of what they decode to."""
    return piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("piece_encoding", piece_encoding)]

#: A trained classifier and a tokenizer are not SQL: tests/llm/test_queries.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if k + 1 < len(STAGES) else docs
    return docs
