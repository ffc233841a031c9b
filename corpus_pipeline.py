"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.  Null or empty
texts have no language and go in the second stage; rows without doc_id are
scored like any other, and of a group of near copies they stay only where no
member has an id.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundline.llm import bayes_language, curve_packing, ordinal_quality, shingle_join, substring_dedup
from roundline.llm.common import scratch, table, written

#: words of a passage that must not occur twice
REPEATED_WORDS = 35
#: least posterior of a document's language, and least mean log-probability of its n-grams less
#: the language's own: given texts have -3 or more, random letters and unknown scripts about -8
LEAST_SCORE, LEAST_TYPICAL = 0.5, -5.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are probably of the top grade."""
    model = ordinal_quality.train(docs, ordinal_quality.graded(table(spark, sf_dir, "labels")))
    return ordinal_quality.assess(docs, model, at_least=2).where("accepted").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of the learned, with some certainty,
    and whose n-grams are not foreign to it (random letters, unlearned scripts)."""
    found = bayes_language.identify(docs.select("*", F.col("text").alias("__text")), bayes_language.train(docs), "__text")
    kept = found.where((F.col("lang_pred") != bayes_language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE) & (F.col("typical") >= LEAST_TYPICAL))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of smallest id:
    five-word shingles, Jaccard 0.8 or more."""
    return shingle_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur elsewhere; documents of which nothing is left go."""
    cut = substring_dedup.cleaned(docs, REPEATED_WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.where("n_words = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces with their ids (unsigned 32-bit, little-endian)."""
    import public_tokenizers

    pieces = curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality),
    ("language identification", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packing),
]

#: SQL cannot fit the models; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{i}")
    return docs
