"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, language, mixing, simhash, token_files
from tabloom.llm import queries as Q
from tabloom.llm.common import stored

#: A language is accepted from this cosine on, and from the lower one in texts of fewer characters than SHORT_TEXT.
#: Measured: 15,800 clean texts of 50 characters or more (check_s) score 0.151 or more, the least being one word repeated,
#: and shorter ones 0.08 or more but for 1 in 160. Letters of unlearned alphabets stay below 0.10 in 99 of 100 texts of
#: any length, random Latin letters below 0.125, and below 0.152 in texts of 3,000 characters.
MIN_LANGUAGE_SCORE, MIN_SHORT_SCORE, SHORT_TEXT = 0.14, 0.07, 50
#: Texts whose five-word shingles are this similar are copies of each other.
SHINGLE, SIMILARITY = 5, 0.8
#: Share of all words that the mixture takes. Every document is taken at most once.
FRACTION, EPOCHS = 0.9, 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has letters and resembles a learned language."""
    found = language.predict(docs, Q.language_profiles(docs))
    least = F.when(F.length("row.text") < SHORT_TEXT, MIN_SHORT_SCORE).otherwise(MIN_LANGUAGE_SCORE)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of equal or similar texts."""
    return simhash.keep_one(docs, size=SHINGLE, similarity=SIMILARITY)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark item occurs within its edit budget."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.find_leaks(docs, benchmark).where(F.size("leaks") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents up to the budgets of their domain, language and source."""
    tokens, domain = mixing.word_count(F.col("text")), Q.source_domain(F.col("source"))
    return mixing.mix(docs, tokens, domain, Q.MIX_WEIGHTS, FRACTION, EPOCHS, Q.MIX_SEED).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return what reading them back gives per document."""
    import public_tokenizers

    return token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path(Q.TOKENIZER), Q.END_ID))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixture", mix_sources),
    ("token_files", write_tokens),
]

#: Fingerprints, trained profiles and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
