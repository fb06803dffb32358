"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows to the shared folder and
hands them to the next. All but the last return the columns of ``documents``.

Defined results for odd input, stage by stage; in all of them an empty table stays empty, texts of any length are read
whole, and other columns are handed on as they are:

- language_id: null texts and texts without a letter go; without labelled rows to learn from, all go; repeated rows are
  judged alike. ``lang``, ``source`` and ``doc_id`` may be null.
- near_duplicates: of a group, the row of least (doc_id, hash of the text) stays, a null doc_id first; of equal rows one
  stays; rows without a word are no duplicates and stay all.
- decontaminate: null texts leak nothing; null and wordless items match nothing; repeated rows are judged alike.
- redact_secrets: null texts stay null with their n_chars; where n_chars is null it is counted.
- mix_sources: a null source is a source of its own; null texts have no words and aren't taken; of rows equal in id, source
  and text as many are taken as the target asks for; columns named size or taken give way to those of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import op2_secrets, op3_language, op4_mix, op6_join, op10_decontaminate
from treeline.session import release, written

#: Texts of a score under this are rejected, like those without a letter. It binds from six languages on; with fewer, texts
#: are rejected for having too few n-grams of their language, by a threshold learnt from labelled texts.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a known language; learns from the labelled part of its own input."""
    return op3_language.accepted(docs, op3_language.train(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 on five-word shingles."""
    return op6_join.one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item."""
    return op10_decontaminate.clean(docs, op10_decontaminate.train(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark, and counts n_chars anew."""
    out = op2_secrets.redacted(docs, op2_secrets.train(docs))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix takes of each source; ``taken`` over ``size`` is how often a document is to be read."""
    return op4_mix.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]

#: Three stages learn models or compare texts in ways that SQL can't express; a test holds each stage against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        done, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
