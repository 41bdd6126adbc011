"""A corpus pipeline of five of the training-data operators; each stage works on all that the one before it kept.

1. language_id: documents whose language cannot be told (no letters, or no text) go.
2. near_duplicates: of each group of documents that links of a similarity of 0.8 over five-word shingles make, the one
   with the smallest id stays.
3. pii: personal data and secrets are replaced by surrogates, and ``n_chars`` follows the new text.
4. mixing: documents are repeated or left out until each source comes to its target weight.
5. packing: bins of 2,048 words, without equal texts or two documents of a source in a bin. This is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlattice.llm import jaccard, langid, mixing, packing, pii
from spotlattice.llm.queries import SURROGATE_KEY
from spotlattice.llm.util import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train_model(docs)
    return langid.identify(docs, model, pred="__pred", score="__score").where(F.col("__pred") != langid.UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, width=5, num=4, den=5)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, secret=SURROGATE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pii", replace_pii),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The stages' models and searches are beyond SQL. tests/llm hold near duplicates and packing against brute force, surrogates
#: against made-up texts, mixing against its SQL as a query, and the language stage against labels it has not seen.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
