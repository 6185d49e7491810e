"""A corpus pipeline: each stage gets what the one before has stored as Parquet.

All stages but the last return the columns of documents. Toxic and contaminated documents go, one document of
each group of near-duplicates stays (the smallest doc_id), passages that occurred earlier are cut out of the
later documents, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import decontamination, jaccard, packing, simhash, suffixes, toxicity
from revlens.llm.queries import Entry, table, tokenizer
from revlens.session import written


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, toxicity.label_columns(table(spark, sf_dir, "labels"))))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash's groups, as op8 finds them, joined by the near pairs that its three bits miss."""
    return jaccard.one_of_each(docs, radius=simhash.RADIUS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("toxicity", keep_clean),
    ("simhash", keep_one_of_each),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashes of shingles and tokenizers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
ENTRIES = {"pipeline": Entry(run, ORACLE_SQL)}
