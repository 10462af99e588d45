"""The document pipeline: toxicity filter, near-duplicate removal, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet
in the shared folder and hands the table on. All but the last stage return the columns of ``documents``.

Defined cases, by stage: null texts score as empty ones; documents without words are one group of copies, of
which one stays; a document of which nothing is left after the passages are cut goes, an empty one stays; a
null source is a source of its own; documents without words have a row with null bin; extra columns are
kept up to the last stage; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linelens.llm import mix, near_copies, packing, repeats, toxicity
from linelens.llm.common import table
from linelens.session import materialize

#: Bytes of the shortest passage that is cut. Passages of over 50 words go: in running text even short words take
#: four bytes with their blank, so such a passage has this many bytes at least.
PASSAGE_BYTES = 200


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, into="_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages."""
    return repeats.without_repeats(docs, PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mix.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their training sequences (shard, bin)."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("near_copies", keep_one_copy),
    ("repeated_passages", cut_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores, signatures and best fit have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
