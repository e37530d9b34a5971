"""A corpus pipeline: language ID, exact and near deduplication, mixing of sources, packing.

Each stage takes what its predecessor kept, written as Parquet and reread; all but the last return the columns of
``documents``, and further columns as they are.  A stage's own tables stay until a later stage starts on rows that were
written since, and are deleted then.  Null texts are empty; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.llm import exact_dedup, language_id, mixing, near_dedup, packing, registry
from lodgelens.session import StoredTables, configure

NEAR = (80, 100)  # similarity of word shingles from which the near_dedup stage drops copies

_open: list[StoredTables] = []  # tables that a stage's output, not yet written, may read


def _store(spark: SparkSession, docs: DataFrame, name: str) -> StoredTables:
    """Tables for a stage.  Those of earlier stages of this session that ``docs`` does not read are deleted."""
    for store in list(_open):
        if store.spark is not spark:
            _open.remove(store)
        elif not store.read_by(docs):
            store.clear()
            _open.remove(store)
    _open.append(StoredTables(spark, name))
    return _open[-1]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; profiles are learned from the labelled ones.

    A text that is null or has no letter goes.  Repeated rows are judged each.
    """
    configure(spark)
    marked = language_id.predict_language(
        docs.select(F.struct("*").alias("doc"), "text"), language_id.learn_prototypes(docs), carry=["doc"]
    )
    kept = marked.where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.select(*[F.col("doc").getField(name).alias(name) for name in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the kind and number of blanks, the one with the smallest id stays.

    Rows that repeat its id and text stay with it; null ids rank last.
    """
    configure(spark)
    return exact_dedup.drop_copies(docs, _store(spark, docs, "pipeline-exact"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of ``NEAR`` or more, the one with the smallest id stays.

    Texts without words are linked with nothing and stay; rows with a null id stay.
    """
    configure(spark)
    return near_dedup.keep_one_of_each(docs, _store(spark, docs, "pipeline-near"), similarity=NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document taken twice is there twice, one not taken is not there.  Null sources are one source."""
    configure(spark)
    _store(spark, docs, "pipeline-mixing")
    return mixing.take_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of bounded length; a document taken twice is packed twice."""
    configure(spark)
    _store(spark, docs, "pipeline-packing")
    return packing.pack_documents(docs, registry.tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]
# Language profiles, the rounding of the mix and the packing have no SQL form; tests/llm holds the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored as Parquet in the shared folder and read by the next."""
    store = StoredTables(spark, "pipeline")
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
        store.drop(*read)
        read = [name]
    return docs
