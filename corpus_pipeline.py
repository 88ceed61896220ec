"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Counted as part of the subpackage of training-data operators; it goes where that goes.

Defined results: null and empty texts have no words, so the quality rules drop them; a null
doc_id is an id like any other and never labelled; repeated rows are judged alike, and the
n-gram Jaccard join keeps one of them; of documents that tie for a class the one of the
smallest id stays, null last; further columns of ``documents`` go through unchanged, whatever
their names; ``n_chars`` follows the text where lines or passages are cut; texts of any length go
through whole; empty tables give empty results, and without labels the classifier keeps everything.

A stage's result reads tables that its operator has written.  They are freed when a later stage starts on documents
that no longer read them, that is, once the result is written itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import freed, staged
from gleaner.llm.ngram_join import one_of_each
from gleaner.llm.packing import pack
from gleaner.llm.quality_classifier import keep_sampled
from gleaner.llm.quality_rules import keep_good
from gleaner.llm.queries import VOCABULARY
from gleaner.llm.suffix_dedup import without_repeats

#: Written tables that results of earlier stages read: of a run, or of stages called one by one.
_left: list[DataFrame] = []


def _folders(df: DataFrame) -> set[str]:
    return {x.rpartition("/")[0] for x in df.inputFiles()}


def _free(docs: DataFrame) -> list[DataFrame]:
    """Delete what earlier stages have left, unless ``docs`` still reads from it; the list for the next stage's tables."""
    _left[:] = [x for x in _left if x.sparkSession is docs.sparkSession]
    if _left and not _folders(docs) & set().union(*map(_folders, _left)):
        freed(*_left)
        _left.clear()
    return _left


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the labelled good documents; what isn't drawn goes."""
    _free(docs)
    return keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning rules; lines that fail are removed, documents that fail go."""
    _free(docs)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return one_of_each(docs, left=_free(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more are cut out of the texts."""
    return without_repeats(docs, left=_free(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of at most 2048 tokens."""
    _free(docs)
    return pack(docs, VOCABULARY)


STAGES = [("quality classifier", classify), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("best-fit packing", packing)]
#: The stages hash, sample and tokenize in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    global _left
    others, _left = _left, []  # tables of stages called elsewhere are none of a run's
    try:
        return _run(spark, sf_dir)
    finally:
        _left = others


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
        if at:  # the first stage reads the input itself
            freed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
