"""From raw documents to token files: toxicity, near-duplicates, benchmark
decontamination, source mixing, token ids.

Each stage gets the rows its predecessor kept, with the columns of documents,
and its decisions are final: toxic rows go, one row of each group of near
duplicates stays, rows that overlap the benchmark go, rows are taken as often as
the mix says, and the last stage writes what is left as token files and returns
doc_id, start, n_tokens and ids_crc32, read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.common import table
from verdigris.llm.decontaminate import decontaminate
from verdigris.llm.mixing import mix
from verdigris.llm.neardup import deduplicate
from verdigris.llm.token_files import token_files
from verdigris.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows predicted toxic; the classifier learns from labels of the rows it gets.

    Null and empty texts hold no feature and stay unless the classifier's bias
    alone says toxic; null ids are never training rows; rows are judged one by one; without labels, and
    with an empty table, no row goes. Other columns, whatever their names, pass through."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the least id, nulls
    last, ties by hashes of the text and the row. Null and empty texts all stay; an
    empty table stays empty; other columns pass through."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that overlap a benchmark item, judged by text, so null and repeated
    ids do not matter. Null and empty texts stay; an empty table stays empty, with an
    empty benchmark all rows stay; other columns pass through."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its source's target asks for. A null source is one of
    its own; rows without words stay once; of equal rows as many are taken as the
    budget asks for; an empty table stays empty; other columns pass through."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in ascending order of doc_id, nulls last, and reads them back.
    A null or empty text has the end id alone; repeated rows follow one another; an
    empty table writes no record; other columns are left out."""
    return token_files(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages rows are written to the shared
    folder, so a lost executor costs one stage at most."""
    from verdigris.llm.common import cut

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
