"""A corpus pipeline of five stages, each the operator of the same name over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet in the shared folder and reads it back for the next one.

In all stages null text counts as empty, rows are judged one by one where their ids are null, an empty table gives an empty
one, and columns other than those of ``documents`` are left out of the result. What else holds is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.llm import decontaminate, fm_quality, line_dedup, packing, partenum
from utilmine.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    if changed:
        docs = docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine takes for good text (score of 0.5 or more); it learns from the whole documents table's labels.

    Rows that share an id are each scored by their own text.
    """
    model = fm_quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _documents(fm_quality.score(docs, model, out_col="__score").where("__score >= 0.5"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier line within two edits or a tenth of the words, short ones if equal; documents of which only white space is left go.

    Rows that share an id are ordered by their texts' digests; rows repeated in full are one document here and stay or go together (their lines go
    where an earlier document has them). Rows with a null id keep their lines. Documents that were blank before, or null, stay.
    """
    kept = line_dedup.drop_repeated_lines(docs, edits=2, min_chars=20, report=True, per_words=10, exact_chars=1)
    return _documents(kept.where((F.col("n_gone") == 0) | ~line_dedup.blank("text")), changed=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8), the one with the smallest id.

    Rows that share an id are linked with each other and stay or go together; rows with a null id and texts without words stay.
    """
    return _documents(partenum.keep_first(docs, k=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of ten or more words of benchmark items; documents that are hardly more than that go.

    Every row is judged by itself, whatever its id.
    """
    return _documents(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.8), changed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece. Rows repeated in full are packed once per row; null text is the end token alone."""
    return packing.pack(docs, capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Not expressible in SQL: a trained classifier and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
