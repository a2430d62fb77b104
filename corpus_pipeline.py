"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import jaccard_join, mixing, packing, pii, toxicity
from cellweft.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled ones of this input, does not reject.

    Null and empty texts get the score of a text without words. Equal texts get
    equal scores, so repeats stay or go together. Without labelled rows, or on an empty
    table, nothing is rejected. Other columns, whatever their names, stay.
    """
    weights = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, weights, into="_cw_score").where("_cw_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more: that with the smallest doc_id.

    Of rows of that doc_id in one group the one with the smallest text stays, and of equal
    ones the first; a row of the same doc_id in no group, or in another one, is judged by itself. Null doc_id: larger
    than all others. Texts without words (null, empty) are in no group and all stay, repeats included. A
    group's candidates are met by hash of their rows, one small row each. Empty table:
    empty. Other columns, whatever their names, stay.
    """
    numbered = materialize(docs.withColumn("_cw_row", F.monotonically_increasing_id()), "numbered")
    text = F.coalesce("text", F.lit(""))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(text).alias("hash"), "_cw_row")
    # the join works on row numbers, so that each row has a group of its own, whatever its doc_id
    rows = jaccard_join.jaccard_join(numbered.select(F.col("_cw_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_cw_row"), F.col("component_id").alias("_cw_group"))
    first = numbered.select("_cw_row", order.alias("_cw_order")).join(rows, "_cw_row").groupBy("_cw_group").agg(F.min("_cw_order").alias("first"))
    kept = first.select(F.col("first._cw_row").alias("_cw_row"))
    return numbered.join(kept, "_cw_row", "left_semi").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by their kind in brackets; n_chars, where there is one, follows the text.

    Null texts stay null, empty ones empty; repeats are redacted alike. Empty table:
    empty. Other columns, whatever their names, stay.
    """
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null sources are a source; documents without words are taken like others. Repeated
    rows count as rows. Empty table: empty. Other columns, whatever their names, stay.
    """
    mixed = mixing.mix_sources(docs, into="_cw_mix").where("_cw_mix.copies > 0")
    return mixed.withColumn("_cw_copy", F.explode(F.sequence(F.lit(1), F.col("_cw_mix.copies").cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their token ids, placed in sequences of at most 2048 tokens.

    Null and empty texts are one end mark; repeated rows are documents each. Empty
    table: empty. Columns other than doc_id and text are not carried into the pieces. The documents, which
    mixing leaves in order of size, are dealt evenly to as many tasks as a shuffle has; their pieces, wide with ids, are packed where they are made.
    """
    dealt = docs.select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return packing.pack(packing.tokenise_pieces(dealt, packing.vocabulary_path()), deal=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models and the tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
