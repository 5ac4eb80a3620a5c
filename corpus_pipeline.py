"""From raw documents to token ids: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.llm import decontaminate, langid, mixing, ngram_join, token_output
from markwright.llm.common import ROW, Scratch, held_out_bucket, row_ids, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the classifier tells with enough certainty.

    Null, empty and letterless texts have no language and go. Equal rows get equal decisions; null ids are ids like
    others (their rows are learned from); labels are used in training alone. Without labelled rows all documents go. An
    empty table gives an empty result. Columns other than those of documents, whatever their names, are dropped.
    """
    model = langid.train(docs, F.coalesce(held_out_bucket(F.col("doc_id"), 4) != 2, F.lit(True)))
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest id, of each group of near duplicates (five words, similarity 0.8).

    Rows that repeat an id and rows without one are documents of their own, after those with an id. Null, empty and
    blank texts are near nothing and stay. An empty table gives an empty result; other columns are dropped.
    """
    rows = row_ids(docs.select(*COLUMNS))
    groups = ngram_join.ngram_components(rows.select(F.col(ROW).alias("doc_id"), "text"), size=5, num=80, den=100)
    copies = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("copy")).distinct()
    return rows.join(copies, F.col(ROW) == F.col("copy"), "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs.

    Null and empty texts hold no window and stay, as all do where the benchmark is empty. Equal rows get equal
    decisions, whatever their ids. An empty table gives an empty result; other columns are dropped.
    """
    found = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come to their weights, in shuffled shards.

    A source's last document may be cut to its first words; its n_chars is then the cut text's. Texts without words
    (null, empty, blank) can't be drawn and go. Null sources are a source; rows that repeat an id and rows without one
    are documents of their own. An empty table gives an empty result; other columns are dropped.
    """
    mixed = mixing.mixed(docs.select(*COLUMNS, F.length("text").alias("_length")))
    cut = F.length("text") < F.col("_length")
    return mixed.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what the files hold: doc_id, start, n_tokens, ids_crc32.

    Every row is a document, in the order of ids, null ids first, then of texts; null text counts as empty, and each
    document ends in the end id. An empty table gives an empty result; other columns are ignored.
    """
    return token_output.round_trip(docs.select("doc_id", "text"), token_output.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_stage),
    ("token ids", token_ids),
]

#: SQL can't express the classifier, the random draws and the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.release()
    return docs
