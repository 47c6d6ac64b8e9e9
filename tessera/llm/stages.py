"""The stages of the corpus pipeline: each applies one operator's decisions to its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing
from tessera.llm import line_dedup as line_filter
from tessera.llm import near_dedup as near
from tessera.llm import quality as classifier
from tessera.llm._shared import WORD, row_id, stored, table


#: Decisions that are sent to every task rather than shuffled with the texts: at most this many rows of 16 bytes or so.
MOST_BROADCAST = 500_000


def _matched(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with the columns of ``found``, which has one row per (t_doc, t_text).

    Few decisions are broadcast, so that no text is shuffled; many are joined by a shuffle.
    """
    found = stored(found, "stage-decisions")
    if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["t_doc"]) & (row_id(docs["text"]) == found["t_text"]), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like any. Columns stay as they come."""
    scored = classifier.score(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias("t_doc"), F.col("text_id").alias("t_text")).distinct()
    return _matched(docs, rejected, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that many sites share; a document goes if it had words and no line with words is left.

    Such a document is made of lines that an earlier one keeps. Texts that lose nothing, null ones too, stay as they are,
    and other columns stay as they come, but for ``n_chars``, which is that of the new text.
    """
    cut = F.col("n_removed") > 0
    rows = line_filter.dedup(docs, rows=True).where(~cut | F.col("kept_text").rlike(WORD))
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text")).alias("text"), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return rows.select(*(changed.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    Repeated rows of it are that document, and stay together; texts without words are near nothing. Columns stay as they come.
    """
    gone = near.link(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("t_doc"), F.col("text_id").alias("t_text")).distinct()
    return _matched(docs, gone, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; repeated rows alike, as often as one of them, rounded up.

    Texts without words are never taken; a null source is a source. Columns stay as they come.
    """
    mixed = mixing.mix(docs, mixing.five_two_one(), quantum=None)
    taken = mixed.groupBy(F.col("doc_id").alias("t_doc"), F.col("text_id").alias("t_text")).agg(F.count_if(F.col("taken") > 0).alias("t_all"), F.count_if(F.col("epoch") == 1).alias("t_rows"))
    copies = F.ceil(F.col("t_all") / F.col("t_rows")).cast("int")
    columns = [docs[c] for c in docs.columns]
    return _matched(docs, taken.where("t_all > 0")).select(*columns, F.explode(F.array_repeat(F.lit(1), copies)).alias("t_copy")).drop("t_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each remaining row; a null text counts as empty."""
    return bpe.digests(bpe.encode_decode(docs, bpe.default_tokenizer()))
