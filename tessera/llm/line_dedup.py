"""Cross-site boilerplate lines by the spread of each line over distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import SPACE, row_id, stored, table


def _line(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, SPACE, " "))


def line_key(line: Column) -> Column:
    """96 bits that stand for a normalised line."""
    return F.struct(F.xxhash64(line).alias("h"), F.crc32(line.cast("binary")).alias("c"))


def line_keys(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``doc_id, text_id, site, keys``: the different lines of each document; lines without words have no key.

    ``site`` is never null: a null site and an empty one are two.
    """
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _line), lambda x: x != ""), line_key))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), site.alias("site"), keys.alias("keys"))


def lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``doc_id, text_id, site, key`` once for each different line of a document."""
    return line_keys(docs, id_col, text_col, site_col).select("doc_id", "text_id", "site", F.explode("keys").alias("key"))


def boilerplate(found: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """``key, first_doc`` of the lines that at least ``min_sites`` sites have.

    A sketch of the sites is kept per line, and sketches merge as Spark aggregates. Where the estimate is within four
    standard errors (and one site) of the threshold, the sites are counted exactly.
    """
    spread = found.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    margin = 1 + 4 * min_sites * 1.04 / 2 ** (lg_k / 2)
    spread = stored(spread.where((F.col("docs") >= min_sites) & (F.col("sites") >= min_sites - margin)), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = found.join(near.select("key"), "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").count().where(F.col("count") >= min_sites)
    return spread.where(F.col("sites") > min_sites + margin).select("key", "first_doc").unionByName(near.join(exact, "key").select("key", "first_doc"))


def dedup(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", rows: bool = False) -> DataFrame:
    """``doc_id, text_id, n_lines, n_removed, kept_text`` for every row of ``docs``, and with ``rows`` the row itself.

    A line (white space normalised) that at least ``min_sites`` different sites have is boilerplate; it stays only in
    the document with the smallest id that has it, so no passage leaves the corpus. Other lines are kept as they are,
    in order. Sites are counted once per document and line, null as one site of its own. A null text counts as empty;
    blank lines are never removed; repeated rows are treated alike; rows without an id never come first, so they
    lose what is boilerplate; no rows, no result; other columns are read only for ``rows``, as the struct ``row``.

    Texts are split once for the keys, which are files, and once to be cut.
    """
    keyed = stored(line_keys(docs, id_col, text_col, site_col), "line-keys")
    found = keyed.select("doc_id", "text_id", "site", F.explode("keys").alias("key"))
    gone = boilerplate(found, min_sites)
    hits = found.select("doc_id", "text_id", "key").join(gone, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    hits = hits.groupBy(F.col("doc_id").alias("h_doc"), F.col("text_id").alias("h_text")).agg(F.collect_set("key").alias("gone"))
    every = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if rows else []
    texts = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), F.col(text_col).alias("given"), *every)
    texts = texts.join(hits, texts.doc_id.eqNullSafe(hits.h_doc) & (texts.text_id == hits.h_text), "left").withColumn("all_lines", F.split(F.coalesce("given", F.lit("")), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("all_lines")).otherwise(F.filter("all_lines", lambda x: ~F.array_contains(F.col("gone"), line_key(_line(x)))))
    texts = texts.withColumn("kept_lines", kept)
    return texts.select("doc_id", "text_id", F.size("all_lines").cast("long").alias("n_lines"), (F.size("all_lines") - F.size("kept_lines")).cast("long").alias("n_removed"), F.array_join("kept_lines", "\n").alias("kept_text"), *(["row"] if rows else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, coalesce('=' || source, '') as site, unnest(string_split(coalesce(text, ''), chr(10))) as raw,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
n as (
  select *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line from l),
b as (
  select line, min(doc_id) as first_doc from n where line <> '' group by line having count(distinct site) >= 10),
k as (
  select n.*, b.line is not null and n.doc_id <> b.first_doc as gone from n left join b using (line))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
  sha256(coalesce(string_agg(raw, chr(10) order by i) filter (not gone), '')) as kept_sha256
from k group by doc_id
"""
