"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import row_id, stored, table, word_count

#: Each source's shuffled documents are cut into this many parts, so that no running sum needs a source in one task.
PARTS = 4096


def targets(sizes: DataFrame, weights: Column, share: float, most: float) -> DataFrame:
    """Words to take from each source: ``share`` of all words, dealt out by weight, at most ``most`` times a source.

    ``sizes`` has one row per source (``source``, ``source_size``). What a source can't give is dealt out again by
    weight until none is above its limit. The fixed point has a closed form: with sources ordered by limit / weight,
    some prefix is at its limit and the rest share what is left by weight. The table has a row per source, so its
    windows stay small however many documents there are.
    """
    by_need = Window.orderBy("need", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", weights).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("need", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumns({"total": F.sum("source_size").over(every) * F.lit(float(share)), "all_weight": F.sum("weight").over(every), "cap_to": F.sum("cap").over(by_need), "weight_to": F.sum("weight").over(by_need)})
    # a source is at its limit if the level that would fill it does not use up the total
    full = F.col("cap_to") + F.col("need") * (F.col("all_weight") - F.col("weight_to")) <= F.col("total")
    ranked = ranked.withColumn("full", full)
    done = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0.0))
    left = F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))
    level = (F.col("total") - F.sum(done).over(every)) / F.sum(left).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("level"))
    ranked = ranked.withColumn("level", level).withColumn("target", F.coalesce(target, F.lit(0.0)))
    return ranked.select("source", "source_size", "target", F.sum("target").over(every).alias("budget"))


def mix(docs: DataFrame, weights: Column, share: float = 1.5, repeats: int = 2, seed: str = "mix", quantum: int | None = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: a row for each document, epoch and piece of ``quantum`` words, ``start`` null where it is not taken.

    Columns: ``doc_id, text_id, source, part, n`` (a document is one ``source, part, n``), ``size, source_size, target,
    epoch, piece, finish, start, taken``. Each source's documents are shuffled by a hash and repeated up to ``repeats``
    times. A piece's virtual finish time is the source's words up to its end, divided by the source's target. All are
    range-sorted by that time; ``start`` is the number of words before one in the whole mixture, which is cut at the total
    budget: pieces before it are taken, and of the one that crosses it the words that fit. So a source's words are its
    target to within a piece. Without ``quantum`` a document is one piece, taken whole if half of it fits, and never in
    part. ``weights`` is a column over ``place``, a source's position by code point, null last. Shuffling depends on the
    ids and texts only, so reruns agree.

    Running sums are two-level: sums of (source, part of the shuffle) first, then inside a part; and the same over
    slices of virtual time. So a source with most of the rows is spread over tasks. Null and empty texts have size 0
    and are never taken; a source without words has target 0; repeated rows count each; no rows, no result. Other
    columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(docs.select("doc_id", row_id(F.col("text")).alias("text_id"), "source", word_count(F.col("text")).alias("size"), draw.alias("draw")), "mix-sizes")
    sized = sized.withColumn("part", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int") % PARTS)
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats).withColumnRenamed("source", "g_source")

    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy("draw", "doc_id", "text_id")
    rows = sized.withColumns({"n": F.row_number().over(inside), "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    rows = rows.join(parts, rows.source.eqNullSafe(parts.p_source) & (rows.part == parts.p_part))
    rows = rows.join(goals, rows.source.eqNullSafe(goals.g_source)).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    words = F.lit(quantum).cast("long") if quantum else F.greatest("size", F.lit(1))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("size", F.lit(1)) - 1) / words))))
    upto = F.least((F.col("piece") + 1) * words, F.col("size"))
    end = F.col("before") + F.col("upto") - F.col("size") + upto + (F.col("epoch") - 1) * F.col("source_size")
    rows = rows.withColumns({"words": upto - F.col("piece") * words, "finish": F.when(F.col("size") > 0, end / F.col("target"))})

    # slices of virtual time in order, ever longer after 2: words of earlier slices, then of earlier rows inside a slice
    late = F.floor(F.log2(F.col("finish") / 2) * PARTS) + 32 * PARTS
    rows = rows.withColumn("slice", F.coalesce(F.when(F.col("finish") < 2, F.floor(F.col("finish") * PARTS * 16)).otherwise(late).cast("int"), -1 - F.col("part")))
    slices = rows.groupBy("slice").agg(F.sum("words").alias("slice_words"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("slice", F.coalesce(F.sum("slice_words").over(earlier), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("slice").orderBy("finish", "source", "draw", "doc_id", "text_id", "epoch", "piece").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.repartitionByRange("slice").withColumn("inside", F.coalesce(F.sum("words").over(order), F.lit(0)))
    ordered = ordered.join(F.broadcast(slices), "slice")  # at most PARTS * (33 + the last finish's logarithm) rows
    start = F.col("earlier") + F.col("inside")
    left = F.floor("budget") - start
    taken = F.greatest(F.least(left, F.col("words")), F.lit(0)) if quantum else F.when(left * 2 >= F.col("words"), F.col("words")).otherwise(0)
    ordered = ordered.withColumn("taken", taken.cast("long"))
    return ordered.select("doc_id", "text_id", "source", "part", "n", "size", "source_size", "target", "epoch", "piece", "finish", F.when(F.col("taken") > 0, start).alias("start"), "taken")


def five_two_one() -> Column:
    """Weights 5, 2, 1, repeating, by a source's place."""
    return F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), ((F.col("place") - 1) % 3 + 1).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), five_two_one())
    return mixed.groupBy("source", "part", "n").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    md5(concat('mix|', doc_id)) as draw
  from documents),
sizes as (
  select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    row_number() over (order by source nulls last) as place, source_size * 2.0::double as cap
  from sizes),
levels as (
  select *, sum(source_size) over () * 1.5::double as total, sum(weight) over () as all_weight,
    sum(cap) over (order by cap / weight, place rows unbounded preceding) as cap_to,
    sum(weight) over (order by cap / weight, place rows unbounded preceding) as weight_to
  from ranked),
filled as (
  select *, cap_to + (cap / weight) * (all_weight - weight_to) <= total as is_full from levels),
goals as (
  select source, source_size, case when is_full then cap else weight * ((total - sum(case when is_full then cap else 0 end) over ())
    / sum(case when is_full then 0 else weight end) over ()) end as target
  from filled),
placed as (
  select d.doc_id, d.source, d.draw, d.size, g.source_size, g.target,
    sum(d.size) over (partition by d.source order by d.draw, d.doc_id rows unbounded preceding) - d.size as before
  from sized d join goals g on d.source is not distinct from g.source),
pieces as (
  select *, least((piece + 1) * 64, size) - piece * 64 as words,
    case when size > 0 then (before + least((piece + 1) * 64, size) + (epoch - 1) * source_size) / target end as finish
  from (select *, unnest(range(0, ((greatest(size, 1) - 1) // 64 + 1)::bigint)) as piece
    from (select *, unnest([1, 2]) as epoch from placed))),
ordered as (
  select *, floor((select sum(target) from goals)) - (sum(words) over (order by finish nulls first, source nulls first, draw, doc_id, epoch, piece rows unbounded preceding) - words) as room
  from pieces)
select doc_id, size::bigint as size, source_size, target, sum(greatest(least(room, words), 0))::bigint as taken
from ordered group by all
"""
