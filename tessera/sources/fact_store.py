"""A store of facts under a version log: inserts with their projections, guarded corrections, back-fills with a cursor."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import placed
from tessera.sources.scratch import stored
from tessera.sources.version_log import VersionLog

FACT = "id long, subject string, predicate string, value string, status string, valid_from long, valid_to long, supersedes long, superseded_by long"


def fact_hash() -> Column:
    """A hash of what a fact says; nulls are told from empty strings."""
    return F.sha2(F.to_json(F.struct(F.lit("fact").alias("kind"), "subject", "predicate", "value"), {"ignoreNullFields": "false"}), 256)


def natural_text() -> Column:
    """What search sees of a fact: subject, predicate and value."""
    return F.concat_ws(" ", "subject", "predicate", "value")


def value_text() -> Column:
    return F.coalesce("value", F.lit(""))


class FactStore(VersionLog):
    """Facts by id, each with ``index_text`` and ``fact_hash`` as of the version that wrote it.

    A change writes the whole rows that it changes as one more part, and then the next version; ``read`` takes each id's row
    from the last part that has it. All changes take ``base``, the version they were planned on, and raise Conflict where it is
    no longer the newest; a crash before the version file leaves the store as it was.
    """

    EMPTY = {"parts": [], "batch": -1, "cursor": None}

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        rows = None
        for k, part in enumerate(manifest["parts"]):
            own = self.spark.read.parquet(f"{self.path}/parts/{part}").withColumn("part", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], FACT + ", index_text string, fact_hash string")
        if len(manifest["parts"]) == 1:
            return rows.drop("part")
        columns = [c for c in rows.columns if c not in ("id", "part")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "part").alias("row")).select("id", "row.*")

    def _write(self, rows: DataFrame, base: dict, **new) -> dict:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{part}")
        return self.commit(base, parts=[*base["parts"], part], **new)

    def insert(self, facts: DataFrame, base: dict | None = None, text: Callable[[], Column] = natural_text, **new) -> DataFrame:
        """Add facts (``id, subject, predicate, value, valid_from``); returns ``id, outcome``: inserted, or exists."""
        base = self.manifest() if base is None else base
        known = self.read(base["version"]).select("id", F.lit(True).alias("known"))
        rows = stored(facts.select("id", "subject", "predicate", "value", "valid_from").join(known, "id", "left"), "facts-new")
        empty = {c: F.lit(None).cast("long") for c in ("valid_to", "supersedes", "superseded_by")}
        fresh = rows.where("known is null").drop("known").withColumns({"status": F.lit("active"), **empty})
        self._write(fresh.withColumns({"index_text": text(), "fact_hash": fact_hash()}), base, **new)
        return rows.select("id", F.when(F.col("known"), "exists").otherwise("inserted").alias("outcome"))

    def correct(self, corrections: DataFrame, base: dict | None = None, text: Callable[[], Column] = natural_text, **new) -> DataFrame:
        """Replace facts (``id, expected_hash, value, at, new_id``), one correction an id; returns ``id, outcome``.

        ``applied``: the old fact is superseded at ``at`` and the new one inherits its subject and predicate. Nothing
        changes where the fact is ``missing``, is not active (``closed``), or says other than the corrector saw (``changed``);
        a correction that was applied before is a ``replay``.
        """
        base = self.manifest() if base is None else base
        facts = self.read(base["version"])
        asked = corrections.select("id", "expected_hash", F.col("value").alias("new_value"), "at", "new_id")
        made = facts.select(F.col("id").alias("new_id"), F.col("supersedes").alias("made_of"), F.col("value").alias("made_value"))
        rows = asked.join(facts, "id", "left").join(made, "new_id", "left")
        replay = (F.col("made_of") == F.col("id")) & F.col("made_value").eqNullSafe(F.col("new_value"))
        outcome = F.when(replay, "replay").when(F.col("status").isNull(), "missing").when(F.col("status") != "active", "closed").when(F.col("fact_hash") != F.col("expected_hash"), "changed").when(F.col("made_of").isNotNull(), "closed").otherwise("applied")
        rows = stored(rows.withColumn("outcome", outcome), "facts-corrected")
        applied = rows.where("outcome = 'applied'")
        old = applied.withColumns({"status": F.lit("superseded"), "valid_to": F.col("at"), "superseded_by": F.col("new_id")}).select(facts.columns)
        fresh = applied.select(F.col("new_id").alias("id"), "subject", "predicate", F.col("new_value").alias("value"), F.lit("active").alias("status"), F.col("at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.col("id").alias("supersedes"), F.lit(None).cast("long").alias("superseded_by"))
        fresh = fresh.withColumns({"index_text": text(), "fact_hash": fact_hash()})
        self._write(old.unionByName(fresh.select(facts.columns)), base, **new)
        return rows.select("id", "outcome")

    def apply(self, corrections: DataFrame, batch: int) -> DataFrame | None:
        """The same for a numbered micro-batch, as ``foreachBatch`` calls it: one that a version has seen changes nothing."""
        base = self.manifest()
        return None if batch <= base["batch"] else self.correct(corrections, base, batch=batch)

    def backfill(self, size: int, text: Callable[[], Column], base: dict | None = None) -> int:
        """Rewrite ``index_text`` of the next ``size`` facts after the cursor, by id; returns how many were stale.

        The cursor goes on with the version, so a run that failed goes on where the last version ended; it is null again at the end.
        Where a batch ends is told by places of ids alone, so whole rows are never sorted and no task has a batch.
        """
        base = self.manifest() if base is None else base
        rows = self.read(base["version"])
        if base["cursor"] is not None:
            rows = rows.where(F.col("id") > base["cursor"])
        end = placed(rows.select("id", F.lit(0).alias("all")), ["all"], ["id"]).where(F.col("place") == size).select("id").first()
        last = None if end is None else end[0]
        batch = rows if last is None else rows.where(F.col("id") <= last)
        batch = stored(batch.withColumn("target", text()), "facts-backfill")
        stale = batch.where(~F.col("index_text").eqNullSafe(F.col("target")))
        count = stale.count()
        self._write(stale.withColumn("index_text", F.col("target")).drop("target"), base, cursor=last)
        return count
