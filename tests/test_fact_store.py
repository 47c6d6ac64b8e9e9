import pytest
from pyspark.sql import functions as F

from tessera.sources import fact_store
from tessera.sources.fact_store import FactStore, natural_text, value_text
from tessera.sources.version_log import Conflict

FACTS = "id long, subject string, predicate string, value string, valid_from long"
FIXES = "id long, expected_hash string, value string, at long, new_id long"


@pytest.fixture
def store(spark, tmp_path):
    made = FactStore(spark, f"{tmp_path}/store")
    rows = [(i, f"s{i % 3}", "likes" if i % 2 else None, None if i == 4 else f"v{i}", 0) for i in range(10)]
    assert {r.outcome for r in made.insert(spark.createDataFrame(rows, FACTS)).collect()} == {"inserted"}
    return made


def fix(spark, store, i, value="fixed", good=True):
    expected = store.read().where(F.col("id") == i).first()
    return spark.createDataFrame([(i, expected.fact_hash if good and expected else "x", value, 5, 100 + i)], FIXES)


def state(store):
    return {r.id: (r.status, r.value, r.index_text, r.supersedes, r.superseded_by) for r in store.read().collect()}


def test_corrections_inherit_and_are_guarded(spark, store):
    asked = fix(spark, store, 3).unionByName(fix(spark, store, 4, good=False)).unionByName(fix(spark, store, 77))
    assert {r.id: r.outcome for r in store.correct(asked).collect()} == {3: "applied", 4: "changed", 77: "missing"}
    now = state(store)
    assert now[3][0] == "superseded" and now[3][4] == 103 and now[103] == ("active", "fixed", "s0 likes fixed", 3, None)
    assert len(now) == 11 and now[4] == ("active", None, "s1", None, None)
    assert {r.id: r.outcome for r in store.correct(asked).collect()} == {3: "replay", 4: "changed", 77: "missing"}
    assert state(store) == now
    again = spark.createDataFrame([(3, "x", "other", 6, 200)], FIXES)
    assert store.correct(again).first().outcome == "closed"
    assert {r.outcome for r in store.insert(spark.createDataFrame([(3, "a", "b", "c", 1), (900, "a", "b", "c", 1)], FACTS)).collect()} == {"exists", "inserted"}


def test_of_two_writers_one_wins_and_a_crash_changes_nothing(spark, store):
    base, before = store.manifest(), state(store)
    spark.range(3).write.parquet(f"{store.path}/parts/crashed")
    assert state(store) == before
    store.correct(fix(spark, store, 1), base)
    with pytest.raises(Conflict):
        store.correct(fix(spark, store, 2), base)
    assert 102 not in state(store) and 101 in state(store)
    assert state(FactStore(spark, store.path)) == state(store) and store.read(base["version"]).count() == 10


def test_a_batch_counts_once(spark, store, tmp_path):
    source = tmp_path / "in"
    fix(spark, store, 5).coalesce(1).write.json(str(source))
    seen = []
    run = spark.readStream.schema(FIXES).json(str(source)).writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, k: seen.append((df.count(), store.apply(df, k)))).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert 105 in state(store) and len(seen) == 1
    version = store.version()
    assert store.apply(fix(spark, store, 6), 0) is None and store.version() == version
    assert store.apply(fix(spark, store, 6), 1).first().outcome == "applied"


def test_backfill_goes_on_from_its_cursor(spark, store):
    assert store.backfill(4, value_text) == 4 and store.manifest()["cursor"] == 3
    assert store.backfill(4, natural_text) == 0 and store.manifest()["cursor"] == 7
    store = FactStore(spark, store.path)
    assert store.backfill(4, value_text) == 2 and store.manifest()["cursor"] is None
    assert [state(store)[i][2] for i in (0, 4, 9)] == ["v0", "s1", "v9"]


def test_no_task_has_a_whole_batch(spark, tmp_path, monkeypatch):
    """Of 600 facts, batches of 300 are dealt to several tasks, whatever their order."""
    store = FactStore(spark, f"{tmp_path}/store")
    store.insert(spark.range(600).selectExpr("(id * 7) % 600 as id", "'s' as subject", "'p' as predicate", "concat('v', id) as value", "0L as valid_from").repartition(4))
    parts = []

    def seen(df, name, keep=fact_store.stored):
        found = keep(df, name)
        if name == "facts-backfill":
            parts.append(df.select("id").groupBy(F.spark_partition_id()).count().collect())
        return found

    monkeypatch.setattr(fact_store, "stored", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for cursor in (299, 599, None):
            store.backfill(300, value_text)
            assert store.manifest()["cursor"] == cursor
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [sum(r[1] for r in p) for p in parts] == [300, 300, 0]
    assert all(len(p) > 1 for p in parts[:2])
    assert all(r.index_text == r.value for r in store.read().collect())
