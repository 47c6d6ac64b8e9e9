import pytest

from tessera.sources.pair_backlog import PairBacklog
from tessera.sources.version_log import Conflict


def test_pairs_wait_once_and_are_drained_as_counted(spark, tmp_path):
    log = PairBacklog(spark, f"{tmp_path}/pairs")
    pairs = spark.createDataFrame([(2, 1, 0.95), (1, 2, 0.9), (3, 4, 0.89), (5, 6, 0.87), (7, 8, 0.99), (9, 9, 1.0)], "left_id long, right_id long, similarity double")
    assert log.add(pairs, most=2) == 2 and log.add(pairs, most=2) == 0
    assert sorted((r.left_id, r.right_id, r.similarity) for r in log.read().collect()) == [(1, 2, 0.95), (7, 8, 0.99)]
    assert log.add(pairs) == 1 and log.inspect(0.9) == {"pending": 3, "candidates": 1, "least": 0.89, "greatest": 0.89}
    version = log.version()
    with pytest.raises(Conflict):
        log.drain(0.9, 2)
    assert log.version() == version
    base = log.manifest()
    assert log.drain(0.9, 1, base) == 1
    with pytest.raises(Conflict):
        log.drain(0.97, 1, base)
    assert {(r.left_id, r.decision) for r in log.read().collect()} == {(1, None), (7, None), (3, "dismissed_below_floor")}
    assert log.add(pairs) == 0 and log.inspect(0.9)["candidates"] == 0
    assert [(r.left_id, r["rank"]) for r in log.next_in_turn(5, (1, 2)).orderBy("rank").collect()] == [(7, 1), (1, 2)]
