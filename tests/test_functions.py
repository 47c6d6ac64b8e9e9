import pytest
from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import dedup, experience, fusion, graph, lifecycle, retrieval


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("electricity", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_initials_are_one_letter(spark):
    import duckdb

    texts = ["ßen", "ßß", "ﬁne", "ŉ", "ᾀs", "ǰ", "été", "ñ", "ა", "ǆ", "", "9", " a", "🙂", "ﬃ", "ΐ", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.initial(F.col("t"))).collect()]
    assert got == [duckdb.execute("select upper(substr(?, 1, 1))", [t]).fetchall()[0][0] for t in texts]


def test_intervals(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, 5), (1, 5), (5, 9), (6, 9)], "a int, b int")
    assert [r[0] for r in df.select(T.within(F.col("a"), F.col("b"), F.lit(5))).collect()] == [True, True, False, False, True, False]
    assert [r[0] for r in df.select(T.overlap(F.col("a"), F.col("b"), F.lit(5), F.lit(6))).collect()] == [True, True, False, False, True, False]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_packing_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, 10, 6), (1, 2, 11, 7), (1, 3, 12, 4), (2, 1, 13, 99)], "query_id long, rank long, doc_id long, tokens long")
    assert {r.query_id: (r.used, r.taken) for r in fusion.pack(df, 10).collect()} == {1: (10, [10, 12]), 2: (0, [])}


def test_walks_end_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 1.0)], "from_id string, to_id string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = sorted((r.node, r.hops, r.weight) for r in graph.walk(edges, seeds, 3).collect())
    assert got == [("b", 1, 0.5), ("b", 2, 0.5), ("c", 1, 1.0), ("c", 2, 0.25)]


def test_tips(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "node long, next long")
    assert {r.node: r.tip for r in graph.tips(links).collect()} == {1: 3, 2: 3, 7: None, 8: None}


def test_near_copies():
    assert dedup.is_near_copy("The service runs on port 8080.", "service runs on port 8080")
    assert not dedup.is_near_copy("The service runs on port 8080", "The service runs on port 8081")
    assert not dedup.is_near_copy("It is on", "It is not on")
    assert not dedup.is_near_copy("The release went out on Monday to all users", "The release went out on Friday to all users")
    assert not dedup.is_near_copy("The config of Redis is in /etc/app.conf now", "The config of Nginx is in /etc/app.conf now")
    assert not dedup.is_near_copy('The title is "old one" for every page', 'The title is "old two" for every page')
    assert dedup.atoms("This User ran v1.2.3 at /opt/x on 8080, didn't stop: “a b” and Redis") == ("literal:v1.2.3", "literal:/opt/x", "literal:8080", "word:didn't", "quoted:a b", "name:redis")


def test_chunks_hold_whole_lines(spark):
    df = spark.createDataFrame([(1, "aa\nbb\n\ncccccccccc\nd\ne"), (2, None)], "doc_id long, text string")
    assert [r.chunk_text for r in experience.chunk(df, "text", 6).orderBy("chunk_no").collect()] == ["aa\nbb", "cccccccccc", "d\ne"]


def test_exact_search_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one, many = (sorted(map(tuple, retrieval.nearest(v.where("vec_id % 20 = 0"), v, 4, s, b).select("query_id", "rank", "vec_id").collect())) for s, b in ((65536, 4096), (7, 2)))
    assert one == many and len(one) == 12


def test_delete_closure(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "derived_id long, event_id long")
    events = spark.createDataFrame([(10,), (11,), (12,)], "event_id long")
    gone, orphans = lifecycle.delete_closure(spark.createDataFrame([(1,)], "id long"), links, events)
    assert gone.count() == 2 and [r.event_id for r in orphans.collect()] == [10]
