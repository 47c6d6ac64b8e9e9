import json

from tessera.sources.benchmarks import long_memory_cases


def test_cases_events_and_rejects(spark):
    records = [
        {"question_id": "q1", "question": "when?", "answer": "monday", "category": "time", "answer_message_ids": ["m1", "s:m2", "m1", "lost"], "sessions": [{"session_id": "s", "messages": [{"id": "m1", "role": "Human", "content": "a", "timestamp": "2024-01-01"}, {"message_id": "m2", "speaker": "ai", "text": "b"}]}, [{"id": "m2", "role": "robot", "content": "c", "valid_to": "2025"}]]},
        {"id": "q2", "query": "none?", "gold_message_ids": "0", "messages": [[{"content": "x"}, {"role": "tool"}]]},
        {"question_id": "q3"},
        {"question": "no id"},
        {"question_id": "twice"},
        {"question_id": "twice"},
        {"question_id": "same", "sessions": [[{"id": "1"}, {"id": "1"}]]},
        [1],
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("broken",), (None,)], "record string")
    events, cases, rejects = long_memory_cases(df)
    got = {r.event_id: (r.place, r.actor_type, r.text, r.occurred_at, r.valid_to) for r in events.collect()}
    assert got == {
        "lme:q1:s:m1": (0, "user", "a", "2024-01-01", None),
        "lme:q1:s:m2": (1, "assistant", "b", "2000-01-01T00:00:01+00:00", None),
        "lme:q1:1:m2": (2, "user", "c", "2000-01-01T00:00:02+00:00", "2025"),
        "lme:q2:0:0": (0, "user", "x", "2000-01-01T00:00:00+00:00", None),
        "lme:q2:0:1": (1, "tool", "", "2000-01-01T00:00:01+00:00", None),
    }
    found = {r.case_id: (r.query, r.category, r.answer, r.gold) for r in cases.collect()}
    assert found == {"q1": ("when?", "time", "monday", ["lme:q1:s:m1", "lme:q1:s:m2"]), "q2": ("none?", "uncategorized", None, ["lme:q2:0:0"]), "q3": ("", "uncategorized", None, [])}
    assert sorted(r.why for r in rejects.collect()) == sorted(["no case id", "duplicate case id", "duplicate case id", "duplicate message id", "not an object", "not an object", "not an object"])
    only = long_memory_cases(df, spark.createDataFrame([("q2",)], "case_id string"))
    assert {r.case_id for r in only[1].collect()} == {"q2"} and only[0].count() == 2
