from tessera.functions import rules as R

def test_names(spark):
    df = spark.createDataFrame([("Ｆoo  BAR",), (" straße ",), (None,)], "name string")
    assert [r[0] for r in df.select(R.entity_id("name")).collect()] == ["foo bar", "strasse", None]
    names = spark.createDataFrame([("/etc/x",), ("a.py",), ("MY_VAR",), ("FooBar",), ("plain",), (" ",)], "name string")
    assert [r[0] for r in names.select(R.invalid_subject(names["name"])).collect()] == ["path", "file", "environment_variable", "type_name", None, "empty"]
