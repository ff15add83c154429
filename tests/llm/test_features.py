"""What of a row goes to Python while it is scored."""

from pyspark.sql import functions as F

from corpuslens.llm import toxicity


def test_only_texts_go_to_python(spark):
    rows = spark.createDataFrame(
        [(1, "a", "You idiot!"), (1, "a", "You idiot!"), (None, "b", None), (4, "c", "")], "id bigint, x string, text string"
    )
    docs = rows.select(F.struct("id", "x", "text").alias("doc"), "text")
    found = toxicity.with_features(docs, {"idiot": 1.0})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    got = {(r["doc"]["id"], tuple(r["features"])) for r in found.collect()}
    assert got == {(i, tuple(toxicity.text_features(t, {"idiot": 1.0}))) for i, t in [(1, "You idiot!"), (None, ""), (4, "")]}
    assert found.count() == 4 and found.columns == ["doc", "features"]
