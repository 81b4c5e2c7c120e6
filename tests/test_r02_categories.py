"""the optimizer doesn't repeat the validation's expressions in a filter of its own."""

from spanlake.operators import validation


def test_error_categories_parse_once(spark):
    raw = spark.range(3).selectExpr("id as record_index", "concat('{\"mode\":\"', id, '\"}') as raw")
    found = validation.error_categories(validation.validation_errors(raw))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert {r.category: r.n for r in found.collect()}["invalid_mode"] == 3
