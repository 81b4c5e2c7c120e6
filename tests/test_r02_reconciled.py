"""spans within other spans are reconciled as the SQL lists them."""

import duckdb

from spanlake.operators import resolve
from spanlake.plans import annotated


def test_layers():
    a, b, c = ({"start": s, "end": e} for s, e in ((0, 9), (2, 5), (9, 12)))
    assert resolve.layers([a, b, c]) == [[a, c], [b]]
    assert resolve.blanked("abcdefghijklm", [b, c]) == "  cde    jkl "


def test_digits_within_a_password(spark, tmp_path):
    text = "nsh token = 98e4c802c54c4021aa36798284236820092bfe6c tionin, then 4111111111111111 and x@y.org"
    spark.createDataFrame([(1, text, "EN", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = sorted(tuple(r) for r in annotated.queries()["reconciled_spans"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert own == sorted(db.execute(annotated.oracle_sql()["reconciled_spans"]).fetchall())
    assert len(own) == 4
