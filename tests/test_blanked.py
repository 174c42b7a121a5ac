"""Blanked texts are worked out once for all columns."""

from weftline import queries


def test_blanked_text_is_worked_out_once(spark, tmp_path):
    spark.createDataFrame([(1, "Ala [x] ma, /y/  kota!  "), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.blanked(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(r"[^\p{L}\p{N}_]") == 1
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[1]["norm"].endswith("ma kota") and got[1]["n"] >= got[1]["last"] > 0 and got[3]["norm"] is None
