"""Plan checks: pushdown and pruning at the scan, no unpartitioned window over rows,
Python only where the operator needs it (SURVEY §5.5)."""

from spanlab.plans import catalog
from spanlab.plans import testviews as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark, sf_small):
    p = plan(V.class_labels(spark, sf_small))
    assert "ReadSchema: struct<doc_id:bigint,toxic:int>" in p


def test_filter_pushed_to_scan(spark, sf_small):
    p = plan(V.span_labels(spark, sf_small))
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in p


def test_no_python_in_core_queries(spark, sf_small):
    for name in ["j3_span_ensemble", "i4_eval_spans", "e6_span_scores", "g1_split_exact", "b7_clean_text", "h5_lexical_replace"]:
        p = catalog.queries()[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert "PythonUDF" not in p and "MapInPandas" not in p and "BatchEvalPython" not in p, name


def test_exact_cut_is_one_filter_pass(spark, tmp_path, monkeypatch):
    """A plain table is scanned once for the bound (keys only) and once for the rows; rows are
    neither shuffled nor joined, nor sorted by a global window."""
    from spanlab.operators import balance, exactk

    path = str(tmp_path / "plain.parquet")
    spark.range(5000).selectExpr("cast(id as string) AS tweet_id", "repeat('text ', 20) AS tweet", "id % 3 AS label").write.parquet(path)
    plain = spark.read.parquet(path)
    written = []

    def spy(df, name, real=exactk.write_once):
        written.append(plan(df))
        return real(df, name)

    monkeypatch.setattr(exactk, "write_once", spy)
    out = balance.split_exact(plain)
    result = plan(out)
    def scans(p):
        return p.count("ReadSchema: struct<tweet_id:string")

    assert [scans(p) for p in written] == [1] + [0] * (len(written) - 1) and "ReadSchema: struct<tweet_id:string>" in written[0]
    assert scans(result) == 1
    for node in ("Join", "Exchange", "Window", "Sort"):
        assert node not in result, node
    assert all("NestedLoop" not in p for p in written)
    assert out.filter("split = 'val'").count() == 1000
    written.clear()
    result = plan(balance.undersample(plain, "label"))
    assert sum(map(scans, written)) == 1 and scans(result) == 1
    assert "BroadcastHashJoin" in result and "Exchange hash" not in result and "NestedLoop" not in result


def _scans(df, table):
    """Scans in the plan that ran (an exchange that is used again is no scan)."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return ran.count(f"{table}.parquet")


def test_report_and_ensemble_run_upstream_once(spark, sf_small):
    # texts + span labels each read documents once; a union of branches would double it
    assert _scans(catalog.queries()["e7_classification_report"](spark, sf_small), "documents") <= 2
    assert _scans(catalog.queries()["j3_span_ensemble"](spark, sf_small), "documents") <= 2
    assert _scans(catalog.queries()["e6_span_scores"](spark, sf_small), "documents") <= 2


def test_no_majority_filter_is_a_window(spark, sf_small):
    p = catalog.queries()["d4_without_majority_window"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in p and "Window" in p
