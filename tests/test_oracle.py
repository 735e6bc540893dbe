"""Registered queries against their DuckDB oracle on the smallest data set.

Set SPANLAB_FULL_ORACLE=1 to run every key (several minutes)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from oracle_check import TABLES, canon
from spanlab.plans import catalog

FAST = [
    "b7_clean_text", "d1_attach_labels_join", "b10_unwrap_prompt", "j3_span_ensemble", "b14_submission_spans",
    "i4_eval_spans", "e6_span_scores", "e7_classification_report", "k2_span_errors", "g1_split_exact",
    "g2_oversample", "h1_synonym_replace", "h8_markov_table", "m1_best_checkpoint", "l1_predict_batches",
]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


KEYS = sorted(E.oracle_sql()) if os.environ.get("SPANLAB_FULL_ORACLE") else FAST


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert sorted(canon(df.columns, [tuple(r) for r in df.collect()])) == sorted(canon(dcols, rel.fetchall()))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["class", "precision", "recall", "f1_score", "support"]
    assert df.count() >= 1


def test_every_query_has_oracle():
    rows_only = set(catalog.queries()) - set(E.oracle_sql())
    assert not rows_only, rows_only
