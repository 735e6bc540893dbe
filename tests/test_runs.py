"""Checkpoint choice over a progress log (FIXTURES "Progress log")."""

from spanlab.operators import runs as RU


def test_best_checkpoint_fixture(spark):
    rows = [("r", i, i, v, False) for i, v in enumerate([0.9, 0.7, 0.8, 0.8, 0.5], start=1)]
    log = spark.createDataFrame(rows, "run string, ts bigint, event_id bigint, eval_loss double, is_epoch_end boolean")
    r = RU.best_checkpoint(log, patience=1).first()
    assert (r.best_step, r.best_value, r.stop_step, r.n_evals) == (2, 0.7, 4, 4)


def test_zero_best_switches_to_maximising(spark):
    rows = [("r", i, i, v, False) for i, v in enumerate([0.0, 0.5, 0.3], start=1)]
    log = spark.createDataFrame(rows, "run string, ts bigint, event_id bigint, eval_loss double, is_epoch_end boolean")
    r = RU.best_checkpoint(log, patience=5).first()
    # 0.0 is falsy: 0.5 replaces it and is compared with itself (not improving); 0.3 then improves
    assert r.best_value == 0.3 and r.best_step == 3


def test_predict_batches_k_outputs(spark):
    from spanlab.operators import predict as PD

    def factory():
        return lambda texts: [[t.upper(), t[::-1]] for t in texts]

    df = spark.createDataFrame([("1", "p", "ab"), ("2", "p", "cd")], "tweet_id string, prefix string, input_text string")
    out = {r.tweet_id: r.predicted_text for r in PD.predict_batches(df, factory, batch_size=1, k=2).collect()}
    assert out == {"1": ["P: AB", "ba :p"], "2": ["P: CD", "dc :p"]}
