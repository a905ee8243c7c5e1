"""Queries on events against their SQL on hand-made tables: ties and ends of the range."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry


def events(spark, folder, values, users=None):
    t0 = datetime(2024, 1, 1)
    users = users or [1] * len(values)
    rows = [(k, t0 + timedelta(minutes=k), u, "click", float(v), "{}")
            for k, (u, v) in enumerate(zip(users, values))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, "
                                "event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def expected(folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con.execute(entry.oracle_sql()[name]).df()


def test_rounded_mean_next_to_a_tie(spark, tmp_path):
    """Amounts of one group of sf0.1: the mean is 63.95, the doubles' mean lies next below it."""
    amounts = [22.12, 53.52, 107.9, 1.78, 120.46, 122.67, 43.8, 0.43, 11.37, 52.41, 193.92,
        60.51, 91.41, 5.2, 1.37, 20.08, 79.41, 59.35, 75.24, 46.35, 45.34, 16.89, 239.32]
    folder = events(spark, tmp_path, amounts)
    got = entry.queries()["f8_aggregates"](spark, folder).first()
    assert got.mean_1 == expected(folder, "f8_aggregates")["mean_1"][0] == 64.0


def test_logit_at_and_outside_the_ends(spark, tmp_path):
    folder = events(spark, tmp_path, [0.0, 1e-8, 250.0, 499.9999999, 500.0, 560.21, -3.0])
    got = entry.queries()["f9_logit"](spark, folder).toPandas().sort_values("event_id")
    want = expected(folder, "f9_logit").sort_values("event_id")
    pd.testing.assert_series_equal(got["logit_p"], want["logit_p"])
    assert np.isneginf(got["logit_p"][0]) and np.isnan(got["logit_p"][5])


def test_rounded_means_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Means of groups in two files, next to ties of one digit (mean_1) and of six (mean)."""
    rng = np.random.default_rng(3)
    values, users = [], []
    for user in range(2000):
        n = 32 if user % 2 else 23
        cents = rng.integers(0, 20000, n)
        cents[0] += (-cents.sum() + 5 * n) % (10 * n) if n == 23 else 0  # mean ends in 5 cents
        values += (cents / 100.0).tolist()
        users += [user] * n
    order = rng.permutation(len(values))
    folder = events(spark, tmp_path, [values[k] for k in order], [users[k] for k in order])
    want = expected(folder, "f8_aggregates").sort_values("subject_id", ignore_index=True)
    rows = spark.read.parquet(f"{folder}/events.parquet")
    for k, part in enumerate((rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <> 0"))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/dealt/events.parquet")
    got = entry.queries()["f8_aggregates"](spark, f"{folder}/dealt").toPandas()
    got = got.sort_values("subject_id", ignore_index=True)
    for name in ("mean_1", "mean", "total"):
        assert got[name].tolist() == want[name].tolist(), name


def test_query_results_are_rounded_as_sql_rounds(spark, tmp_path):
    from landmarkflow.plans.registry import rounded

    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(-10**6, 10**6, 3000) / 3200.0,
                             rng.integers(0, 10**7, 3000) / 128.0,
                             [0.0, np.nan, np.inf, -np.inf, 1e300, -1e300]])
    frame = pd.DataFrame({"k": np.arange(len(values)), "v": values})
    con = duckdb.connect()
    con.register("frame", frame)
    for digits in (1, 3, 6, 9):
        want = con.execute(f"SELECT round(v, {digits}) AS v FROM frame ORDER BY k").df()["v"]
        got = rounded(spark.createDataFrame(frame), digits).orderBy("k").toPandas()["v"]
        np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())
