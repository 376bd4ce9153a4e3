"""Order statistics with one key holding most of the rows, against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from facadelake.operators import admission, hotkeys


def skewed(spark, n=6000):
    rng = np.random.default_rng(7)
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "i": np.arange(n), "v": np.round(rng.normal(50, 20, n), 2)})
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_ranked(spark):
    pdf, df = skewed(spark)
    out = hotkeys.ranked(df, ["k"], ["v", "i"], F.floor(F.col("v") / 5), "rn").toPandas().sort_values("i")
    want = pdf.sort_values(["k", "v", "i"]).groupby("k").cumcount().sort_index() + 1
    assert (out["rn"].to_numpy() == want.to_numpy()).all()


def test_previous_value(spark):
    pdf, df = skewed(spark)
    out = hotkeys.previous_value(df, ["k"], "v", ["i"], F.floor(F.col("v") / 5), "p").toPandas().sort_values("i")
    want = pdf.sort_values(["k", "v", "i"]).groupby("k")["v"].shift().sort_index()
    assert np.array_equal(out["p"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_exact_median(spark):
    pdf, df = skewed(spark)
    pdf.loc[pdf.index % 5 == 0, "v"] *= -1
    out = hotkeys.exact_median(spark.createDataFrame(pdf), ["k"], "v", "m").toPandas().set_index("k")["m"].sort_index()
    assert np.allclose(out.to_numpy(), pdf.groupby("k")["v"].median().to_numpy())


def test_latest(spark):
    pdf, df = skewed(spark)
    out = hotkeys.latest(df, ["k"], ["v", "i"]).toPandas().set_index("k")["i"].sort_index()
    assert out.to_dict() == pdf.sort_values(["v", "i"]).groupby("k")["i"].last().to_dict()


def requests(spark, n=3000):
    rng = np.random.default_rng(3)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 4000, n)), unit="s")
    client = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 9, n))
    pdf = pd.DataFrame({"client_id": client, "request_id": np.arange(n), "ts": ts})
    return pdf, spark.createDataFrame(pdf)


def test_sliding_window_against_loop(spark):
    pdf, df = requests(spark)
    out = admission.sliding_admission(df, limit=9, window_s=60).toPandas()
    got = {(r.client_id, r.ts): (r.earlier, r.admitted) for r in out.itertuples()}
    for client, rows in pdf.groupby("client_id"):
        times = sorted(set(rows["ts"]))
        for t in times:
            earlier = sum(1 for u in times if t - pd.Timedelta(seconds=60) < u < t)
            assert got[(client, t)] == (earlier, earlier < 9)


def test_token_bucket_against_loop(spark):
    pdf, df = requests(spark)
    out = admission.token_bucket(df, cap=5, rate=0.2, bucket_seconds=100).toPandas().set_index("request_id")
    for _, rows in pdf.groupby("client_id"):
        tokens, last = None, None
        for r in rows.sort_values(["ts", "request_id"]).itertuples():
            tokens = 5.0 if last is None else min(5.0, tokens + (r.ts - last).total_seconds() * 0.2)
            ok = tokens >= 1
            tokens, last = tokens - ok, r.ts
            assert out.loc[r.request_id, "admitted"] == ok
            assert abs(out.loc[r.request_id, "tokens_left"] - tokens) < 1e-6
