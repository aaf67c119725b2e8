"""Hot keys spread over several slices give the same results as plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltgrid.operators import ordered as o


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(3)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.rand(n) < 0.6, "hot", rng.choice(list("abcdef"), n)), "t": rng.permutation(n), "v": rng.randint(0, 40, n).astype(float)})
    return spark.createDataFrame(pdf), pdf.sort_values(["k", "t"]).reset_index(drop=True)


def by_kt(df, *cols):
    return df.select("k", "t", *cols).toPandas().sort_values(["k", "t"]).reset_index(drop=True)


def test_hot_key_is_split(data):
    s = o.slices(data[0], ["k"], ["t"])
    per_key = s.filter("k = 'hot'").select(o.SLICE).distinct().count()
    assert per_key > 1


def test_running(data):
    df, pdf = data
    got = by_kt(o.running(df, ["k"], ["t"], {"s": ("sum", "v"), "m": ("max", "v"), "lo": ("min", "v"), "n": ("count", "v")}), "s", "m", "lo", "n")
    g = pdf.groupby("k")["v"]
    assert np.allclose(got["s"], g.cumsum()) and np.allclose(got["m"], g.cummax()) and np.allclose(got["lo"], g.cummin())
    assert (got["n"] == g.cumcount() + 1).all()


def test_previous_and_following(data):
    df, pdf = data
    got = by_kt(o.previous(df, ["k"], ["t"], {"p": "v"}), "p")
    assert got["p"].equals(pdf.groupby("k")["v"].shift(1))
    got = by_kt(o.following(df, ["k"], ["t"], {"p": "v"}), "p")
    assert got["p"].equals(pdf.groupby("k")["v"].shift(-1))


def test_global_row_numbers_with_descending_order(data):
    df, pdf = data
    got = o.row_numbers(df, [], [F.col("v").desc(), "t"], "rn").toPandas().sort_values("rn").reset_index(drop=True)
    want = pdf.sort_values(["v", "t"], ascending=[False, True]).reset_index(drop=True)
    assert (got["t"] == want["t"]).all() and (got["rn"] == np.arange(1, len(want) + 1)).all()


def test_trailing_over_chunk_borders(data):
    df, pdf = data
    r = o.row_numbers(df, ["k"], ["t"], "rn")
    got = by_kt(o.trailing(r, ["k"], "rn", 5, {"a": F.avg("v")}, chunk=7), "a")
    want = pdf.groupby("k")["v"].rolling(5, min_periods=1).mean().reset_index(drop=True)
    assert np.allclose(got["a"], want)


def test_percentiles_ranks_gini_spearman(data):
    df, pdf = data
    q = o.percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}).toPandas().set_index("k")
    for k, g in pdf.groupby("k")["v"]:
        assert np.isclose(q.loc[k, "a"], np.percentile(g, 25)) and np.isclose(q.loc[k, "b"], np.percentile(g, 90))
    two = df.withColumn("w", F.col("v") * 0.5 + F.pmod(F.col("t"), F.lit(9)))
    rho = o.spearman(two, [], "v", "w").first()[0]
    p = two.toPandas()
    assert np.isclose(rho, p["v"].rank().corr(p["w"].rank()))
    g = o.gini(df, [], "v").first()[0]
    x = np.sort(pdf["v"].to_numpy())
    n, cum = len(x), np.cumsum(x)
    assert np.isclose(g, (n + 1 - 2 * (cum / cum[-1]).sum()) / n)


def test_gini_counts_absent_members_as_zero(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    members = spark.range(5)
    x = np.array([0, 0, 0, 1.0, 3.0])
    cum = np.cumsum(x)
    assert np.isclose(o.gini(df, [], "v", population=members).first()[0], (6 - 2 * (cum / 4).sum()) / 5)
    assert o.gini(df.withColumn("v", F.lit(0.0)), [], "v").first()[0] == 0.0
