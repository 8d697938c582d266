"""Chunked ordered operators and exact quantiles against brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ordered
from ledgerline.operators.ordered import before, block_start, coarse_key, exact_quantiles, in_order, key_value, numbered, order_key, order_statistics, ordered_features


def brute_rolling(pdf, k):
    pdf = pdf.sort_values(["year", "deal_id"])
    g = pdf.groupby("sector")["amount"]
    return (g.transform(lambda s: s.rolling(k, min_periods=1).mean()),
            g.transform(lambda s: s.rolling(k, min_periods=1).std()))


@pytest.mark.parametrize("rows", [1000, 40, 7])
def test_ordered_features_match_brute_force(spark, rows):
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({
        "deal_id": rng.permutation(np.arange(10_000, 10_000 + n)),
        "year": rng.choice([2001, 2002, 2004, 2005], n),            # ties in year, a gap
        "sector": rng.choice(["a", "b", "c"], n, p=[0.7, 0.29, 0.01]),  # hot sector, tiny sector
        "amount": rng.gamma(2.0, 100.0, n).round(2),
    })
    pdf.loc[0, "sector"] = "solo"                                   # single-row sector: std NULL
    pdf["post"] = (pdf["year"] >= 2004).astype(int)
    df = spark.createDataFrame(pdf)
    out = ordered_features(df, "sector", "amount", "post", (2, 3), rows_per_block=rows).toPandas()
    out = out.set_index("deal_id").loc[pdf.sort_values(["year", "deal_id"])["deal_id"]]
    srt = pdf.sort_values(["year", "deal_id"])
    for k in (2, 3):
        m, s = brute_rolling(pdf, k)
        np.testing.assert_allclose(out[f"roll_mean_{k}"].to_numpy(), m.loc[srt.index].to_numpy(), rtol=1e-12)
        np.testing.assert_allclose(out[f"roll_std_{k}"].to_numpy(float), s.loc[srt.index].to_numpy(float),
                                   rtol=1e-9, equal_nan=True)
    np.testing.assert_array_equal(out["policy_cumulative"].to_numpy(), srt["post"].cumsum().to_numpy())
    for k in (2, 3):
        g = srt.groupby("sector")["amount"]
        lm = g.transform(lambda s: s.shift(1).rolling(k, min_periods=1).mean())
        ls = g.transform(lambda s: s.shift(1).rolling(k, min_periods=1).std())
        np.testing.assert_allclose(out[f"roll_lag_mean_{k}"].to_numpy(float), lm.to_numpy(float), rtol=1e-12,
                                   equal_nan=True)
        np.testing.assert_allclose(out[f"roll_lag_std_{k}"].to_numpy(float), ls.to_numpy(float), rtol=1e-9,
                                   equal_nan=True)
    assert np.isnan(out.loc[pdf.loc[0, "deal_id"], "roll_std_2"])


@pytest.mark.parametrize("digit", [16, 4])
def test_exact_quantiles(spark, digit):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(800, 0.25), rng.integers(0, 5, 400)])
    g = np.where(np.arange(len(vals)) % 3 == 0, "x", "y")
    g[:5] = "tiny"
    pdf = pd.DataFrame({"g": g, "v": vals})
    df = spark.createDataFrame(pdf)
    qs = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q70": 0.7, "q99": 0.99}
    got = exact_quantiles(df, ["g"], "v", qs, digit).toPandas().set_index("g")
    for key, sub in pdf.groupby("g"):
        for nm, q in qs.items():
            assert got.loc[key, nm] == pytest.approx(np.quantile(sub["v"], q), rel=1e-12, abs=1e-12)
    glob = exact_quantiles(df, [], "v", {"m": 0.5}, digit).first()["m"]
    assert glob == pytest.approx(np.quantile(vals, 0.5))


def test_order_keys_are_the_doubles_bits(spark):
    rng = np.random.default_rng(4)
    edge = [0.0, 5e-324, 2.0 ** -1022, np.nextafter(2.0 ** -1022, 0), 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 8.0, 1e300,
            np.finfo(float).max, np.inf, 2.0 ** 1023, np.nextafter(2.0 ** 1023, 0), 1 / 3, 2.0 ** -1074 * 12345]
    vals = np.concatenate([edge, rng.integers(1, 0x7FF0000000000000, 3000).view(np.float64), 2.0 ** rng.integers(-1074, 1024, 300).astype(float)])
    vals = np.concatenate([vals, -vals])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    got = df.select("v", order_key(F.col("v")).alias("k")).withColumn("back", key_value(F.col("k"))).toPandas()
    bits = np.abs(got["v"].to_numpy()).view(np.int64)
    np.testing.assert_array_equal(got["k"], np.where(got["v"] < 0, -bits, bits))
    np.testing.assert_array_equal(got["back"], got["v"])


def test_at_most_four_passes_for_tails_ties_and_infinities(spark):
    rng = np.random.default_rng(9)
    vals = {"tail": np.exp(rng.normal(0, 60, 4000)) * rng.choice([-1, 1], 4000), "tie": np.full(3000, 1 / 3),
            "mixed": np.concatenate([np.full(1500, 20.0), [np.inf, -np.inf, 1e308, -1e308], 20 + rng.random(3000) * 1e-12]),
            "near": 1 + rng.integers(0, 50, 2000) * 2.0 ** -52}
    pdf = pd.DataFrame([(g, float(x)) for g, v in vals.items() for x in v], columns=["g", "v"])
    df = spark.createDataFrame(pdf)
    qs = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q999": 0.999, "q1": 1.0}
    got = exact_quantiles(df, ["g"], "v", qs).toPandas().set_index("g")
    for key, sub in pdf.groupby("g"):
        v = np.sort(sub["v"].to_numpy())
        for nm, q in qs.items():
            at = q * (len(v) - 1)
            low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert got.loc[key, nm] == (low if low == high or at == int(at) else pytest.approx(low + (at - int(at)) * (high - low), rel=1e-12))
    keys = df.select("g", order_key(F.col("v")).alias("_key"))
    assert order_statistics(keys, ["g"], list(qs.values()))[1] <= 4
    assert order_statistics(keys.where("g = 'tie'"), ["g"], [0.5])[1] == 1


def test_quantiles_of_missing_values_and_groups(spark):
    vals = [-1e6, *[0.0] * 30, *[-0.0] * 30, 1e6, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([("a", v) for v in vals] + [(None, 1.0)], "g string, v double")
    got = exact_quantiles(df, ["g"], "v", {"m": 0.5, "lo": 0.0, "hi": 1.0}).collect()
    assert [(r.g, r.m, r.lo, r.hi) for r in got] == [("a", 0.0, float("-inf"), float("inf"))]
    assert exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_ten_thousand_blocks_are_balanced(spark):
    """Blocks are exact stretches of places, so their number and the key's distribution don't matter."""
    n = 130_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("deal_id"), F.when(F.col("id") % 10 < 6, 2003).otherwise(F.col("id") % 4 + 2000).alias("year"))
    d = in_order(df, ["year", "deal_id"]).withColumn("_blk", block_start(10))
    sizes = d.groupBy("_blk").agg(F.count(F.lit(1)).alias("n"))
    got = sizes.agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("most"), F.sum((F.col("n") < 10).cast("int")).alias("short")).first()
    parts = d.select(F.shiftright("_at", 33)).distinct().count()
    assert got.blocks > 10_000 and got.most == 10 and got.short <= parts
    ahead = before(sizes, ["n"]).join(d.groupBy("_blk").agg(F.min("_at").alias("_at")), "_blk").toPandas().sort_values("_at")
    np.testing.assert_array_equal(ahead["n"], np.concatenate([[0], np.cumsum(sizes.toPandas().sort_values("_blk")["n"])[:-1]]))


def test_positions_in_hot_and_missing_groups(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.permutation(3000), "g": rng.choice(["hot", "b", "c"], 3000, p=[0.9, 0.06, 0.04])})
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != "c", F.col("g")))
    got = numbered(df, ["g"], ["k"], "p").toPandas()
    for _, sub in got.groupby("g", dropna=False):
        assert sub.sort_values("k")["p"].tolist() == list(range(len(sub)))
    whole = numbered(df, [], [F.desc("k")], "p").toPandas()
    assert whole.sort_values("k", ascending=False)["p"].tolist() == list(range(3000))
    assert numbered(df.limit(0), ["g"], ["k"], "p").count() == 0


def test_ranges_and_windows_stay_small_as_rows_grow(spark, monkeypatch):
    from ledgerline.operators import ordered as O
    monkeypatch.setattr(O, "ROWS_PER_PARTITION", 100)
    df = spark.range(3000).select(F.col("id").alias("deal_id"), (F.col("id") % 7 + 2000).alias("year"), F.lit("s").alias("sector"),
                                  F.col("id").cast("double").alias("amount"), F.lit(1).alias("post"))
    d = in_order(df, ["year", "deal_id"])
    sizes = [r["count"] for r in d.groupBy(O.partition_of("_at").alias("p")).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 25 and max(sizes) <= 300
    out = ordered_features(d, "sector", "amount", "post")
    per_task = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert sum(per_task) == 3000 and max(per_task) <= 300  # a task sorts one block
    assert sorted(r[0] for r in out.select("policy_cumulative").collect()) == list(range(1, 3001))


def test_coarse_keys_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(5)
    near = np.nextafter(2.0 ** np.arange(-1000, 1000, 7.0), 0)
    vals = np.concatenate([[0.0, 5e-324, np.finfo(float).max, np.inf], near, 2.0 ** np.arange(-1000, 1000, 7.0),
                           rng.integers(1, 0x7FF0000000000000, 3000).view(np.float64), 1 + rng.random(2000)])
    vals = np.unique(np.concatenate([vals, -vals]))
    got = spark.createDataFrame(pd.DataFrame({"v": vals})).select("v", coarse_key(F.col("v")).alias("k")).toPandas().sort_values("v")["k"].to_numpy()
    assert (got[1:] >= got[:-1]).all()
    assert 500 < len(np.unique(got[(vals >= 1) & (vals < 2)])) < 1000


def test_quantiles_take_order_keys_of_few_rows_only(spark, monkeypatch):
    """Keys are written for the cells that hold a wanted rank, not for every row, and equal values need none at all."""
    seen = []
    monkeypatch.setattr(ordered, "written", lambda df, tag, real=ordered.written: seen.append((tag, real(df, tag))) or seen[-1][1])
    vals = np.random.default_rng(6).uniform(1000, 500_000, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": vals})).unionByName(spark.createDataFrame([("b", 7.0)] * 5000, "g string, v double"))
    got = {r.g: (r.q, r.m) for r in exact_quantiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}).collect()}
    assert got["a"] == (pytest.approx(np.quantile(vals, 0.25), rel=1e-12), pytest.approx(np.quantile(vals, 0.5), rel=1e-12)) and got["b"] == (7.0, 7.0)
    keys = [df.groupBy("g").count().collect() for tag, df in seen if tag == "keys"]
    assert len(keys) == 1 and [r.g for r in keys[0]] == ["a"] and keys[0][0]["count"] < 500


def test_feature_rows_are_not_shuffled_by_category(spark):
    """Of all joins of the wide rows none may shuffle them by a sector or year: that is one task per level, whatever the cluster."""
    from ledgerline.config import PRESET_A
    from ledgerline.operators.features import build_features
    level = lambda c, n: F.concat(F.lit(c), F.col("id") % n).alias(c)
    deals = spark.range(30_000).select(
        F.col("id").alias("deal_id"), (F.col("id") % 7 + 1995).cast("int").alias("year"), F.lit(1).alias("month"), level("investor", 900),
        (F.col("id") % 997 + 1.5).alias("amount"), F.lit(5).alias("share_size"), level("party", 50), level("sector", 5), level("subsector", 4),
        level("country", 20), level("region", 3), F.lit("").alias("bri"), F.lit("G").alias("greenfield"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        built = build_features(deals, PRESET_A)
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert "hashpartitioning" not in plan
        assert plan.count("shufflepartitionidpassthrough") == 1
        got = built.toPandas().sort_values(["year", "deal_id"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(got) == 30_000 and (got["sector_code"] == got["sector"].str[-1].astype(int)).all()
    np.testing.assert_allclose(got["sector_blend"], 0.7 * got.groupby("sector")["log_amount"].transform("mean") + 0.3 * got["log_amount"].mean())
    np.testing.assert_array_equal(got["policy_cumulative"], got["post_policy"].cumsum())
    np.testing.assert_array_equal(got["adaptive_target"], got["amount"] > got.groupby("year")["amount"].transform(lambda s: s.quantile(0.7)))


def test_windows_look_over_blocks_without_the_group(spark):
    rows = [(i, 2000 + i // 20, "rare" if i in (3, 41, 88, 89) else None if i % 9 == 4 else "often", float(i) if i % 10 else None, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "deal_id long, year int, sector string, amount double, post int")
    got = ordered_features(df, "sector", "amount", "post", rows_per_block=5).toPandas().sort_values("deal_id")
    assert got["policy_cumulative"].tolist() == np.cumsum([r[4] for r in rows]).tolist() and len(got) == 100
    for _, sub in got.groupby("sector", dropna=False):
        for k in (2, 3):
            last = sub["amount"].rolling(k, min_periods=1)
            for name, want in (("mean", last.mean()), ("lag_mean", sub["amount"].shift(1).rolling(k, min_periods=1).mean())):
                np.testing.assert_allclose(sub[f"roll_{name}_{k}"].to_numpy(float), want.to_numpy(float), equal_nan=True)
