"""Operators on small frames with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dims as D
from tidemark.functions import nature as NA
from tidemark.operators import align, change, contracts, cycles, gold, health, lookup, stats
from tidemark.schema import ContractError

OBS = "series_id string, source string, date date, value double, freq string, unit string, dims string"
META = "series_id string, nature string, accumulation string, alignment_override string"
day = dt.date.fromisoformat


def obs(spark, rows, freq="M", series="s", dims="{}"):
    return spark.createDataFrame([(series, "X", day(d), v, freq, "u", dims) for d, v in rows], OBS)


def meta(spark, nature="stock", accumulation="none", override=None, series="s"):
    return spark.createDataFrame([(series, nature, accumulation, override)], META)


def series(spark, values, start=dt.date(2020, 1, 31)):
    rows, d = [], start
    for v in values:
        rows.append((d, v))
        d = (d.replace(day=1) + dt.timedelta(days=63)).replace(day=1) - dt.timedelta(days=1)
    return spark.createDataFrame(rows, "date date, value double")


def test_days_take_the_last_value_of_the_month(spark):
    out = align.monthly(obs(spark, [("2026-01-09", 100.0), ("2026-01-30", 130.0)], "D"), meta(spark)).collect()
    assert [(r["date"], r["value"], r["alignment_method"]) for r in out] == [(day("2026-01-31"), 130.0, "last")]


def test_last_skips_nulls_and_an_all_null_month_is_null(spark):
    rows = [("2026-01-09", 100.0), ("2026-01-30", None), ("2026-02-02", None)]
    out = {r["date"]: r["value"] for r in align.monthly(obs(spark, rows, "D"), meta(spark)).collect()}
    assert out == {day("2026-01-31"): 100.0, day("2026-02-28"): None}


@pytest.mark.parametrize(("nature", "override", "want"), [("flow", None, 3.0), ("rate", None, 1.5), ("stock", "sum", 3.0)])
def test_method_follows_nature_and_override(spark, nature, override, want):
    out = align.monthly(obs(spark, [("2026-01-05", 1.0), ("2026-01-06", 2.0)], "W"), meta(spark, nature, override=override)).first()
    assert out["value"] == want


def test_alignment_refuses_what_it_cannot_know(spark):
    one = obs(spark, [("2026-01-05", 1.0)], "D")
    with pytest.raises(Exception, match="no alignment method"):
        align.monthly(one, meta(spark, "unclassified")).collect()
    with pytest.raises(ContractError, match="mixed_frequency"):
        align.monthly(one.unionByName(obs(spark, [("2026-02-28", 1.0)])), meta(spark))
    with pytest.raises(ContractError, match="missing_policy"):
        align.monthly(one, meta(spark, series="other"))
    with pytest.raises(ContractError, match="unsupported_frequency"):
        align.monthly(obs(spark, [("2026-12-31", 1.0)], "Y"), meta(spark))
    assert align.monthly(one, meta(spark, accumulation="ytd")).count() == 0


def test_quarters_are_sparse_or_carried_on(spark):
    q = obs(spark, [("2026-03-31", 1.0), ("2026-06-30", 2.0)], "Q")
    assert align.monthly(q, meta(spark)).count() == 2
    out = align.monthly(q, meta(spark), "ffill").orderBy("date").collect()
    assert [(r["date"].month, r["value"], r["is_imputed"]) for r in out] == [(3, 1.0, False), (4, 1.0, True), (5, 1.0, True), (6, 2.0, False)]


def test_decumulation_restarts_each_year(spark):
    rows = [("2021-01-31", 25382.899), ("2021-02-28", 49154.549), ("2021-03-31", 77130.808), ("2022-01-31", 39274.998)]
    out = change.decumulate(obs(spark, rows), "ytd").orderBy("date").collect()
    assert [round(r["value"], 3) for r in out] == [25382.899, 23771.65, 27976.259, 39274.998]
    null_before = change.decumulate(obs(spark, [("2021-01-31", 1.0), ("2021-02-28", None), ("2021-03-31", 5.0)]), "ytd").orderBy("date").collect()
    assert [r["value"] for r in null_before] == [1.0, None, None]


def test_a_gap_gives_no_change(spark):
    out = change.periodic(obs(spark, [("2021-01-31", 1.0), ("2021-02-28", 2.0), ("2021-04-30", 3.0)])).orderBy("date").collect()
    assert [r["mom_pct"] for r in out] == [None, 1.0, None]


def test_yearly_change(spark):
    out = change.by_frequency(obs(spark, [("2023-12-31", 266594.0), ("2024-12-31", 268359.0)], "Y")).orderBy("date").collect()[1]
    assert out["yoy_abs"] == 1765 and round(out["yoy_pct"], 9) == 0.006620554 and out["mom_pct"] is None


def test_mean_of_ratios(spark):
    mk = lambda values: spark.createDataFrame([(dt.date(2024, 1, k + 1), float(v)) for k, v in enumerate(values)], "date date, value double")
    daily = gold.ratio_daily(mk([2000, 2100, 1900]), mk([20, 25, 15]), "g", "s")
    assert round(gold.ratio_monthly(daily, ["g", "s"]).first()["ratio"], 4) == 103.5556


def test_robust_scores_see_both_spikes(spark):
    values = [100.0 + (k % 3) * 0.5 for k in range(18)] + [500.0, 250.0]
    rows = series(spark, values).withColumn("k", F.lit("a"))
    assert stats.anomalies(rows, ["k"], "value", "zscore").count() == 1
    assert {r["value"] for r in stats.anomalies(rows, ["k"], "value", "robust").collect()} == {500.0, 250.0}
    assert stats.anomalies(rows.limit(1), ["k"], "value").count() == 0


def test_lead_is_found(spark):
    import random

    rng = random.Random(3)
    a = [rng.random() for _ in range(40)]
    b = [0.0] * 3 + a[:-3]
    out = stats.lead_lag(stats.paired(series(spark, a), series(spark, b)), 5)
    best = out.where("is_best").first()
    assert best["lag"] == 3 and best["correlation"] > 0.99
    flat = stats.correlation(stats.paired(series(spark, [1.0] * 5), series(spark, a[:5]))).first()
    assert flat["correlation"] is None


def test_pairs_fall_back_to_months(spark):
    a = spark.createDataFrame([(day("2024-01-05"), 1.0), (day("2024-02-05"), 2.0)], "date date, value double")
    b = spark.createDataFrame([(day("2024-01-09"), 3.0), (day("2024-02-09"), 4.0)], "date date, value double")
    assert [r["grain"] for r in stats.paired(a, b).collect()] == ["M", "M"]


def test_elasticity_of_a_power_law(spark):
    x = [float(k) for k in range(1, 13)]
    out = stats.elasticity(series(spark, [v**1.5 for v in x]), series(spark, x)).first()
    assert round(out["elasticity"], 6) == 1.5 and out["elastic_class"] == "elastic"
    constant = stats.elasticity(series(spark, [2.0] * 6), series(spark, x[:6])).first()
    assert constant["r_squared"] == 0.0


def brute_turns(values, window, min_cycle):
    import numpy as np

    smooth = np.convolve(values, np.ones(window) / window, mode="same") if window > 1 and len(values) >= window else np.array(values)
    reach, found = max(2, min_cycle // 2), []
    for i in range(reach, len(values) - reach):
        near = [round(float(v), 9) for v in smooth[i - reach : i + reach + 1]]
        x = round(float(smooth[i]), 9)
        kind = "peak" if x == max(near) else "trough" if x == min(near) else None
        if kind is None or near.count(x) > 1:
            continue
        sign = 1 if kind == "peak" else -1
        if found and found[-1][1] == kind:
            if sign * values[i] > sign * values[found[-1][0]]:
                found[-1] = (i, kind)
        else:
            found.append((i, kind))
    return found


@pytest.mark.parametrize("window", [1, 2, 3, 4])
def test_turning_points_as_by_hand(spark, window):
    import random

    rng = random.Random(window)
    values = [round(rng.random() * 100, 1) for _ in range(60)]
    rows = series(spark, values).withColumns({"series_id": F.lit("s"), "dims": F.lit("{}")})
    got = [(r["i"], r["kind"]) for r in cycles.turning_points(rows, window).orderBy("i").collect()]
    assert got == brute_turns(values, window, 4)
    assert cycles.phases(rows.limit(5)).count() == 0


def test_health_of_a_sparse_yearly_series(spark):
    rows = [(f"{y}-12-31", 1.0) for y in (2002, 2005, 2010, 2015, 2020, 2024)]
    out = health.series_health(obs(spark, rows, "Y")).first()
    assert (out["expected"], out["missing"], out["missing_pct"], out["health_status"]) == (23, 17, 73.91, "WARNING")
    wide = spark.createDataFrame([(day("2024-01-31"), 1.0), (day("2024-02-29"), None), (day("2024-03-31"), None), (day("2024-04-30"), 2.0)], "date date, v double")
    half = health.column_health(wide, ["v"]).first()
    assert half["missing_pct"] == 50.0 and half["health_score"] <= 50


def test_wide_slices_equal_the_join_chain_and_refuse_repeats(spark):
    a = obs(spark, [("2024-01-31", 1.0), ("2024-02-29", 2.0)], dims='{"k":"a"}')
    b = obs(spark, [("2024-02-29", 3.0), ("2024-03-31", 4.0)], dims='{"k":"b"}')
    slices = {"a": gold.Slice("s", "k", "a"), "b": gold.Slice("s", "k", "b")}
    one = gold.wide(a.unionByName(b), slices).orderBy("date").collect()
    assert one == gold.wide_by_joins(a.unionByName(b), slices).orderBy("date").collect()
    with pytest.raises(Exception, match="more than one row"):
        gold.wide(a.unionByName(a), slices).collect()


def test_contracts_count_what_breaks_them(spark):
    bad = obs(spark, [("2024-01-31", 1.0), ("2024-01-31", 2.0)]).unionByName(obs(spark, [("2024-02-29", 1.0)], "X", dims="[1]"))
    got = {r["rule"]: r["n_rows"] for r in contracts.observation_violations(bad).collect() if r["n_rows"]}
    assert got == {"bad_freq": 1, "bad_dims": 1, "duplicate_key": 1}
    with pytest.raises(ContractError):
        contracts.enforce(contracts.observation_violations(bad), "x")
    with pytest.raises(ContractError, match="not_reviewed"):
        contracts.require_reviewed(meta(spark).withColumn("nature_reviewed", F.lit(False)), ["s"], "x")
    with pytest.raises(Exception, match="repeats"):
        contracts.join_unique(bad, bad.select("series_id", F.lit(1).alias("n")), ["series_id"]).collect()


def test_table_query_checks_its_request(spark):
    df = obs(spark, [("2024-01-31", 1.0)], dims='{"variable":"x"}')
    assert lookup.table_query(spark, df, ["value", "dimension"], {"variable": "x"}).first()["dimension"] == "x"
    for options, code in (({"start": "2024-01-01"}, "half_range"), ({"limit": 0}, "bad_limit"), ({"columns": ["a b"]}, "unknown_column")):
        with pytest.raises(ContractError, match=code):
            lookup.table_query(spark, df, **options)
    with pytest.raises(ContractError, match="unknown_table"):
        lookup.table_query(spark, "no_such_table")
    with pytest.raises(ContractError):
        lookup.read_only("select 1; drop table x")


def test_dims_are_sorted_objects(spark):
    row = spark.createDataFrame([('{"b":1,"a":"x"}',), ("[1]",), (None,), ("",)], "d string").select(D.canonical(F.col("d")).alias("d")).collect()
    assert [r["d"] for r in row] == ['{"a":"x","b":1}', "{}", "{}", "{}"]


def test_official_nature_needs_one_signal(spark):
    rows = spark.createDataFrame([("%", None), (None, "KÜMÜLATİF"), ("%", "KÜMÜLATİF"), ("TL", None)], "u string, a string")
    assert [r[0] for r in rows.select(NA.official_nature(F.col("u"), F.col("a"))).collect()] == ["rate", "flow", "unclassified", "unclassified"]


def test_empty_tables_give_empty_results(spark):
    none = obs(spark, [])
    assert align.monthly(none, meta(spark)).count() == 0
    assert change.periodic(none).count() == 0 and change.latest(none).count() == 0 and cycles.turning_points(none).count() == 0
    assert health.series_health(none).count() == 0 and change.cumulative_scan(none).count() == 0
