"""Ranks, running sums, group medians, rules, code trees, the gold graph and lineage, against plain Python."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codes, nature, registry
from tidemark.operators import concentration, gold_graph, grounding, lineage, ranges, search, stats
from tidemark.schema import ContractError
from tidemark.sources import readers


def test_ranks_and_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(f"e{i}", float(rng.randrange(40))) for i in range(900)]
    df = spark.createDataFrame(rows, "entity string, value double").where("value > 0")
    got = sorted((r["rank"], r["entity"], round(r["share_pct"], 6), round(r["cumulative_pct"], 6)) for r in concentration.ranked(df).collect())
    want, total, upto = [], sum(v for _, v in rows), 0.0
    for k, (e, v) in enumerate(sorted((r for r in rows if r[1] > 0), key=lambda r: (-r[1], r[0])), 1):
        upto += v
        want.append((k, e, round(v / total * 100, 6), round(upto / total * 100, 6)))
    assert got == want


def test_no_task_ranks_all_rows(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("entity"), F.rand(3).alias("value"))
    out = concentration.ranked(df)
    plan = out._jdf.queryExecution().toString()
    windows = [line for line in plan.split("\n") if "Window [row_number()" in line]
    assert windows and all("_part" in line for line in windows)


@pytest.mark.parametrize("few", [4096, 8])
def test_medians_of_hot_groups(spark, few):
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 10.0 ** rng.randrange(-300, 300), 5.0])) for _ in range(6001)]
    rows += [("same", 3.0)] * 2500 + [(None, float(i)) for i in range(1500)] + [("two", 1.0), ("two", 4.0), ("one", 7.0), ("gap", None)]
    rows += [("odd", float(i % 7)) for i in range(1001)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    hot = df.groupBy("k").agg(F.count("*").alias("n")).where("n > 1000")
    got = {r["k"]: r["m"] for r in ranges.medians(df, ["k"], "v", "m", hot, few).collect()}
    assert got == {k: statistics.median([v for x, v in rows if x == k and v is not None]) for k in ("hot", "same", None, "two", "one", "odd")}
    assert got == {r["k"]: r["m"] for r in ranges.medians(df, ["k"], "v", "m").collect()}


def test_anomalies_are_the_same_whether_groups_are_hot(spark):
    rng = random.Random(4)
    day = dt.date(2024, 1, 1)
    rows = [(rng.choice(["big"] * 8 + ["a", "b"]), day + dt.timedelta(i), rng.gauss(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, date date, mom_pct double")
    for method in ("robust", "zscore"):
        one, two = ([(r["k"], r["rank"], r["date"], round(r["z_score"], 9)) for r in stats.anomalies(df, ["k"], method=method, small=s).orderBy("k", "rank").collect()] for s in (10**6, 500))
        assert one == two and len(one) > 40


def test_joins_with_hot_groups(spark):
    rows = spark.createDataFrame([("x", i) for i in range(3000)] + [(None, 1), ("y", 2)], "k string, i int")
    groups = spark.createDataFrame([("x", "X"), (None, "N"), ("y", "Y"), ("z", "Z")], "k string, g string")
    hot = ranges.hot_groups(rows, ["k"], 100)
    assert [r["k"] for r in hot.collect()] == ["x"] and ranges.hot_groups(rows, ["k"], 5000) is None
    got = {r["g"]: r["n"] for r in ranges.with_groups(rows, groups, ["k"], hot).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"X": 3000, "N": 1, "Y": 1}


def test_a_long_messy_file_is_read_by_many_tasks(spark, tmp_path):
    lines = ["A report", "", "key;name;price"] + [f"{i};n{i};{i},5" for i in range(4000)]
    (tmp_path / "long.csv").write_text("\r\n".join(lines) + "\r\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        numbers = readers.ragged_lines(spark, f"file://{tmp_path}/long.csv")
        got = {r["line_no"]: r["line"] for r in numbers.collect()}
        rows = {r["row_no"]: r["cells"]["price"] for r in readers.ragged_csv(spark, f"file://{tmp_path}/long.csv").collect()}
        assert spark.read.text(f"file://{tmp_path}/long.csv", lineSep="\n").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {i: line for i, line in enumerate(lines) if line}
    assert rows == {i + 1: f"{i},5" for i in range(4000)}


# ------------------------------------------------------------------ rules and codes


def test_shipped_rules(spark):
    rows = [
        ("EVDS:TP.APIFON1.IHA", "EVDS", "kredi_faiz_oranlari_stok", "none", "stock", "mean"), ("EVDS:TP.APIFON4", "EVDS", None, "none", "rate", None),
        ("EVDS:X", "EVDS", " doviz_kurlari ", "none", "price", None), ("EVDS:Y", "EVDS", "konut_fiyat_endeksi", "none", "stock", "mean"), ("EVDS:Z", "EVDS", "new", "none", "unclassified", None),
        ("BDDK_MONTHLY:kar_zarar:x", "BDDK_MONTHLY", "kar_zarar", "ytd", "stock", None), ("BDDK_MONTHLY:kar_zarar:x_periodic", "BDDK_MONTHLY", "kar_zarar", "none", "flow", None),
        ("BDDK_MONTHLY:bilanco:x_periodic", "BDDK_MONTHLY", "bilanco", "none", "flow", None), ("BDDK_MONTHLY:rasyolar:x", "BDDK_MONTHLY", "rasyolar", "none", "rate", None), ("BDDK_MONTHLY:bilanco:x", "BDDK_MONTHLY", "bilanco", None, "stock", None),
        ("BDDK_WEEKLY:any:x", "BDDK_WEEKLY", "any", "none", "stock", None), ("BDDK_FINTURK:t5:x", "BDDK_FINTURK", "t5", "none", "rate", None), ("BDDK_FINTURK:t1:x", "BDDK_FINTURK", "t1", "none", "stock", None),
        ("OTHER:x", "OTHER", "kar_zarar", "none", "unclassified", None), (None, None, None, None, "unclassified", None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "series_id string, source string, category string, accumulation string")
    got = nature.classified(df, registry.nature_rules(spark)).collect()
    assert {(r["series_id"], r["nature"], r["alignment_override"]) for r in got} == {(r[0], r[4], r[5]) for r in rows} and len(got) == len(rows)


def test_accumulation_registry(spark):
    known = f"{registry.MONTHLY}:kar_zarar:{registry.YTD_ITEMS[0]}"
    df = spark.createDataFrame([(known, "since_start"), ("X:1", "ytd"), (None, None)], "series_id string, accumulation string")
    got = {r["series_id"]: (r["accumulation"], r["is_cumulative"]) for r in nature.with_accumulation(df, registry.accumulation_registry(spark)).collect()}
    assert got == {known: ("ytd", True), "X:1": ("none", False), None: ("none", False)}
    with pytest.raises(Exception, match="unknown accumulation"):
        nature.with_accumulation(df, spark.createDataFrame([("X:1", "often")], "series_id string, accumulation string")).collect()
    with pytest.raises(Exception, match="several accumulations"):
        nature.with_accumulation(df, spark.createDataFrame([("X:1", "ytd"), ("X:1", "none")], "series_id string, accumulation string")).collect()


def test_attributes_with_a_default(spark):
    from tidemark.operators import lookup

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "series_id string, v int")
    table = spark.createDataFrame([("a", "stock"), ("a", "flow"), ("b", None), (None, "rate"), ("d", "x")], "series_id string, nature string")
    assert sorted((r["v"], r["nature"]) for r in lookup.with_attribute(rows, table, "nature", "unclassified").collect()) == [(1, "flow"), (2, "flow"), (3, "unclassified"), (4, "unclassified"), (5, "unclassified")]


def test_code_dims(spark):
    want = {
        "TP.KFE.TR41": '{"geo_level":"NUTS2","indicator":"price_index","market":"housing","region_code":"TR41","region_name":"Bursa, Eskişehir, Bilecik"}',
        "TP.KFE.TR": '{"geo_level":"NUTS0","indicator":"price_index","market":"housing","region_code":"TR","region_name":"Türkiye Geneli"}',
        "TP.KFE.TR41.X": "{}", "TP.KFE.TR99": "{}", "TP.KFE": "{}", "": "{}", "X": "{}",
        "TP.AKONUTSAT1.KTRTOPLAM": '{"indicator":"sales_volume","market":"housing","plate_code":"TR","province":"Türkiye","sales_type":"total"}',
        "TP.AKONUTSAT4.K421": '{"indicator":"sales_volume","market":"housing","plate_code":"41","province":"Kocaeli","sales_type":"second_hand"}',
        "TP.AKONUTSAT9.K777": '{"indicator":"sales_volume","market":"housing"}',
        "TP.BK.ISTANBUL1": '{"indicator":"rent","market":"housing","plate_code":"34","province":"İstanbul"}', "TP.YKKE.TR": '{"indicator":"rent","market":"housing","province":"Türkiye"}', "TP.BK": "{}",
        "TP.DK.JPYTL": '{"currency":"TRY"}', "TP.DK.USD.EUR": '{"currency":"USD"}',
        "TP.MK.CUM": '{"commodity":"gold","commodity_group":"precious_metals"}', "TP.MK.GUMUS": '{"commodity":"silver","commodity_group":"precious_metals"}',
    }
    df = spark.createDataFrame([(c,) for c in [*want, None]], "code string")
    assert {r["code"]: r["d"] for r in df.select("code", codes.code_dims(F.col("code")).alias("d")).collect()} == {**want, None: None}
    for code in ("TP.KFE.TR99", "TP.AKONUTSAT1.K777"):
        with pytest.raises(Exception, match="unknown place in code"):
            df.where(F.col("code").isin(code) | F.lit(False)).unionByName(spark.createDataFrame([(code,)], "code string")).select(codes.code_dims(F.col("code"), True)).collect()


# ------------------------------------------------------------------ the gold graph and lineage


def test_order_of_gold_tables():
    spec = lambda name, *inputs: gold_graph.Spec(name, inputs, lambda t: None)
    assert [s.name for s in gold_graph.ordered([spec("d", "b", "c"), spec("c", "a"), spec("b", "facts"), spec("a", "facts")], {"facts"})] == ["a", "b", "c", "d"]
    for specs, code in (([spec("a", "b"), spec("b", "a")], "cycle"), ([spec("a", "x")], "unknown_input"), ([spec("a"), spec("a")], "duplicate_table"), ([spec("facts")], "duplicate_table")):
        with pytest.raises(ContractError, match=code):
            gold_graph.ordered(specs, {"facts"})
    shipped = [s.name for s in gold_graph.ordered(gold_graph.shipped(), {"facts", "series", "aligned"})]
    assert len(shipped) == 8 and shipped.index("gold_precious_metal_ratios_daily") < shipped.index("gold_precious_metal_ratios_monthly") and shipped[-1] != "gold_periodic_change"


def test_a_failing_table_names_itself_and_publishes_nothing(spark, tmp_path):
    from tidemark.sources.publication import Log

    log = Log(spark, f"file://{tmp_path}/g")
    with log.begin() as load:
        load.write("facts", spark.createDataFrame([(1,)], "id int"), ["id"], 2)
    good = gold_graph.Spec("good", ("facts",), lambda t: t["facts"], ("id",))
    bad = gold_graph.Spec("late", ("good",), lambda t: t["good"].select(F.raise_error(F.lit("boom")).cast("int").alias("id")), ("id",))
    with pytest.raises(ContractError, match="late"):
        gold_graph.rebuild(log, [bad, good], 2)
    assert log.latest().number == 1 and set(log.latest().entries) == {"facts"}
    assert gold_graph.rebuild(log, [good], 2) == ["good"] and gold_graph.rebuild(log, [good], 2) == []
    assert gold_graph.rebuild(log, [gold_graph.Spec("good", ("facts",), lambda t: t["facts"], ("id",), version="2")], 2) == ["good"]


def test_lineage_over_levels_and_cycles(spark):
    pairs = [("g", "a"), ("g", "b"), ("a", "s1"), ("b", "a"), ("b", "s2"), ("s2", "f"), ("x", "y"), ("y", "x"), ("g", "a"), (None, "s1"), ("z", None)]
    df = spark.createDataFrame(pairs, "node string, source string")
    got = {(r["node"], r["source"]): r["steps"] for r in lineage.ancestors(df).collect()}
    assert got == {("g", "a"): 1, ("g", "b"): 1, ("g", "s1"): 2, ("g", "s2"): 2, ("g", "f"): 3, ("a", "s1"): 1, ("b", "a"): 1, ("b", "s1"): 2, ("b", "s2"): 1, ("b", "f"): 2, ("s2", "f"): 1, ("x", "y"): 1, ("y", "x"): 1, ("x", "x"): 2, ("y", "y"): 2}
    scores = spark.createDataFrame([("s1", 80.0), ("other", 0.0)], "source string, health_score double")
    graded = {r["node"]: (r["n_sources"], r["n_unknown"], r["worst_source"], r["health_score"], r["health_status"]) for r in lineage.health_by_lineage(df, scores).collect()}
    assert graded["a"] == (1, 0, "s1", 80.0, "GOOD") and graded["g"] == (2, 1, "f", 0.0, "WARNING") and "x" not in graded
    with pytest.raises(RuntimeError, match="levels"):
        lineage.ancestors(df, 1)


# ------------------------------------------------------------------ search and grounding


def test_nearest_rows_with_ties_and_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(k, v) for k in range(3000, 0, -1)] + [(5000, None), (5001, [0.0, 0.0, 0.0]), (5002, [1.0, None, 3.0]), (5003, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(5)
    assert [r["id"] for r in search.cosine_top(df, v, 4, 0.5).collect()] == [1, 2, 3, 4]
    lengths = df.withColumn("norm", F.when(F.col("id") < 5000, 14.0**0.5).otherwise(0.0))
    assert [round(r["similarity"], 6) for r in search.cosine_top(lengths, v, 2, 0.5, norm="norm").collect()] == [1.0, 1.0]
    near = search.cosine_top_each(df, df.where("id in (2, 5000, 5001, 5003)"), "id", "q", 3).orderBy("q", "rank").collect()
    assert [(r["q"], r["id"], r["rank"]) for r in near] == [(2, 1, 1), (2, 3, 2), (2, 4, 3), (5003, 1, 1), (5003, 2, 2), (5003, 3, 3)]
    assert search.cosine_top_each(df, df.limit(0), "id", "q").count() == 0


def test_numbers_and_dates_of_answers(spark):
    one = lambda fn, text: spark.createDataFrame([(text,)], "v string").select(fn(F.col("v"))).first()[0]
    runs = {"1.234,56": ["1.234,56"], "1234": ["1234"], "1.2.3": ["1.2", "3"], "1.234.5678": ["1.234.5678"], "1.2345": ["1.2345"], "12.345.678": ["12.345.678"], "1..2": ["1", "2"], ".5": ["5"], "7,": ["7"], "1234.567": ["1234.567"], "1,5,250": ["1,5", "250"], ".,": []}
    for run, want in runs.items():
        assert one(grounding.numbers_of, run) == want, run
    dates = {"on 2024-03-31.": "on  .", "2024-03": " ", "31.03.2024-30.04.2024": " - ", "1.2.2024-03.04.2025-6.7.2026": " - - ", "2024-03-31.03.2024": " .03.2024", "1/2/2024x": "1/2/2024x", "a2024-03": "a2024-03", "12024-03": "12024-03", "2024-03-311": " -311", "5.3.24": "5.3.24", "no": "no", "2024-3-1, 2024-4": " ,  "}
    for text, want in dates.items():
        assert one(grounding.without_dates, text) == want, text
    answers = {"KTR100 and Qwen3-27B": [], "10-20 and -30": ["20", "-30"], "x_55 55": ["55"], "12.5.30x": ["12.5"], "-5.5-40": ["-5.5", "40"], "1999 3 12 13 2101": ["13", "2101"]}
    for text, want in answers.items():
        assert one(grounding.answer_numbers, text) == want, text


def test_answers_without_a_key_meet_evidence_without_one(spark):
    answers = spark.createDataFrame([(None, "it is 77.5"), (1, "it is 77.5")], "id int, text string")
    evidence = spark.createDataFrame([(None, "tool", "77.5"), (2, "tool", "77.5")], "id int, source string, text string")
    assert {r["id"]: r["ratio"] for r in grounding.audit(answers, evidence, "id").collect()} == {None: 1.0, 1: 0.0}
