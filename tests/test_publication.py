"""Published sets: what readers see after loads that succeed, fail at any step, overtake each other or are compacted."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, contracts, lakehouse
from tidemark.schema import ContractError
from tidemark.sources import sinks
from tidemark.sources.publication import Log
from tidemark.streaming import jobs

OBS = "series_id string, source string, date date, period_start date, period_end date, value double, freq string, unit string, dims string, source_file string"
META = "series_id string, nature string, accumulation string, nature_reviewed boolean, alignment_override string, is_cumulative boolean, name string"


def facts(spark, values):
    """Observations of {series: [values of months]}."""
    ends = [dt.date(2024, m, 28 if m == 2 else 30 if m in (4, 6) else 31) for m in range(1, 7)]
    return spark.createDataFrame([(s, "S", d, d.replace(day=1), d, v, "M", "tl", "{}", "f") for s, vs in values.items() for d, v in zip(ends, vs)], OBS)


def meta(spark, ids, nature="flow"):
    return spark.createDataFrame([(i, nature, "none", nature != "unclassified", None, False, i) for i in ids], META)


@pytest.fixture
def log(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/lake")
    obs, series = facts(spark, {"a": [1.0, 2.0], "b": [5.0], "c": [7.0, 8.0, 9.0]}), meta(spark, "abc")
    lakehouse.create_lakehouse(log, obs, series, align.monthly(obs, series), lakehouse.embed_catalog(series, obs).select("series_id", "semantic_text", "embedding"), 4)
    return log


def seen(log):
    now = log.latest()
    sums = lambda t: {r["series_id"]: r["v"] for r in now.read(t).groupBy("series_id").agg(F.sum("value").alias("v")).collect()}
    return now.number, sums("facts"), sums("aligned"), sorted(r["series_id"] for r in now.read("series").collect()), sorted(r["series_id"] for r in now.read("embeddings").collect())


def test_several_series_in_one_load(spark, log):
    got = lakehouse.load_published(log, facts(spark, {"a": [10.0], "d": [4.0, None, float("nan")]}), meta(spark, "ad"))
    assert {(r["series_id"], r["status"], r["n_obs"], r["last_value"]) for r in got.collect()} == {("a", "loaded", 1, 10.0), ("d", "loaded", 3, 4.0)}
    assert seen(log) == (2, {"a": 10.0, "b": 5.0, "c": 24.0, "d": 4.0}, {"a": 10.0, "b": 5.0, "c": 24.0, "d": 4.0}, list("abcd"), list("abcd"))


@pytest.mark.parametrize("table, before", [("facts", True), ("series", False), ("aligned", True), ("embeddings", False)])
def test_a_failure_at_any_step_leaves_the_old_set(spark, log, monkeypatch, table, before):
    from tidemark.sources.publication import Load

    old, plain = seen(log), Load.replace

    def failing(self, name, *args):
        if name == table and before:
            raise RuntimeError("lost")
        plain(self, name, *args)
        if name == table:
            raise RuntimeError("lost")

    monkeypatch.setattr(Load, "replace", failing)
    with pytest.raises(RuntimeError, match="lost"):
        lakehouse.load_published(log, facts(spark, {"a": [0.0], "e": [1.0]}), meta(spark, "ae"))
    monkeypatch.undo()
    assert seen(log) == old and not [f for t in ("facts", "aligned") for f in log.files.listed(f"{log.root}/tables/{t}")[1:]]


def test_a_lost_pointer_write_leaves_the_old_set(spark, log, monkeypatch):
    old = seen(log)
    monkeypatch.setattr(type(log.files), "create", lambda *a: (_ for _ in ()).throw(OSError("store is gone")))
    with pytest.raises(OSError):
        lakehouse.load_published(log, facts(spark, {"a": [0.0]}), meta(spark, "a"))
    monkeypatch.undo()
    assert seen(log) == old


def test_unclassified_series(spark, log):
    with pytest.raises(ContractError, match="unclassified"):
        lakehouse.load_published(log, facts(spark, {"a": [3.0]}), meta(spark, "a", "unclassified"))
    got = lakehouse.load_published(log, facts(spark, {"a": [3.0]}), meta(spark, "a", "unclassified"), "live").first()
    assert got["status"] == "pending_review"
    assert seen(log) == (2, {"a": 3.0, "b": 5.0, "c": 24.0}, {"b": 5.0, "c": 24.0}, list("abc"), list("abc"))
    for obs, code in ((facts(spark, {"x": [1.0]}), "coverage"), (facts(spark, {"a": [1.0]}).withColumn("unit", F.lit(" ")), "contract_violated")):
        with pytest.raises(ContractError, match=code):
            lakehouse.load_published(log, obs, meta(spark, "a"))
    assert seen(log)[0] == 2


def test_two_loads_from_one_set(spark, log):
    first, second = log.begin(), log.begin()
    first.replace("facts", facts(spark, {"a": [50.0]}))
    second.replace("facts", facts(spark, {"b": [60.0]}))
    first.publish()
    with pytest.raises(ContractError, match="conflict"):
        second.publish()
    assert seen(log)[:2] == (2, {"a": 50.0, "b": 5.0, "c": 24.0})
    assert not log.files.create(f"{log.root}/_log/{1:012d}.json", "{}") and log.at(1).read("facts").count() == 6  # no pointer is ever replaced


def test_a_reader_keeps_its_set_and_vacuum_spares_it(spark, log):
    old = log.latest()
    for v in (1.0, 2.0, 3.0):
        with log.begin() as load:
            load.write("facts", facts(spark, {"a": [v]}), ["series_id"], 4)
    assert old.read("facts").count() == 6 and log.vacuum(4, 0.0) == 0
    with pytest.raises(RuntimeError):
        with log.begin() as load:
            load.write("facts", facts(spark, {"a": [9.0]}), ["series_id"], 4)
            load.made.clear()  # as if the driver died here
            raise RuntimeError
    assert log.vacuum(1, 3600.0) == 0 and log.vacuum(1, -1.0) == 4  # the first set's facts, two more, and the dead load's
    assert log.latest().read("facts").first()["value"] == 3.0


def test_a_small_delta_rewrites_its_buckets_alone(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/m")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    with log.begin() as load:
        load.write("t", rows, ["k"], 16)
    before = log.latest().entry("t").folders
    delta = spark.createDataFrame([(5, "nine", 9), (5, "ten", 10), (5, "two", 2), (2000, "new", None)], "k long, v string, seq int")
    with log.begin() as load:
        load.merge("t", delta, ["k"], "seq")
        with pytest.raises(ContractError, match="bad_keys"):
            load.merge("t", delta, ["v"])
    after = log.latest().entry("t").folders
    touched = {b for b in after if after[b] != before.get(b)}
    assert len(before) == 16 and 1 <= len(touched) <= 2 and {b: p for b, p in after.items() if b not in touched} == {b: p for b, p in before.items() if b not in touched}
    got = {r["k"]: r["v"] for r in log.latest().read("t").collect()}
    assert len(got) == 1001 and got[5] == "ten" and got[2000] == "new" and got[7] == "old"


def test_empty_tables_and_empty_deltas(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/e")
    none = spark.createDataFrame([], "k long, v string")
    with log.begin() as load:
        load.write("t", none, ["k"], 4)
    assert log.latest().read("t").count() == 0 and log.latest().read("t").columns == ["k", "v"]
    with log.begin() as load:
        load.merge("t", none, ["k"])
        load.replace("t", spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string"))
    assert sorted((r["k"] or 0, r["v"]) for r in log.latest().read("t").collect()) == [(0, "y"), (1, "x")]
    with log.begin() as load:
        load.replace("t", none, spark.createDataFrame([(1,)], "k long"))
        load.audit("t", lambda rows: contracts.duplicate_keys(rows, ["k"]).select(F.lit("twice").alias("rule"), F.col("n_rows")))
    assert [r["v"] for r in log.latest().read("t").collect()] == ["y"]
    number = log.latest().number
    with log.begin():
        pass
    assert log.latest().number == number
    with pytest.raises(ContractError, match="unknown_table"):
        log.latest().read("other")


def test_orders_settle_by_their_type(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "nine", 9), (1, "ten", 10), (2, "null", None), (2, "minus", -5)], "k int, v string, seq int")
    assert {r["k"]: r["v"] for r in sinks.merge_last(old, new, ["k"], "seq").collect()} == {1: "ten", 2: "minus"}
    assert {r["k"]: r["v"] for r in sinks.merge_last(old, new.drop("seq"), ["k"]).where("k = 1").collect()}[1] in ("nine", "ten")


def test_batches_are_folded_into_a_base(spark, tmp_path):
    source, sink = tmp_path / "in", f"file://{tmp_path}/out"
    for b in range(7):
        spark.createDataFrame([(k, b, f"{b}") for k in range(b, b + 4)], "k int, t int, v string").coalesce(1).write.mode("append").parquet(f"file://{source}")
    stream = jobs.file_stream(spark, f"file://{source}", "k int, t int, v string", 1)
    jobs.upsert_to_end(stream, sink, f"file://{tmp_path}/progress", ["k"], "t", 3)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert names == ["base=2", "base=5", "batch=3", "batch=4", "batch=5", "batch=6"]
    want = {k: max(b for b in range(7) if b <= k < b + 4) for k in range(10)}
    read = lambda: {r["k"]: r["t"] for r in jobs.newest(spark, sink, ["k"], "t").collect()}
    assert read() == want
    jobs.compact(spark, sink, ["k"], "t", 5)  # the batch is run again
    assert read() == want


def test_a_compaction_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    sink = f"file://{tmp_path}/out"
    for b in range(4):
        spark.createDataFrame([(k, b) for k in range(b, b + 2)], "k int, t int").write.parquet(f"{sink}/batch={b}")
    read = lambda: {r["k"]: r["t"] for r in jobs.newest(spark, sink, ["k"], "t").collect()}
    want = read()
    (tmp_path / "out" / "_making-dead").mkdir()  # died before the rename
    assert read() == want == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
    jobs.compact(spark, sink, ["k"], "t", 2)
    spark.createDataFrame([(0, 99)], "k int, t int").write.mode("overwrite").parquet(f"{sink}/batch=1")  # died after it: the base holds batch 1 as it was
    assert read() == want and not (tmp_path / "out" / "_making-dead").exists()
