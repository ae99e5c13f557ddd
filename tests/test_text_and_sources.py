"""Parsers, readers, sinks, text audits and streams on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as T
from tidemark.functions import numbers as N
from tidemark.functions import text as TX
from tidemark.operators import grounding, lakehouse, search
from tidemark.schema import ContractError
from tidemark.sources import catalog, html, readers, sinks


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(fn(F.col("v"))).collect()]


def test_turkish_numbers(spark):
    texts = ["1.234.567,89", "334.521,04", "12,5%", "-", None, "1.5", "1.234.567", " 7 ", "x", "n.a."]
    assert column(spark, texts, N.tr_number) == [1234567.89, 334521.04, 12.5, None, None, 1.5, 1234567.0, 7.0, None, None]
    assert column(spark, ["1.5", "1.234,5"], lambda c: N.tr_number(c, "strict")) == [15.0, 1234.5]
    assert column(spark, ["1,5", "ND", "nan", "3"], N.source_number) == [1.5, None, None, 3.0]


def test_a_column_decides_what_a_dot_means(spark):
    rows = [("2024-01", "1.250"), ("2024-02", "1.300"), ("2024-03", "1.400"), ("2024-03", "1.450")]
    out = readers.inline_series(spark.createDataFrame(rows, "Tarih string, Kapanis string"), with_change=True).collect()
    assert [(r["date"], r["value"]) for r in out] == [(dt.date(2024, 1, 31), 1250.0), (dt.date(2024, 2, 29), 1300.0), (dt.date(2024, 3, 31), 1450.0)]
    assert round(out[1]["mom_pct_change"], 6) == 4.0
    with pytest.raises(ContractError, match="too_few_rows"):
        readers.inline_series(spark.createDataFrame([("x", "y")] * 4, "date string, value string"))


def test_dates(spark):
    got = column(spark, ["04-01-2021", "2021-1", "2021-Q2", "2021", "2021-13", "x", None], T.parse_source_date)
    assert got == [dt.date(2021, 1, 4), dt.date(2021, 1, 1), dt.date(2021, 4, 1), dt.date(2021, 1, 1), None, None, None]
    got = column(spark, ["2024-02", "2024-03-31T10:00", "31.03.2024", "31/03/2024 10:00", "31.13.2024"], T.parse_inline_date)
    assert got == [dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 3, 31), dt.date(2024, 3, 31), None]
    assert column(spark, ["Rapor 8 Ocak 2021 tarihli", "1 AĞUSTOS 2020", "x"], T.parse_month_name_date) == [dt.date(2021, 1, 8), dt.date(2020, 8, 1), None]
    friday = column(spark, [dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 8)], T.business_friday, "date")
    assert friday == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 12)]


def test_slugs_and_frequencies(spark):
    assert column(spark, ["Kredi Kartları (İhtiyaç)", "  ", None, "IŞIK"], lambda c: TX.slug(c, "genel")) == ["kredi_kartlari_ihtiyac", "genel", "genel", "isik"]
    assert column(spark, ["3 AYLIK", "Aylık", "HAFTALIK(CUMA)", "Günlük", "Yıllık", "?", None], TX.frequency) == ["Q", "M", "W", "D", "Y", "D", "D"]
    assert column(spark, ["Toplam (milyon TL)", "Oran (%)", "x"], TX.unit_from_header) == ["milyon_tl", "yuzde", None]
    assert column(spark, ["<|im_start|>hi <attached_document x> [inst]"], TX.clean_input) == ["hi"]


def test_numbers_in_answers(spark):
    text = "In 2024 TP.AB.B1 and Qwen3-27B: 1.234,5 then -3,5 of 10-20; on 2024-03-31 step 7, KTR100, 42,1%"
    assert column(spark, [text], grounding.answer_numbers) == [["1.234,5", "-3,5", "20", "42,1"]]
    assert column(spark, ["1.234", "1,234.5", "-42,1", "7"], grounding.readings) == [[1.234, 1234.0], [1234.5], [42.1], [7.0]]


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "rose to 42,3 and 999"), (2, "no numbers"), (3, None)], "id int, text string")
    evidence = spark.createDataFrame([(1, "tool", "42.1"), (1, "document", "17 42.5"), (2, "tool", "5")], "id int, source string, text string")
    got = {r["id"]: r for r in grounding.audit(answers, evidence, "id").collect()}
    assert (got[1]["checked"], got[1]["grounded"], got[1]["ungrounded"], got[1]["ratio"]) == (2, 1, ["999"], 0.5)
    assert got[2]["ratio"] == 1.0 and got[3]["checked"] == 0
    assert [(x["source"], x["n"]) for x in got[1]["by_source"]] == [("tool", 1)]  # found in both: the tool is credited


def test_messy_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("A report\n\nkey;name;price\n1;x;1.234,5\n2;y;7\n")
    (tmp_path / "b.csv").write_text("key,name\n1,z\n")
    got = {(r["file"][-5:], r["row_no"]): dict(r["cells"]) for r in readers.ragged_csv(spark, str(tmp_path)).collect()}
    assert got[("a.csv", 1)] == {"key": "1", "name": "x", "price": "1.234,5"} and got[("b.csv", 1)] == {"key": "1", "name": "z"}
    assert len(got) == 3


def test_series_json_and_yearly_csv(spark, tmp_path):
    (tmp_path / "TP.A.B.json").write_text(json.dumps([{"Tarih": "2021-1", "TP_A_B": "16.49", "UNIXTIME": {"n": 1}}, {"Tarih": "2021-2", "TP_A_B": "ND"}]))
    (tmp_path / "TP.C.json").write_text(json.dumps([{"Tarih": "2021", "OTHER": "5"}]))
    got = {(r["code"], r["date"]): r["value"] for r in readers.series_json(spark, str(tmp_path)).collect()}
    assert got == {("TP.A.B", dt.date(2021, 1, 1)): 16.49, ("TP.A.B", dt.date(2021, 2, 1)): None, ("TP.C", dt.date(2021, 1, 1)): 5.0}
    good, bad = tmp_path / "beds.csv", tmp_path / "twice.csv"
    good.write_text("year,total\n2023,266594\n2024,268359\n")
    bad.write_text("year,total\n2023,1\n2023,2\n")
    assert readers.annual_csv(spark, str(good), "H:beds", "H", "beds").orderBy("date").collect()[1]["date"] == dt.date(2024, 12, 31)
    with pytest.raises(ContractError, match="duplicate_year"):
        readers.annual_csv(spark, str(bad), "H:beds", "H", "beds")


def test_discovery_rejects_half_pairs(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "f"))
    spark.range(2).write.parquet(str(tmp_path / "s"))
    facts, series = readers.discover(spark, {"a": (str(tmp_path / "f"), str(tmp_path / "s"))}, ["id"], ["id"])
    assert facts.count() == series.count() == 2
    with pytest.raises(ContractError, match="half_pair"):
        readers.discover(spark, {"a": (str(tmp_path / "f"), None)}, ["id"], ["id"])


def test_sinks_keep_what_they_should(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "series_id string, t int, value double")
    new = spark.createDataFrame([("a", 2, 9.0), ("c", 1, 4.0)], "series_id string, t int, value double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sinks.merge_last(old, new, ["series_id", "t"])) == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 3.0), ("c", 1, 4.0)]
    assert rows(sinks.replace_series(old, new)) == [("a", 2, 9.0), ("b", 1, 3.0), ("c", 1, 4.0)]
    path = sinks.write_sorted(old, str(tmp_path / "t"), ["series_id"], 2)
    assert rows(spark.read.parquet(path)) == rows(old)
    facts, series = sinks.upsert_both(spark, path, path, new, new, str(tmp_path / "u"))
    assert rows(spark.read.parquet(facts)) == rows(spark.read.parquet(series)) == [("a", 2, 9.0), ("b", 1, 3.0), ("c", 1, 4.0)]
    assert rows(spark.read.parquet(path)) == rows(old)


def test_pages(spark):
    page = '<html><head><title> A  b </title><script>x</script></head><body><nav>menu</nav><p>Hello &amp; bye</p><a href="/f.pdf">the file</a><img src="logo.png" alt="logo"><img src="c.png" alt="chart"></body></html>'
    pages = spark.createDataFrame([(1, "http://h.example/a/", page), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.page_text(pages).collect()}
    assert (got[1]["title"], got[1]["text"], got[1]["is_shell"]) == ("A b", "Hello & bye the file", True) and got[2]["text"] == ""
    link = html.page_links(pages, documents_only=True).first()
    assert (link["target"], link["label"]) == ("http://h.example/f.pdf", "the file")
    assert [r["label"] for r in html.page_images(pages).collect()] == ["chart"]


def test_page_text_is_its_sql_where_references_are_cut(spark, tmp_path):
    import duckdb

    from tidemark.plans.all_queries import ORACLES, QUERIES

    cut = ["a &amp; b &amp", "x = &quot", "&am", "&#x2", "R&D &ampx; &copy;", "&amp;lt &lt;b&gt"]
    rows = [(k, "http://h.example/", f"<html><head><title>{c}</title></head><body><h1>{c}</h1><p>{c}</p></body></html>") for k, c in enumerate(cut)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["html_text"]).fetchall()
    got = QUERIES["html_text"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert html.page_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string")).first()["title"] == "a & b &"


def test_silver_refuses_orphans_and_unknown_units(spark):
    cols = "year int, month int, category string, row_index int, item string, variable string, value_raw string, value double, source_file string"
    rows = [(2024, 1, "Cat", 1, "a) Child", "TL", "1,5", None, "f")]
    with pytest.raises(Exception, match="no parent"):
        lakehouse.monthly_silver(spark.createDataFrame(rows, cols), "M", {"Cat": "tl"}).collect()
    rows = [(2024, 1, "Cat", 1, "Root", "TL", "1,5", None, "f")]
    with pytest.raises(Exception, match="no unit"):
        lakehouse.monthly_silver(spark.createDataFrame(rows, cols), "M", {}).collect()
    assert lakehouse.monthly_silver(spark.createDataFrame(rows, cols), "M", {"Cat": "tl"}).first()["value"] == 1.5


def test_provinces_and_status_of_loads(spark):
    assert lakehouse.provinces(spark).where("city = 'İSTANBUL'").first()["plate_code"] == "34" and len(lakehouse.PROVINCES) == 81
    obs = spark.createDataFrame([("x", "S", dt.date(2024, 1, 31), 1.0, "M", "u", "{}")], "series_id string, source string, date date, value double, freq string, unit string, dims string")
    meta = spark.createDataFrame([("x", "unclassified", "none", None, False)], "series_id string, nature string, accumulation string, alignment_override string, nature_reviewed boolean")
    layers = {"facts": obs.limit(0), "series": meta.limit(0), "aligned": None}
    out, status = lakehouse.load_series(obs, meta, layers, "live")
    assert status == "pending_review" and out["facts"].count() == 1 and out["aligned"] is None
    with pytest.raises(ContractError, match="unclassified"):
        lakehouse.load_series(obs, meta, layers)


def test_search_checks_vectors_and_catalog_names(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<float>")
    assert [r["id"] for r in search.cosine_top(rows, [1.0, 0.1], 5, 0.5).collect()] == [1]
    for query, code in (([0.0, 0.0], "zero_vector"), ([1.0], "dimension_mismatch")):
        with pytest.raises(ContractError, match=code):
            search.cosine_top(rows, query)
    with pytest.raises(ContractError, match="duplicate_table"):
        catalog.catalog_table(spark, [catalog.Entry("a", "x", None, ""), catalog.Entry("a", "y", None, "")])
    df = catalog.described(rows, {"id": "the key"}, {"id": "count"})
    assert df.schema["id"].metadata == {"comment": "the key", "unit": "count"}


def test_equal_orders_settle_alike(spark):
    """Of rows with equal keys and orders one stays, the same one wherever the rows stand."""
    from tidemark.sources import sinks

    rows = [(k % 3, 7, f"v{k}") for k in range(30)]
    kept = [{r["k"]: r["v"] for r in sinks.keep_last(spark.createDataFrame(x, "k int, at int, v string").repartition(n), ["k"], "at").collect()} for n, x in ((1, rows), (5, rows[::-1]))]
    assert kept[0] == kept[1] and len(kept[0]) == 3
    old, new = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new", 1), (2, "newer", 2)], "k int, v string, seq int")
    assert {r["k"]: r["v"] for r in sinks.merge_last(old, new, ["k"], "seq").collect()} == {1: "old", 2: "newer"}


def test_rows_later_than_the_lateness_are_dropped_and_only_with_one(spark, tmp_path):
    import time

    from tidemark.streaming import jobs

    path = str(tmp_path / "in")
    for day in ("2001-06-01", "2001-06-02", "2001-01-01"):  # the last file is five months late; a batch drops by the watermark of the one before
        spark.createDataFrame([("a", 1.0)], "k string, v double").selectExpr("k", "v", f"timestamp'{day} 12:00:00' AS ts").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    schema = spark.read.parquet(path).schema
    for lateness, want in ((None, 3), ("10 days", 2)):
        sink = str(tmp_path / f"sink-{lateness}")
        jobs.align_to_end(jobs.daily_sums(jobs.file_stream(spark, path, schema, files_per_batch=1), "ts", ["k"], "v", lateness), sink, str(tmp_path / f"progress-{lateness}"))
        assert spark.read.parquet(sink).select("date").distinct().count() == want
