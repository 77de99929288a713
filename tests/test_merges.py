"""Golden vectors of merges, scores and event-time jobs; batch and stream give the same."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from tidemark.operators import scoring as sc
from tidemark.sources import merge as mg
from tidemark.streaming import jobs

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)


def series(spark, days, level, symbol="A"):
    return spark.createDataFrame([(symbol, day(i), *[level * (i + 1.0)] * 4, 10) for i in days], BAR)


def test_stitch_halved_overlap(spark):
    rows = mg.stitch(series(spark, range(5, 10), 1.0), series(spark, range(7), 0.5)).orderBy("ts").collect()
    assert [r.ts for r in rows] == [day(i) for i in range(10)] and [r.close for r in rows] == [i + 1.0 for i in range(10)]
    assert {r.factor for r in rows if r.adjusted} == {2.0} and sum(r.adjusted for r in rows) == 5


def test_stitch_equal_or_one_sided(spark):
    same = mg.stitch(series(spark, range(5, 10), 1.0), series(spark, range(7), 1.0)).collect()
    assert len(same) == 10 and all(r.factor is None for r in same)
    assert mg.stitch(series(spark, range(3), 1.0), series(spark, range(3), 9.0, "B")).count() == 6
    assert mg.stitch(series(spark, [], 1.0).limit(0), series(spark, range(3), 1.0)).count() == 3


def test_merge_cells(spark):
    rows = [("A", 20240, "x", 1.0, "p", 0), ("A", 20250, "x", None, "p", 0), ("A", 20240, "x", 9.0, "q", 1), ("A", 20250, "x", 2.0, "q", 1)]
    got = mg.merge_cells(spark.createDataFrame(rows, "symbol string, period_key int, item string, value double, source string, priority int"))
    assert sorted((r.period_key, r.value, r.source) for r in got.collect()) == [(20240, 1.0, "p"), (20250, 2.0, "q")]


def test_chart_json(spark):
    df = spark.createDataFrame([("A", '{"t":[1704067200,1704153600],"o":[1,2],"h":[1,2],"l":[1,2],"c":[1,null],"v":[5,6]}'), ("B", None), ("C", "x")], "symbol string, payload string")
    got = mg.chart_bars(df).collect()
    assert [(r.symbol, r.ts, r.close, r.volume) for r in got] == [("A", dt.datetime(2024, 1, 1), 1.0, 5)]


def test_scores(spark):
    df = spark.createDataFrame([(0.005, -0.05, None, None), (None, None, None, None)], "volatility double, max_drawdown double, beta double, debt_equity double")
    got = sc.risk_score(df).collect()
    assert (got[0].risk_score, got[0].risk_coverage) == (100, 60) and got[1].risk_score is None
    cols = [f"{g}_score" for g in sc.WEIGHTS]
    df = spark.createDataFrame([(80.0, 75.0, 85.0, 70.0, 90.0), (80.0, None, 85.0, None, 90.0), (None,) * 5], ", ".join(f"{c} double" for c in cols))
    got = sc.composite_score(df).collect()
    assert [r.coverage for r in got] == [100, 60, 0] and got[2].score is None and got[2].category is None and got[0].category == "positive"


def test_peer_medians_leave_out_outlier(spark):
    pe = {"A": 10.0, "B": 15.0, "C": 20.0, "D": 25.0, "E": 30.0, "F": 500.0}
    rows = [(s, "x", i, v, 1.0, 1.0, 1.0, None) for i, (s, v) in enumerate(pe.items())]
    df = spark.createDataFrame(rows, "symbol string, sector string, place int, pe double, pb double, roe double, net_margin double, debt_equity double")
    got = {r.symbol: r for r in sc.peer_medians(df).collect()}
    assert (got["A"].peer_pe, got["A"].n_pe, got["A"].peers) == (22.5, 4, 5) and got["A"].peer_debt_equity is None


def test_dcf_order(spark):
    r = sc.discounted_value(spark.createDataFrame([(6200.0,), (-1.0,)], "eps double"), growth=0.12, rate=0.11).collect()
    assert r[0].bull >= r[0].base >= r[0].bear and r[1].base is None


def test_portfolio(spark):
    held = spark.createDataFrame([("p", "A", 1000.0, 95000.0, 0.0015), ("p", "Z", 1.0, 1.0, 0.0)], "portfolio string, symbol string, quantity double, buy_price double, fee_pct double")
    got = {r.symbol: r for r in sc.positions(held, spark.createDataFrame([("A", 100000.0)], "symbol string, price double")).collect()}
    assert got["A"].cost_basis == 95142500 and got["A"].pnl == 4857500 and got["A"].weight == 100 and got["Z"].current_value == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), "AB"[i % 2], float(i) if i % 5 else None) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, symbol string, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (("bars", jobs.daily_bars), ("snapshots", lambda e: jobs.sliding_snapshots(e, 4)), ("sessions", lambda e: jobs.sessions(e, "10 hours"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "snapshots" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got, want = sorted(map(tuple, spark.table(name).collect())), sorted(map(tuple, f(batch).collect()))
        if name == "snapshots":  # windows that the watermark has closed: with two chained aggregates, those that ended two days before the last event's day
            want = [r for r in want if r[1] + dt.timedelta(days=4) <= rows[-1][1] - dt.timedelta(days=2)]
            got = [r for r in got if r[:2] in {w[:2] for w in want}]
        assert got == want and want, name
    q = jobs.land(jobs.first_by_id(stream, "event_id"), str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40 and spark.read.parquet(str(tmp_path / "log")).agg(F.sum("rows")).first()[0] == 40


def test_json_links_of_any_depth(spark):
    from tidemark.sources.nested import json_links

    deep = '{"a":[1,{"b":{"c":[[{"Title":"T","file":"/x/y.PDF?q=1"}]],"d":{"e":{"f":{"g":{"name":"N","url":"z/w"}}}}}}],"link":"//h/p","zurl":"no slash","none":null}'
    rows = [(1, deep, "https://s.vn/dir/page?x"), (2, "not json", "https://s.vn"), (3, '[{"url":"u/v","Title":"","Desc":"D"},{"url":5}]', "https://s.vn"), (4, None, "b"), (5, "7", "b")]
    got = {(r.doc, r.path): (r.title, r.url) for r in json_links(spark.createDataFrame(rows, "doc int, payload string, base string")).collect()}
    assert got == {
        (1, "$"): ("", "https://h/p"), (1, "$.a[1].b.c[0][0]"): ("T", "https://s.vn/x/y.PDF?q=1"), (1, "$.a[1].b.d.e.f.g"): ("N", "https://s.vn/dir/z/w"), (3, "$[0]"): ("D", "https://s.vn/u/v"),
    }


def test_providers_in_order(spark, tmp_path):
    from tidemark.sources import landed

    bars = lambda *c: '{"t":[%s],"o":[],"h":[],"l":[],"c":[%s],"v":[]}' % (",".join(str(86400 * i) for i in range(len(c))), ",".join(map(str, c)))
    rows = [("bars", "A", " fpt ", bars(1, 2), 1), ("bars", "A", "FPT", bars(3), 2), ("bars", "A", "VNI", "{}", 1), ("bars", "A", "MBB", "broken", 1), ("bars", "A", "VRE", None, 1)]
    rows += [("bars", "B", s, bars(9, 9, 9), 1) for s in ("FPT", "VN-INDEX", "MBB", "VRE")] + [("statements", "A", "FPT", "[]", 1)]
    root = str(tmp_path / "landed")
    landed.land(spark.createDataFrame(rows, "kind string, provider string, symbol string, payload string, fetched_at int"), root)
    got = {}
    for r in landed.scan(spark, root, "bars", ["A", "B", "C"]).collect():
        got.setdefault((r.symbol, r.source), []).append(r.close)
    assert got == {("FPT", "A"): [3.0], ("VNINDEX", "B"): [9.0] * 3, ("MBB", "B"): [9.0] * 3, ("VRE", "B"): [9.0] * 3}
    late = landed.prices(spark, root, ["A", "B"], F.lit("1970-01-03").cast("timestamp_ntz"), F.lit("1971-01-01").cast("timestamp_ntz"))
    assert {(r.symbol, r.source) for r in late.collect()} == {(s, "B") for s in ("FPT", "VNINDEX", "MBB", "VRE")}
    assert {r.provider: (r.available, r.symbols) for r in landed.health(spark, root, "bars", ["A", "B", "C"]).collect()} == {"A": (True, 1), "B": (True, 4), "C": (False, 0)}


def test_sheets(spark, tmp_path):
    from tidemark.sources import sheets

    cells = spark.createDataFrame([("A", 20243, "eps", 5.0, "x"), ("A", 20241, "revenue", 2e9, "x"), ("A", 20230, "revenue", 1e9, "y"), ("A", 20230, "cogs", None, "y"), ("A", 20230, "other", 1.0, "y")], "symbol string, period_key int, item string, value double, source string")
    registry = spark.createDataFrame([("revenue", "is", 1, "Revenue", False), ("cogs", "is", 2, "Costs", False), ("eps", "is", 3, "EPS", True)], "item string, statement string, ordinal int, label string, per_unit boolean")
    got = sheets.sheet(sheets.statement_rows(cells, registry)).orderBy("ordinal")
    assert got.columns == ["symbol", "statement", "ordinal", "label", "2023", "Q1/2024", "Q3/2024"]
    assert [tuple(r)[3:] for r in got.collect()] == [("Revenue", 1.0, 2.0, None), ("EPS", None, None, 5.0)]
    sheets.export(got, str(tmp_path / "csv"), "ordinal")
    assert [r.label for r in spark.read.option("header", True).csv(str(tmp_path / "csv" / "_by=A")).collect()] == ["Revenue", "EPS"]
    assert sheets.sheet(sheets.statement_rows(cells.where("false"), registry)).count() == 0
    assert [tuple(r)[3:] for r in sheets.sources_sheet(cells, registry).orderBy("ordinal").collect()] == [("Revenue", "y", "x", None), ("Costs", "y", None, None), ("EPS", None, None, "x")]


def test_fuzzy_lookups(spark):
    from tidemark.operators import fuzzy

    schema = "symbol string, row int, ids array<string>, period_key int, value double"
    rows = [("A", 1, ["pe_growth_x", None], 20240, 3.0), ("A", 2, ["P/E"], 20230, 12.0), ("A", 2, ["P/E"], 20240, 0.0), ("A", 3, ["Earnings per share (VND)"], 20240, 5.0), ("A", 4, ["eps_basic"], 20240, None), ("A", 5, ["cap"], 20240, 1.0), ("B", 1, ["type"], 20240, 7.0), ("B", 2, ["xx peers"], 20240, 8.0)]
    df = spark.createDataFrame(rows, schema)
    get = lambda *names, **k: {r.symbol: r.value for r in fuzzy.fuzzy_value(df, names, **k).collect()}
    assert get("pe_ratio", "p/e")["A"] == 3.0  # the first row that starts with it
    assert get("pe") == {"A": 3.0, "B": 7.0} and get("price earning", "earnings per share") == {"A": 5.0}
    assert get("eps") == {} and get("capital") == {} and fuzzy.fuzzy_value(df.where("row = 2"), ("pe",), nonzero=False).first().value == 0.0
    cell = lambda s, r, n, *v: [(s, r, [n], 20220 + 10 * i, x) for i, x in enumerate(v)]
    make = lambda x: spark.createDataFrame(x, schema)
    income = make(cell("A", 1, "Doanh thu thuần", 100.0, 120.0) + cell("A", 2, "Lợi nhuận sau thuế", 10.0, 5.0) + cell("A", 3, "Gross profit", 40.0, 50.0))
    balance = make(cell("A", 1, "Liabilities", 250.0) + cell("A", 2, "Equity", 100.0) + cell("A", 3, "Total assets", 350.0))
    r = fuzzy.raw_metrics(income, balance, make(cell("A", 1, "ROE (%)", 0.2) + cell("B", 1, "roa", 3.0)), make(cell("A", 1, "CFO", -4.0) + cell("A", 2, "Capex", -6.0))).where("symbol = 'A'").first()
    assert (r.roe, round(r.roa, 4), r.fcf, r.debt_to_equity, r.warnings) == (20.0, round(5 / 350 * 100, 4), -10.0, 2.5, "profit falls,high debt,cash outflow")


def test_strategies_of_users(spark):
    from tidemark.operators import extend

    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 3.0), ("A", dt.datetime(2024, 1, 2), 5.0)], "symbol string, ts timestamp_ntz, close double")
    got = extend.with_strategies(bars, {"high": lambda b: F.when(F.col("close") > 4, 7), "low": lambda b: F.when(F.col("close") < 4, -1).otherwise(0)})
    assert sorted((r.ts.day, r.strategy, r.signal) for r in got.collect()) == [(1, "high", 0), (1, "low", -1), (2, "high", 1), (2, "low", 0)]
    for bad in (lambda b: F.lit("buy"), lambda b: F.col("close"), lambda b: 1, lambda b: F.col("missing")):
        with pytest.raises(Exception):
            extend.with_strategies(bars, {"bad": bad})
    extend.register(spark)
    got.createOrReplaceTempView("signals_here")
    rows = spark.sql("SELECT strategy, h.* FROM signals_here, LATERAL held(to_date(ts), signal, 2) h ORDER BY ALL").collect()
    assert [(r[0], r[1].day, r[2]) for r in rows] == [("high", 2, 1), ("high", 3, 0), ("low", 1, 1), ("low", 2, 0)]


def test_column_names(spark):
    from tidemark.sources import ingest

    df = spark.createDataFrame([((1, 2), 3, 4)], "meta struct<a: int, b: int>, `2018` int, c int")
    twice = df.select("2018", "2018", "c", "2018")
    assert ingest.distinct_names(twice).columns == ["2018", "2018 (2)", "c", "2018 (3)"]
    assert ingest.flat_names(df).columns == ["meta a", "meta b", "2018", "c"] and ingest.flat_names(df).first()[:2] == (1, 2)


def test_listing_and_labels(spark, tmp_path):
    from tidemark.sources import ingest

    (tmp_path / "all.json").write_text('[{"symbol":"MBB","name":"MBBank","exchange":"HSX"},{"symbol":"VRE","name":"nan"}]')
    (tmp_path / "none.json").write_text("[]")
    few = [("FPT", "FPT Corp", "HSX")]
    got = mg.listing(spark, str(tmp_path / "all.json"), few)
    label = ingest.symbol_label(F.col("symbol"), F.col("name"), exchange=F.col("exchange"))
    assert {r[0] for r in got.select(label).collect()} == {"MBB - MBBank (HSX)", "VRE"}
    assert [r.symbol for r in mg.listing(spark, str(tmp_path / "none.json"), few).collect()] == ["FPT"]
    typed = spark.createDataFrame([("MBB - MBBank (HSX)",), ("  vre  ",), ("vre (HSX)",)], "t string")
    assert [r[0] for r in typed.select(ingest.label_symbol(F.col("t"))).collect()] == ["MBB", "VRE", "VRE"]


def test_hybrid_scan(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = lambda s, low, high, c: [(s, day(i), c, c, c, c, 1) for i in range(low, high)]
    near, far = spark.createDataFrame(rows("A", 0, 100, 10.0), BAR), spark.createDataFrame(rows("A", 0, 100, 5.0) + rows("B", 0, 100, 7.0), BAR)
    got = mg.hybrid(near, far, "2024-01-11", "2024-03-31", recent_days=30)
    a = sorted((r.ts, r.close, r.adjusted) for r in got.where("symbol = 'A'").collect())
    assert a[0] == (day(10), 10.0, True) and len(a) == 82 and sum(x[2] for x in a) == 50
    assert got.where("symbol = 'B'").agg(F.count("*"), F.min("ts"), F.max("ts"), F.max("close")).first()[:] == (81, day(10), day(90), 7.0)


def test_scan_takes_the_nearest_seconds(spark, tmp_path):
    """Bars of the last payload half a second before a day begins there: the day is that of the nearest second, as in SQL."""
    import duckdb

    from tidemark.queries.raw import ORACLE, QUERIES

    at = ["2024-01-05 16:59:59.700000", "2024-01-05 16:59:59.300000", "2024-01-05 16:59:59.500000", "2024-01-05 17:00:00.500000", "2024-01-04 16:59:59.900000"]
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', {i}, '{k}', {i}.25::DOUBLE)" for k in ("view", "purchase") for i, t in enumerate(at, 10 if k == "view" else 20))
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) e(event_id, ts, user_id, event_type, value)")
    db.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = QUERIES["SRC_01_05_scan"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT symbol, source, ts, close, volume FROM ({ORACLE['SRC_01_05_scan']})").fetchall())


def test_raw_metrics_sum_statements_up_once(spark):
    from tidemark.plans.bars import statements
    from tidemark.queries import raw

    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    x, sf = statements(spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001"
    assert scans(raw.named_cells(x, raw.INCOME)) == scans(raw.named_cells(x, raw.INCOME[:1]))  # as many rows as it has, one pass
    assert "lineitem" not in raw.QUERIES["FR_23_raw_metrics"](spark, sf)._jdf.queryExecution().executedPlan().toString()
