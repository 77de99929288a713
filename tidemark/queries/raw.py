"""Landed payloads, nested JSON, sheets, lookups by names alike and what users add, keyed by operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import desk, extend, fuzzy, statements as fr, technical as ta
from tidemark.plans.bars import STATEMENTS_SQL, statements, table, walk_bars
from tidemark.plans.store import kept, shared_folder
from tidemark.queries.books import PREPARED, RATIOS, YEARS, yearly
from tidemark.queries.market import BARS
from tidemark.queries.merges import payloads
from tidemark.sources import ingest, landed, merge, nested, sheets

QUERIES, ORACLE = {}, {}


def add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


def landed_events(s, d):
    """Payloads of two providers: A lacks views, has broken ones for clicks and names purchases otherwise; B has all events, twice as dear."""
    one = payloads(s, d, nearest=True).groupBy("symbol").agg(F.max("payload").alias("payload"))
    a = one.where("symbol <> 'view'").select(F.lit("A").alias("provider"), F.when(F.col("symbol") == "purchase", " buy ").otherwise(F.col("symbol")).alias("symbol"), F.when(F.col("symbol") == "click", "{broken").otherwise(F.col("payload")).alias("payload"))
    b = one.select(F.lit("B").alias("provider"), "symbol", "payload")
    root = shared_folder(s, "landed")
    landed.land(a.unionByName(b).withColumns({"kind": F.lit("bars"), "fetched_at": F.lit(1)}), root)
    return root


BUY = {"BUY": "PURCHASE"}
LAST_PAYLOAD = """WITH e AS (SELECT event_type, ts::DATE AS day, epoch(ts)::BIGINT AS t, value, event_id FROM events), g AS (SELECT event_type, day, min(event_id) AS first FROM e GROUP BY ALL),
 k AS (SELECT event_type, day FROM g JOIN (SELECT event_id, t FROM e) f ON f.event_id = g.first QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY t::VARCHAR DESC) = 1), l AS (SELECT e.* FROM e JOIN k USING (event_type, day))"""
add("SRC_01_05_scan", lambda s, d: landed.scan(s, landed_events(s, d), "bars", ["A", "B"], BUY).select("symbol", "source", "ts", F.round("close", 4).alias("close"), "volume"),
    f"{LAST_PAYLOAD} SELECT upper(event_type) AS symbol, CASE WHEN event_type IN ('view', 'click') THEN 'B' ELSE 'A' END AS source, date_trunc('day', make_timestamp(t * 1000000) + INTERVAL 7 HOUR) AS ts, round(value, 4) AS close, event_id AS volume FROM l")
add("SRC_01_health", lambda s, d: landed.health(s, landed_events(s, d), "bars", ["A", "B", "C"]).select("provider", "available", F.col("symbols").cast("long").alias("symbols")),
    "SELECT * FROM (VALUES ('A', true, (SELECT count(DISTINCT event_type) FROM events WHERE event_type NOT IN ('view', 'click'))), ('B', true, (SELECT count(DISTINCT event_type) FROM events)), ('C', false, 0)) v(provider, available, symbols)")


def nested_pages(s, d):
    """Pages as JSON of six levels: a document in a list of lists, an address beside it and one at the top."""
    k = F.col("page_id").cast("string")
    doc = F.struct(F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("T"), k)).alias("Title"), F.concat(F.lit("/files/"), k, F.lit(".pdf?v=1")).alias("at"))
    other = F.struct(F.struct(F.concat(F.lit("more/"), k).alias("Link"), F.concat(F.lit("N"), k).alias("name")).alias("inner"), F.lit("a/b").alias("text"))
    body = F.struct(F.struct(F.array(F.array(doc)).alias("docs"), other.alias("other")).alias("content"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//cdn/"), k)).alias("url"))
    return table(s, d, "pages").select(F.col("page_id").alias("doc"), F.lit("https://site.example/dir/index").alias("base"), F.to_json(body).alias("payload"))


add("SRC_11_json_links", lambda s, d: nested.json_links(nested_pages(s, d)),
    """SELECT page_id AS doc, '$' AS path, '' AS title, 'https://cdn/' || page_id AS url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '$.content.docs[0][0]', CASE WHEN page_id % 3 > 0 THEN 'T' || page_id ELSE '' END, 'https://site.example/files/' || page_id || '.pdf?v=1' FROM pages
 UNION ALL SELECT page_id, '$.content.other.inner', 'N' || page_id, 'https://site.example/dir/more/' || page_id FROM pages""")

ITEMS = (("revenue", "is", 1, "Revenue", False), ("net_income", "is", 2, "Net income", False), ("total_assets", "bs", 1, "Assets", False), ("long_term_debt", "bs", 2, "Long debt", False), ("shares_outstanding", "bs", 3, "Shares", True))


def items(s):
    return s.createDataFrame(list(ITEMS), "item string, statement string, ordinal int, label string, per_unit boolean")


def item_cells(s, d):
    """Cells of the last two years, without long debt in some."""
    wide = statements(s, d).where("period_key > 20009").withColumn("long_term_debt", F.expr("case when period_key % 10 > 2 then long_term_debt end"))
    return wide.unpivot(["symbol", "period_key"], [x[0] for x in ITEMS], "item", "value")


VALUES = ", ".join(f"('{i}', '{st}', {o}, '{label}', {str(p).lower()})" for i, st, o, label, p in ITEMS)
CELLS_SQL = f"""{STATEMENTS_SQL}, c0 AS (SELECT symbol, period_key, revenue, net_income, total_assets, CASE WHEN period_key % 10 > 2 THEN long_term_debt END AS long_term_debt, shares_outstanding::DOUBLE AS shares_outstanding FROM fin WHERE period_key > 20009),
 c1 AS (SELECT symbol, period_key, statement, ordinal, label, value / CASE WHEN per_unit THEN 1 ELSE 1e3 END AS v FROM (SELECT * FROM c0 UNPIVOT (value FOR item IN (revenue, net_income, total_assets, long_term_debt, shares_outstanding))) JOIN (VALUES {VALUES}) r(item, statement, ordinal, label, per_unit) USING (item))"""
add("PR_15_statement_rows", lambda s, d: sheets.statement_rows(item_cells(s, d), items(s), 1e3).withColumn("shown", F.round("shown", 5)), f"WITH {CELLS_SQL} SELECT symbol, statement, ordinal, label, period_key, round(v, 5) AS shown FROM c1")


def exported(s, d):
    """The sheets of all symbols as CSV and read again."""
    at = shared_folder(s, "sheets")
    made = sheets.sheet(sheets.statement_rows(item_cells(s, d), items(s), 1e3).withColumn("shown", F.round("shown", 5)))
    sheets.export(made, at, "statement", "ordinal")
    return s.read.schema(made.schema).option("header", True).csv(f"{at}/_by=*")


add("SNK_08_exported_sheets", exported, f"WITH {CELLS_SQL} PIVOT (SELECT symbol, statement, ordinal, label, CASE period_key % 10 WHEN 0 THEN '' ELSE 'Q' || period_key % 10 || '/' END || period_key // 10 AS p, round(v, 5) AS v FROM c1) ON p USING first(v) GROUP BY symbol, statement, ordinal, label")


def screened(s, d):
    """The symbols of a screen as one CSV file, read again."""
    at = shared_folder(s, "screen")
    last = fr.newest(fr.ratios(statements(s, d))).where("debt_equity < 1.5").select(F.col("symbol").alias("code"), F.round("debt_equity", 3).alias("debt_equity"))
    sheets.export(last, at, "code")
    return s.read.schema(last.schema).option("header", True).csv(at)


add("SNK_09_exported_screen", screened, f"WITH {STATEMENTS_SQL}, l AS (SELECT *, (coalesce(short_term_debt,0)+coalesce(long_term_debt,0))/nullif(equity,0) AS de FROM fin QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) = 1) SELECT symbol AS code, round(de, 3) AS debt_equity FROM l WHERE de < 1.5")


def named_cells(x, names):
    """Cells of raw tables, made of statements x, whose rows have names of their own: (row, name, expression over the statements)."""
    cells = F.array(*[F.struct(F.lit(row).alias("row"), F.array(F.lit(name), F.lit(None)).alias("ids"), F.expr(value).cast("double").alias("value")) for row, name, value in names])
    return x.select("symbol", "period_key", F.inline(cells)).select("symbol", "row", "ids", "period_key", "value")


def told(s, d):
    """What the raw tables tell, of statements that are summed up once."""
    x = kept(statements(s, d), "statements")
    return fuzzy.raw_metrics(*[named_cells(x, n) for n in (INCOME, BALANCE, ROWS, CASH)])


INCOME = [(1, "Growth of sales", "5D"), (2, "Net Revenue (all)", "revenue"), (3, "Net profit", "net_income"), (4, "Gross profit", "revenue * 0.3D")]
BALANCE = [(1, "Total Assets", "total_assets"), (2, "Owners_Equity", "equity"), (3, "Total liabilities", "total_assets - equity")]
ROWS = [(1, "ROE (%)", "case when length(symbol) % 2 = 0 then 0.12D end"), (2, "EPS basic (VND)", "case when period_key % 10 > 2 then 0D else net_income / 100 end")]
CASH = [(1, "Net operating cash flow", "cfo"), (2, "Capital expenditure", "capex")]
SHOWN = ("revenue", "net_profit", "net_margin", "gross_margin", "roe", "roa", "debt_to_equity", "debt_to_assets", "fcf")
add("VA_04_fuzzy_value", lambda s, d: fuzzy.fuzzy_value(named_cells(statements(s, d), ROWS), ("earnings", "eps")).select("symbol", F.round("value", 4).alias("value")),
    f"WITH {STATEMENTS_SQL} SELECT symbol, round(coalesce(max_by(net_income, period_key) FILTER (period_key % 10 <= 2 AND net_income <> 0) / 100, 0), 4) AS value FROM fin GROUP BY symbol")
add("FR_23_raw_metrics", lambda s, d: told(s, d).select("symbol", *[F.round(c, 3).alias(c) for c in SHOWN]),
    f"""WITH {STATEMENTS_SQL}, l AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_key DESC) = 1) SELECT symbol, round(revenue, 3) AS revenue, round(net_income, 3) AS net_profit, round(net_income/nullif(revenue,0)*100, 3) AS net_margin, round(30.0::DOUBLE, 3) AS gross_margin,
 round(CASE WHEN length(symbol) % 2 = 0 THEN 12.0::DOUBLE ELSE net_income/nullif(equity,0)*100 END, 3) AS roe, round(net_income/nullif(total_assets,0)*100, 3) AS roa, round((total_assets-equity)/nullif(equity,0), 3) AS debt_to_equity, round((total_assets-equity)/nullif(total_assets,0), 3) AS debt_to_assets, round(cfo+capex, 3) AS fcf FROM l""")


def balances(df):
    return df.unpivot(["symbol", "period_key"], ["equity", "total_assets"], "item", "value")


add("PR_13_align_quarters", lambda s, d: fr.align_quarters(balances(statements(s, d)).where("period_key % 10 < 4 or item = 'equity'").withColumn("value", F.expr("case when period_key % 30 = 4 then null else value end")), balances(yearly(s, d))).withColumn("value", F.round("value", 4)),
    f"{YEARS}, q AS (SELECT symbol, period_key, item, CASE WHEN period_key % 30 = 4 THEN NULL ELSE value END AS value FROM (SELECT symbol, period_key, equity, total_assets FROM fin) UNPIVOT INCLUDE NULLS (value FOR item IN (equity, total_assets)) WHERE period_key % 10 < 4 OR item = 'equity'), y AS (SELECT symbol, (year*10+4)::INT AS period_key, item, value AS y FROM (SELECT symbol, year, equity, total_assets FROM yr) UNPIVOT (value FOR item IN (equity, total_assets))) SELECT symbol, period_key, item, round(coalesce(value, y), 4) AS value FROM q FULL JOIN y USING (symbol, period_key, item)")


def own_strategies(s, d):
    up = lambda b: F.when(F.col("close") > F.lag("close", 5).over(ta.by_ts()), 1).when(F.col("close") < F.lag("close", 5).over(ta.by_ts()), -1)
    return extend.with_strategies(walk_bars(s, d), {"five days": up, "volume": lambda b: F.when(F.col("volume") > 20, 2).otherwise(0)})


add("EX_01_strategies", own_strategies, f"WITH {BARS}, l AS (SELECT *, lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS o FROM bars) SELECT symbol, ts, 'five days' AS strategy, CASE WHEN close > o THEN 1 WHEN close < o THEN -1 ELSE 0 END AS signal FROM l UNION ALL SELECT symbol, ts, 'volume', (volume > 20)::INT FROM l")


def spread(s, d):
    extend.register(s)
    walk_bars(s, d).select("symbol", F.to_date("ts").alias("day"), (F.col("volume") > 90).cast("int").alias("signal")).createOrReplaceTempView("ex_02_signals")
    return s.sql("SELECT symbol, h.day, h.left FROM ex_02_signals s, LATERAL held(s.day, s.signal, 3) h")


add("EX_02_held_signals", spread, f"WITH {BARS}, k AS (SELECT unnest(range(3)) AS k) SELECT symbol, (ts::DATE + k::INT) AS day, (2 - k)::INT AS \"left\" FROM bars, k WHERE volume > 90")


def with_documents(s, d):
    """Pages with anchors of their own: quotes of both kinds and none, tags within, one without a text, and one that leads to no document."""
    more = """<a class=x href='files/r.pdf'><b>Yearly</b> report</a><A title="Got" HREF="/download/9"></A><a href=//cdn.example/File/x.bin?y=1>F</a><a href="/files/none.zip"></a><a href="/plain">no</a><a name="x">anchor</a>"""
    return table(s, d, "pages").select("page_id", F.inline(tx.document_links(F.concat("html", F.lit(more)), F.col("url"))))


add("SRC_10_document_links", with_documents,
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(\w+://[^/?#]+)', 1) AS site, regexp_extract(url, '^(\w+://[^?#]*/)', 1) AS dir, regexp_extract(url, '^(\w+:)', 1) AS scheme FROM pages)
 SELECT page_id, 'Yearly report' AS title, dir || 'files/r.pdf' AS url FROM p UNION ALL SELECT page_id, 'Got', site || '/download/9' FROM p UNION ALL SELECT page_id, 'F', scheme || '//cdn.example/File/x.bin?y=1' FROM p UNION ALL SELECT page_id, 'none.zip', site || '/files/none.zip' FROM p""")


def two_sources(s, d):
    """Bars of 1998 to 2001 from two sources: the near one lacks ASIA, the far one has EUROPE at half the level."""
    b = walk_bars(s, d)
    level = F.when(F.col("symbol") == "EUROPE", 0.5).otherwise(1.0)
    far = b.select("symbol", "ts", *[(F.col(c) * level).alias(c) for c in ("open", "high", "low", "close")], "volume")
    return merge.hybrid(b.where("symbol <> 'ASIA'"), far, "1998-03-01", "2001-03-01")


HYBRID = f"WITH {BARS} SELECT symbol, ts, round(close, 4) AS close, symbol = 'EUROPE' AND ts < TIMESTAMP '2000-03-01' AS adjusted FROM bars WHERE ts BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '2001-03-01' + CASE WHEN symbol = 'ASIA' THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END"
add("SRC_13_hybrid", lambda s, d: two_sources(s, d).select("symbol", "ts", F.round("close", 4).alias("close"), "adjusted"), HYBRID)
META = (("roe", 1, "returns", "Return on equity", "%"), ("net_margin", 2, "margins", "Net margin", "%"), ("current_ratio", 3, "liquidity", "Current ratio", "x"))
META_SQL = ", ".join(f"('{i}', {o}, '{g}', '{label}', '{f}')" for i, o, g, label, f in META)
add("FR_15_ratio_rows", lambda s, d: fr.ratio_rows(fr.ratios(statements(s, d)), s.createDataFrame(list(META), "item string, ordinal int, group string, label string, format string")).withColumn("value", F.round("value", 3)),
    f"{PREPARED}, r AS (SELECT symbol, period_key, {', '.join(f'{RATIOS[x[0]]} AS {x[0]}' for x in META)}, {', '.join(f'{v} AS z_{k}' for k, v in RATIOS.items() if k not in {x[0] for x in META})} FROM p), any_ AS (SELECT DISTINCT symbol, period_key FROM (SELECT * FROM r) UNPIVOT (v FOR i IN ({', '.join([x[0] for x in META] + ['z_' + k for k in RATIOS if k not in {x[0] for x in META}])}))), k AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY period_key DESC)::INT AS rank FROM any_), u AS (SELECT * FROM (SELECT symbol, period_key, {', '.join(x[0] for x in META)} FROM r) UNPIVOT (value FOR item IN ({', '.join(x[0] for x in META)})))"
    f" SELECT symbol, ordinal, \"group\", label, format, item, period_key, rank, round(value, 3) AS value FROM u JOIN k USING (symbol, period_key) JOIN (VALUES {META_SQL}) m(item, ordinal, \"group\", label, format) USING (item) WHERE rank <= 6")
GROUP_PARTS = {"points of balance": ("c_acctbal", 9000.0), "points of key": ("key", 100.0)}
add("SC_09_components", lambda s, d: desk.component_rows(table(s, d, "customer").select(F.col("c_name").alias("symbol"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), (F.col("c_custkey") % 100).alias("key")), GROUP_PARTS),
    "SELECT c_name AS symbol, 'points of balance' AS component, c_acctbal AS points, 9000.0::DOUBLE AS most, c_acctbal / 9000 >= 0.5 AS passed FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_name, 'points of key', (c_custkey % 100)::DOUBLE, 100.0::DOUBLE, c_custkey % 100 >= 50 FROM customer")
add("SC_09_advice_with_upside", lambda s, d: table(s, d, "customer").select("c_custkey", desk.recommendation(F.col("c_custkey") % 101, F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))).alias("advice")),
    "SELECT c_custkey, CASE WHEN c_custkey % 101 >= 80 AND (c_custkey % 3 = 0 OR c_acctbal > 0) THEN 'strong buy' WHEN c_custkey % 101 >= 65 THEN 'buy' WHEN c_custkey % 101 >= 50 THEN 'hold' WHEN c_custkey % 101 >= 35 THEN 'reduce' ELSE 'sell' END AS advice FROM customer")
add("AG_08_sources_of_languages", lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n")), "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM documents GROUP BY lang")


def options(s, d):
    label = ingest.symbol_label(F.upper("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Company of the customer with number "), F.col("c_custkey").cast("string"))), exchange=F.when(F.col("c_custkey") % 2 > 0, F.lit("HSX")))
    o = table(s, d, "customer").select(label.alias("option"), F.col("c_custkey").alias("ordinal"))
    return ingest.find_option(table(s, d, "customer").where("c_custkey % 5 = 0").select(F.lower("c_name").alias("symbol")), o)


add("PR_16_find_option", options, "SELECT upper(c_name) AS symbol, upper(c_name) || CASE WHEN c_custkey % 3 > 0 THEN ' - ' || left('Company of the customer with number ' || c_custkey, 30) || '...' ELSE '' END || CASE WHEN c_custkey % 2 > 0 THEN ' (HSX)' ELSE '' END AS option FROM customer WHERE c_custkey % 5 = 0")
add("PR_03_money_text", lambda s, d: table(s, d, "orders").select("o_orderkey", ingest.money_text(F.floor(F.col("o_totalprice")) * F.when(F.col("o_orderkey") % 3 == 0, -1e5).when(F.col("o_orderkey") % 3 == 1, 100.0).otherwise(0.001)).alias("shown")).where("o_orderkey % 3 < 2").withColumn("shown", F.regexp_extract("shown", "[a-z]*$", 0)),
    "SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN 'bn' WHEN abs(v) >= 1e6 THEN 'm' ELSE '' END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) * CASE WHEN o_orderkey % 3 = 0 THEN -1e5 ELSE 100 END AS v FROM orders WHERE o_orderkey % 3 < 2)")
