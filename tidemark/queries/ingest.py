"""Ingest operators over tables shaped like raw ones, keyed by operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import news as near_news
from tidemark.plans.bars import STATEMENTS_SQL, statements, table, walk_bars
from tidemark.queries.market import BARS, NATION_BARS
from tidemark.sources import ingest as ig, lines

QUERIES, ORACLE = {}, {}


def add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


def raw_prices(s, d):
    """Bars as text under other names: each twice, with a later copy, bad numbers, zero closes and rows from the future."""
    b = walk_bars(s, d)
    text = b.select(F.lower("symbol").alias("Ticker"), F.col("ts").cast("string").alias("time"), F.when(F.dayofmonth("ts") == 1, "n/a").otherwise(F.col("open").cast("string")).alias("o"), F.col("high").alias("H"), "low", F.when(F.dayofmonth("ts") == 2, 0.0).otherwise(F.col("close")).alias("c"), "volume", F.lit(1).alias("seq"))
    return text.unionByName(text.withColumns({"c": F.col("c") * 2, "seq": F.lit(2)}))


add("PR_01_normalize_price", lambda s, d: ig.normalize_price(raw_prices(s, d), F.lit("2000-06-30").cast("timestamp_ntz")),
    f"WITH {BARS} SELECT symbol, ts, CASE WHEN day(ts) = 1 THEN close ELSE open END AS open, high, low, close, volume::DOUBLE AS volume FROM bars WHERE day(ts) <> 2 AND ts <= TIMESTAMP '2000-06-30'")
add("PR_01_implausible_bars", lambda s, d: ig.implausible(walk_bars(s, d, "n_name").withColumn("close", F.when(F.dayofmonth("ts") == 3, F.col("close") * 1.5).otherwise(F.col("close")))).groupBy("symbol").agg(F.count("*").alias("bad")),
    f"WITH {NATION_BARS}, x AS (SELECT symbol, high, low, CASE WHEN day(ts)=3 THEN close*1.5::DOUBLE ELSE close END AS close FROM bars) SELECT symbol, count(*) AS bad FROM x WHERE high<low OR close>1.2::DOUBLE*high OR close<0.8::DOUBLE*low GROUP BY symbol")
add("PR_02_VA_05_lift_units", lambda s, d: ig.lift_units(walk_bars(s, d), ["ASIA"]).select("symbol", "ts", F.round("close", 2).alias("close")),
    f"WITH {BARS}, m AS (SELECT symbol, median(close) AS m FROM bars GROUP BY symbol) SELECT symbol, ts, round(close * CASE WHEN m > 0 AND m < 1000 AND symbol <> 'ASIA' THEN 1000 ELSE 1 END, 2) AS close FROM bars JOIN m USING (symbol)")
add("PR_03_pct_change", lambda s, d: table(s, d, "customer").select("c_custkey", F.round(ig.pct_change(F.col("c_acctbal"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") - F.col("c_custkey") % 5)), 4).alias("pct")),
    "SELECT c_custkey, round((c_custkey % 5)/nullif(abs(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal - c_custkey % 5 END), 0)*100, 4) AS pct FROM customer")


def matrices(s, d):
    """Two matrices a nation, newest period first: one of years and a copied column, and one of four columns with a single label."""
    y = statements(s, d).groupBy("symbol").agg(*[F.sum(F.when(F.expr("period_key div 10") == k, F.col("revenue"))).alias(f"{k}") for k in (1998, 1997, 1996)])
    good = ig.matrix_cells(y.withColumn("1998_1", F.lit(1.0)).withColumn("note", F.lit(None).cast("string")).withColumn("tab", F.lit("good")), ["symbol", "tab"])
    bad = y.select("symbol", F.lit("bad").alias("tab"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"), F.lit("2018").alias("label"), F.col("1998").alias("value"))
    return good.unionByName(bad)


add("PR_09_matrix", lambda s, d: ig.by_period(matrices(s, d), ["symbol", "tab"], []).withColumn("value", F.round("value", 4)),
    f"WITH {STATEMENTS_SQL}, g AS (SELECT symbol, period_key//10 AS y, sum(revenue) AS v FROM fin GROUP BY ALL), k AS (SELECT DISTINCT symbol, y FROM (SELECT DISTINCT symbol FROM fin), (VALUES (1996),(1997),(1998)) t(y)) SELECT symbol, 'good' AS tab, (y*10)::INT AS period_key, round(v, 4) AS value FROM k LEFT JOIN g USING (symbol, y)")
add("PR_07_tabular", lambda s, d: ig.from_tabular(table(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.year("o_orderdate").alias("y"), (F.quarter("o_orderdate") + F.col("o_orderkey") % 2).alias("q"), "o_orderkey"), "y", "q", "o_orderkey").select("symbol", "period_key", "o_orderkey"),
    "WITH x AS (SELECT o_orderpriority AS symbol, year(o_orderdate) AS y, quarter(o_orderdate) + o_orderkey % 2 AS q, o_orderkey FROM orders), k AS (SELECT *, (y*10 + CASE WHEN q BETWEEN 1 AND 4 THEN q ELSE 0 END)::INT AS period_key FROM x) SELECT symbol, period_key, max(o_orderkey) AS o_orderkey FROM k GROUP BY ALL")
add("PR_08_period_order", lambda s, d: ig.period_order(table(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.when((F.col("o_orderpriority") < "2") & (F.col("o_orderkey") % 9 == 0), "total").otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit("/"), F.year("o_orderdate"))).alias("label"))),
    "WITH x AS (SELECT DISTINCT o_orderpriority AS symbol, CASE WHEN o_orderpriority < '2' AND o_orderkey % 9 = 0 THEN 'total' ELSE 'Q'||quarter(o_orderdate)||'/'||year(o_orderdate) END AS label FROM orders), k AS (SELECT *, try_cast(label[4:7] AS INT)*10+try_cast(label[2:2] AS INT) AS key FROM x), m AS (SELECT *, bool_and(key IS NOT NULL) OVER (PARTITION BY symbol) AS sure FROM k) SELECT symbol, label, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN sure THEN key END, label)::INT AS place FROM m")

#: A small registry for statements in English and French: (item, tier, ordinal, pattern, excluded).
_NO = ["growth", "%", "margin", "/"]
RULES = [
    ("revenue", 0, 0, "net_sales", []), ("revenue", 1, 1, "chiffre d'affaires", [*_NO, "financier"]), ("revenue", 2, 2, "net revenue", _NO), ("revenue", 2, 3, "revenue", [*_NO, "deduction", "financial"]),
    ("equity", 1, 0, "capitaux propres", _NO), ("equity", 2, 1, "equity", [*_NO, "liabilities and"]), ("eps", 2, 0, "earnings per share", ["diluted"]),
]


def rules(s):
    return s.createDataFrame(RULES, "item string, tier int, ordinal int, pattern string, excluded array<string>")


LINES = [
    (0, None, "Revenue growth (%)", "a.revenue"), (1, None, "2. Revenue deductions", "b.1"), (2, None, "II. Financial revenue", "b.2"), (3, None, "3) Revenue", "c.revenue"), (4, "net_sales", "anything", "e.revenue"),
    (5, None, "Liabilities and equity", "x"), (6, None, "Total equity", "d.equity"), (7, None, "Basic earnings per share", "eps"), (8, None, "Diluted earnings per share", "y"),
]


def raw_rows(s, d):
    """The lines of a statement for each customer; those with an even key lack the line with an id, and French ones carry accents."""
    one = [F.struct(F.lit(r).alias("row"), F.lit(i).cast("string").alias("item_id"), F.lit(e).alias("label_en")) for r, i, e, _ in LINES]
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), "c_custkey", "c_acctbal")
    rows = c.select("*", F.inline(F.array(*one))).where("c_custkey % 2 = 1 or item_id is null")
    french = F.when((F.col("c_custkey") % 3 == 0) & (F.col("row") == 6), "III – Capitaux Propres").when((F.col("c_custkey") % 4 == 0) & (F.col("row") == 2), "Chiffre d'Affaires")
    return rows.withColumn("label", french)


MATCHED = """m AS (SELECT c_custkey::VARCHAR AS symbol, c_custkey, c_acctbal, item, CASE item WHEN 'equity' THEN 6 WHEN 'eps' THEN 7 ELSE CASE WHEN c_custkey % 2 = 1 THEN 4 WHEN c_custkey % 4 = 0 THEN 2 ELSE 3 END END AS "row" FROM customer, (VALUES ('revenue'), ('equity'), ('eps')) v(item))"""
add("TX_02_match_items", lambda s, d: ig.match_items(raw_rows(s, d), rules(s)), f"WITH {MATCHED} SELECT symbol, item, \"row\" FROM m")
add("TX_01_labels", lambda s, d: raw_rows(s, d).select("symbol", "row", tx.norm_label(F.col("label_en")).alias("label"), tx.strip_accents(tx.norm_label(F.col("label"))).alias("local")),
    "SELECT c_custkey::VARCHAR AS symbol, k AS \"row\", l AS label, CASE WHEN c_custkey % 3 = 0 AND k = 6 THEN 'capitaux propres' WHEN c_custkey % 4 = 0 AND k = 2 THEN 'chiffre d''affaires' END AS local FROM customer, (VALUES (0,'revenue growth (%)'),(1,'revenue deductions'),(2,'financial revenue'),(3,'revenue'),(4,'anything'),(5,'liabilities and equity'),(6,'total equity'),(7,'basic earnings per share'),(8,'diluted earnings per share')) t(k, l) WHERE c_custkey % 2 = 1 OR k <> 4")


def said(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.when(F.col("c_custkey") % 3 == 0, "Balance (in million)").when(F.col("c_custkey") % 3 == 1, "Sheet in BILLION units").otherwise("Sheet").alias("label"))


FACTOR = "CASE c_custkey % 3 WHEN 0 THEN 1e6::DOUBLE WHEN 1 THEN 1e9::DOUBLE END"
add("TX_03_unit_of_labels", lambda s, d: ig.unit_of_labels(said(s, d), ["billion"], ["million"]), f"SELECT c_custkey::VARCHAR AS symbol, {FACTOR} AS factor FROM customer")
add("PR_10_canonicalize", lambda s, d: ig.canonicalize(raw_rows(s, d).select("symbol", "row", F.lit(20240).alias("period_key"), (F.col("c_acctbal") + F.col("row")).alias("value")), ig.match_items(raw_rows(s, d), rules(s)), ig.unit_of_labels(said(s, d), ["billion"], ["million"]), ["eps"]).withColumn("value", F.round("value", 2)),
    f"WITH {MATCHED} SELECT symbol, 20240 AS period_key, item, round((c_acctbal + \"row\") * CASE WHEN item = 'eps' THEN 1 ELSE coalesce({FACTOR}, 1) END, 2) AS value FROM m")
add("PR_11_infer_scale", lambda s, d: ig.infer_scale(statements(s, d).select("symbol", F.when(F.col("symbol") > "K", F.col("total_assets")).alias("total_assets"), "equity")),
    f"WITH {STATEMENTS_SQL}, m AS (SELECT symbol, CASE WHEN symbol > 'K' THEN median(abs(total_assets)) ELSE median(abs(equity)) END AS m, median(abs(equity)) AS e FROM fin GROUP BY symbol), f AS (SELECT symbol, CASE WHEN m >= 1e10 THEN 1.0 WHEN m*1e3 >= 1e10 THEN 1e3 WHEN m*1e6 >= 1e10 THEN 1e6 WHEN m*1e9 >= 1e10 THEN 1e9 END AS a, CASE WHEN e >= 1e10 THEN 1.0 WHEN e*1e3 >= 1e10 THEN 1e3 WHEN e*1e6 >= 1e10 THEN 1e6 WHEN e*1e9 >= 1e10 THEN 1e9 END AS b FROM m) SELECT symbol, coalesce(a, b, 1)::DOUBLE AS scale FROM f")


def sourced(s, d):
    from tidemark.queries.merges import cells
    from tidemark.sources.merge import merge_cells

    return merge_cells(cells(s, d))


add("PR_12_JN_06_long_to_wide", lambda s, d: (w := ig.long_to_wide(sourced(s, d), ["revenue", "equity", "receivables"])).select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in w.dtypes]),
    f"WITH {STATEMENTS_SQL} SELECT symbol, period_key, round(CASE WHEN period_key % 2 = 0 THEN revenue*2 ELSE revenue END,4) AS revenue, round(equity,4) AS equity, round(receivables*2,4) AS receivables, CASE WHEN revenue IS NOT NULL THEN CASE WHEN period_key % 2 = 0 THEN 'B' ELSE 'A' END END AS revenue_source, CASE WHEN equity IS NOT NULL THEN 'A' END AS equity_source, CASE WHEN receivables IS NOT NULL THEN 'B' END AS receivables_source FROM fin")
add("PR_16_symbol_labels", lambda s, d: table(s, d, "part").select("p_partkey", ig.symbol_label(F.col("p_brand"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name"))).alias("label")).withColumn("symbol", ig.label_symbol(F.col("label"))),
    "WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS n FROM part), y AS (SELECT p_partkey, p_brand, CASE WHEN coalesce(n, '') = '' THEN p_brand ELSE p_brand || ' - ' || CASE WHEN length(n) > 32 THEN n[1:30] || '...' ELSE n END END AS label FROM x) SELECT p_partkey, label, upper(p_brand) AS symbol FROM y")


def report_lines(s, d):
    """A report for each nation and quarter, in millions: sections with headings, codes before amounts, a decoy in the notes, and in some a line told twice."""
    said = lambda label, code, v: F.concat(F.lit(f"{label} {code} "), money(v), F.lit(" 1.000"))
    money = lambda v: F.when(v < 0, F.concat(F.lit("("), F.format_number(-v, 0), F.lit(")"))).otherwise(F.format_number(v, 0))
    v = lambda c: F.floor(F.col(c) + 0.003).cast("double") + F.when(F.col(c) < 0, -1000).otherwise(1000)
    lines = F.array(
        F.lit("Báo cáo của một công ty mẫu, trang bìa và mục lục, " + "-" * 160), F.lit("BẢNG CÂN ĐỐI KẾ TOÁN"), F.lit("Đơn vị tính: Triệu đồng"), said("Tài sản ngắn hạn", "100", v("current_assets")), said("TỔNG CỘNG TÀI SẢN", "270", v("total_assets")),
        said("NỢ PHẢI TRẢ", "300", v("total_assets") - v("equity")), said("VỐN CHỦ SỞ HỮU", "400", v("equity")), said("TỔNG CỘNG NGUỒN VỐN", "440", v("total_assets") + F.when(F.col("period_key") % 10 == 2, v("total_assets")).otherwise(0)),
        F.lit("KẾT QUẢ HOẠT ĐỘNG KINH DOANH"), said("Doanh thu thuần", "10", v("revenue")), F.when(F.col("period_key") % 10 == 3, said("Doanh thu thuần", "10", v("revenue") * 2)).otherwise(F.lit("")), said("Giá vốn hàng bán", "11", v("cogs")),
        F.lit("LƯU CHUYỂN TIỀN TỆ"), said("Lưu chuyển tiền thuần từ hoạt động kinh doanh", "20", v("cfo")), F.lit("THUYẾT MINH BÁO CÁO TÀI CHÍNH"), F.lit("Tiền chi mua sắm 21 999.999"),
    )
    doc = F.concat_ws("-", "symbol", "period_key").alias("doc")
    return statements(s, d).select(doc, F.lit(1).alias("page"), F.posexplode(lines).alias("line", "text"))


TOLD = {"current_assets": "current_assets", "total_assets": "total_assets", "equity": "equity", "revenue": "revenue", "cogs": "cogs", "cfo": "cfo"}
IN_LINES = f"""WITH {STATEMENTS_SQL}, v AS (SELECT symbol || '-' || period_key AS doc, period_key, {', '.join(f'floor({x} + 0.003::DOUBLE) + CASE WHEN {x} < 0 THEN -1000 ELSE 1000 END AS {x}' for x in TOLD)} FROM fin)"""
add("FR_25_statement_items", lambda s, d: lines.canonical(lines.statement_items(report_lines(s, d))), f"{IN_LINES} SELECT doc, item, value * 1e6 AS value FROM (SELECT doc, {', '.join(TOLD)}, total_assets - equity AS total_liabilities FROM v) UNPIVOT (value FOR item IN ({', '.join(TOLD)}, total_liabilities))")
add("FR_25_checks", lambda s, d: lines.checked(lines.statement_items(report_lines(s, d))), f"{IN_LINES} SELECT doc, true AS balance_identity, period_key % 10 <> 2 AS assets_equal_sources FROM v")


def titled(s, d):
    """Documents as a list of news for each source: the first characters of the text as title, one address for some."""
    k = F.col("doc_id")
    return table(s, d, "documents").select("source", "doc_id", F.regexp_replace(F.substring("text", 1, 70), r"\s+", " ").alias("title"), F.when(k % 3 == 0, F.concat(F.lit("http://n/"), (k % 400).cast("string"), F.lit("/#x"))).alias("url"))


#: SQL has no such ratio: held against a walk of each list in the tests.
QUERIES["TX_07_without_near_copies"] = lambda s, d: near_news.without_near_copies(titled(s, d), "source", "doc_id").select("source", "doc_id")
