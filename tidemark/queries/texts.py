"""Documents, headlines, links and landed payloads, keyed by operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans.bars import table, walk_bars
from tidemark.queries.market import BARS
from tidemark.sources import merge as mg

QUERIES, ORACLE = {}, {}


def add(name, query, sql):
    QUERIES[name], ORACLE[name] = query, sql


TITLES = ["Annual report {}", "Financial statements Q{} {}", "BCTC ban nien {}", "Báo cáo tài chính riêng {}", "Notice of meeting"]


def titled(s, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    title = F.when(k % 5 == 0, F.concat(F.lit("Annual report "), y)).when(k % 5 == 1, F.concat(F.lit("Financial statements Q"), F.quarter("o_orderdate"), F.lit(" "), y)).when(k % 5 == 2, F.concat(F.lit("BCTC ban nien "), y)).when(k % 5 == 3, F.concat(F.lit("Báo cáo tài chính riêng "), y)).otherwise("Notice of meeting 2099")
    return table(s, d, "orders").select("o_orderkey", "o_orderdate", title.alias("title"))


add("TX_04_documents", lambda s, d: titled(s, d).select("o_orderkey", *[v.alias(k) for k, v in tx.document_class(F.col("title"), F.lit("x_y.pdf"), F.lit(2024)).items()]),
    "WITH x AS (SELECT o_orderkey, o_orderkey%5 AS k, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders) SELECT o_orderkey, ['annual_report','fs_quarterly','fs_semiannual','fs_annual','other'][k+1] AS doc_type, CASE WHEN k<4 THEN y END AS year, CASE WHEN k=1 THEN q END AS quarter, CASE WHEN k IN (1,2) THEN true WHEN k=3 THEN false END AS consolidated, CASE WHEN k=1 THEN y*10+q WHEN k=2 THEN y*10+2 WHEN k<4 THEN y*10 END AS period_key FROM x")
NONE = ["N/A", "  none ", "-", "", "a  b\tc", "NaN"]
add("TX_06_clean", lambda s, d: table(s, d, "customer").select("c_custkey", tx.clean(F.element_at(F.array(*map(F.lit, NONE)), (F.col("c_custkey") % 6 + 1).cast("int"))).alias("text")), "SELECT c_custkey, CASE WHEN c_custkey%6=4 THEN 'a b c' END AS text FROM customer")
add("TX_08_headlines", lambda s, d: (lambda t: table(s, d, "part").select("p_partkey", tx.headline(t, {"brand#1": "First", "brand#2": "Second"}, "press")[0].alias("title"), tx.headline(t, {"brand#1": "First", "brand#2": "Second"}, "press")[1].alias("publisher")))(F.when(F.col("p_partkey") % 4 > 0, F.concat(F.col("p_name"), F.lit(" - more - "), F.col("p_brand"))).otherwise(F.col("p_name"))),
    "SELECT p_partkey, CASE WHEN p_partkey%4>0 THEN trim(p_name || ' - more') ELSE trim(p_name) END AS title, CASE WHEN p_partkey%4=0 THEN 'press' WHEN contains(lower(p_brand),'brand#1') THEN 'First' WHEN contains(lower(p_brand),'brand#2') THEN 'Second' ELSE p_brand END AS publisher FROM part")
add("TX_10_money", lambda s, d: table(s, d, "orders").select("o_orderkey", tx.money(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), F.format_number(F.floor("o_totalprice"), 0), F.lit(")"))).otherwise(F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), ",", "."))).alias("value"), tx.unit_of(F.when(F.col("o_orderkey") % 2 == 0, "in Million").otherwise("units"), {"million": 1e6, "billion": 1e9}).alias("unit")),
    "SELECT o_orderkey, floor(o_totalprice)::DOUBLE * CASE WHEN o_orderkey%3=0 THEN -1 ELSE 1 END AS value, CASE WHEN o_orderkey%2=0 THEN 1e6::DOUBLE ELSE 1 END AS unit FROM orders")
add("SRC_10_absolute_links", lambda s, d: table(s, d, "pages").select("page_id", F.inline(tx.links(F.col("html"), F.col("url")))).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("url").startswith("http")).alias("absolute"), F.sum(F.length("title")).alias("title_chars")),
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a>', 0)) AS a FROM pages) SELECT page_id, count(*) AS links, count(*) AS absolute, sum(length(trim(regexp_replace(regexp_replace(a,'<[^>]+>',' ','g'),'\s+',' ','g'))))::BIGINT AS title_chars FROM a GROUP BY page_id""")
add("SRC_04_current_quote", lambda s, d: (q := mg.current_quote(walk_bars(s, d).where("symbol in ('ASIA', 'EUROPE') and ts >= timestamp_ntz'2000-01-01'").withColumns({"ts": F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(10)), "close": F.col("close") + 1}), walk_bars(s, d))).select("symbol", *[F.round(c, 4).alias(c) for c in q.columns[1:]]),
    f"WITH {BARS}, q AS (SELECT symbol, max_by(close, ts) + CASE WHEN symbol IN ('ASIA','EUROPE') THEN 1 ELSE 0 END AS price, max(ts) AS t FROM bars GROUP BY symbol), r AS (SELECT symbol, price, max_by(close, ts) AS reference FROM q JOIN bars USING (symbol) WHERE ts < date_trunc('day', t) GROUP BY ALL) SELECT symbol, round(price,4) AS price, round(reference,4) AS reference, round(price-reference,4) AS change, round((price-reference)/reference*100,4) AS change_pct FROM r")
add("SRC_07_14_exchange", lambda s, d: mg.on_exchange(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "Hose").when(F.col("s_suppkey") % 3 == 1, "HSX").otherwise("HNX").alias("exchange")), "HOSE", {"HOSE": "HSX"}), "SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN 'Hose' ELSE 'HSX' END AS exchange FROM supplier WHERE s_suppkey%3<2")


def json_statements(s, d):
    v = lambda k: (F.col("c_custkey") * 10 + k).cast("string")
    p = F.concat(F.lit('[["2023","2024"],{"IS":[{"Name":"revenue","Value1":"'), v(1), F.lit('","Value2":"'), v(2), F.lit('"}],"BS":[{"Name":"equity","Value2":"x"}]}]'))
    return table(s, d, "customer").select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 10 == 0, "no json").otherwise(p).alias("payload"))


add("SRC_08_statement_json", lambda s, d: mg.statement_cells(json_statements(s, d)), "SELECT c_custkey AS symbol, i AS item, p AS period, CASE WHEN i = 'revenue' THEN (c_custkey*10 + p::INT - 2022)::DOUBLE END AS value FROM customer, (VALUES ('revenue','2023'),('revenue','2024'),('equity','2023'),('equity','2024')) t(i,p) WHERE c_custkey%10>0")
