"""Raw statements to canonical items by the registry."""

from tidemark.sources import ingest, registry

CELL = "symbol string, row int, item_id string, label string, label_en string, period_key int, value double"


def canonical(spark, rows, **how):
    df = spark.createDataFrame([("A", i, *r) for i, r in enumerate(rows)], CELL)
    return {(r.period_key, r.item): r.value for r in registry.canonical_cells(df, **how).collect()}


def test_registry_is_whole():
    e = registry.entries()
    assert len(e) == 43 and len({x[0] for x in e}) == 43 and all(x[2] and x[3] and x[4] for x in e)


def test_net_revenue_not_growth(spark):
    rows = [
        (None, "Tăng trưởng doanh thu (%)", None, 20250, 0.1), (None, "Doanh thu bán hàng", None, 20250, 9.0), (None, "Các khoản giảm trừ doanh thu", None, 20250, 1.0), (None, "3. Doanh thu thuần về bán hàng", None, 20250, 8.0),
        (None, "Doanh thu hoạt động tài chính", None, 20250, 2.0), (None, "Lợi nhuận sau thuế", "Net profit after tax", 20250, 5.0), (None, "Lợi nhuận sau thuế của cổ đông công ty mẹ", None, 20250, 4.0), (None, "Lãi cơ bản trên cổ phiếu (đồng)", None, 20250, 5986.0),
    ]
    got = canonical(spark, rows, statement="is")
    assert got == {(20250, "revenue"): 8.0, (20250, "financial_income"): 2.0, (20250, "net_income"): 5.0, (20250, "net_income_parent"): 4.0, (20250, "eps"): 5986.0}


def test_ids_units_and_balance(spark):
    rows = [("net_sales", "x", None, 20240, 7.0), (None, "Doanh thu thuần", None, 20240, 1.0), (None, "Lãi cơ bản trên cổ phiếu", None, 20240, 3.0), (None, "Đơn vị: (Tỷ đồng)", None, 20240, 1.0), ("selling_expense", "", None, 20230, None)]
    assert canonical(spark, rows, statement="is") == {(20240, "revenue"): 7e9, (20240, "eps"): 3.0}
    assert canonical(spark, rows, statement="is", factor=2.0) == {(20240, "revenue"): 14.0, (20240, "eps"): 3.0}
    rows = [(None, n, None, 20240, float(i)) for i, n in enumerate(["TỔNG CỘNG NGUỒN VỐN", "NỢ PHẢI TRẢ VÀ VỐN CHỦ SỞ HỮU", "C. NỢ PHẢI TRẢ", "I. Nợ ngắn hạn", "10. Vay và nợ thuê tài chính ngắn hạn", "D. Vốn chủ sở hữu", "TỔNG CỘNG TÀI SẢN", "II. No dai han"])]
    got = canonical(spark, rows, statement="bs")
    assert got == {(20240, "total_liabilities"): 2.0, (20240, "current_liabilities"): 3.0, (20240, "short_term_debt"): 4.0, (20240, "equity"): 5.0, (20240, "total_assets"): 6.0, (20240, "long_term_liabilities"): 7.0}


def test_own_rules(spark):
    rules = registry.rules_of(spark, [("revenue", "is", ["sales"], ["umsatz"], ["turnover"], [])])
    assert canonical(spark, [(None, "Umsatz", None, 20240, 7.0), (None, "Doanh thu thuần", None, 20240, 1.0)], rules=rules) == {(20240, "revenue"): 7.0}


def test_scale_of_items(spark):
    scale = lambda v: ingest.infer_scale(spark.createDataFrame([("A", v)], "symbol string, total_assets double")).first().scale
    assert scale(50_000.0) == 1e6 and scale(7e13) == 1.0


def test_rules_meet_rows_dealt_by_symbol(spark):
    """What the rules find is not sorted in the task that reads the rows: a shuffle by symbol comes before the first join with the rules."""
    rules = spark.createDataFrame([("eps", 2, 0, "eps", []), ("eps", 0, 1, "id", [])], "item string, tier int, ordinal int, pattern string, excluded array<string>")
    rows = spark.createDataFrame([("A", 0, None, None, "EPS"), ("B", 1, "ID", None, None)], "symbol string, row int, item_id string, label string, label_en string")
    got = ingest.match_items(rows, rules)
    assert sorted(map(tuple, got.collect())) == [("A", "eps", 0), ("B", "eps", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [symbol") == 2  # both by id and by label
