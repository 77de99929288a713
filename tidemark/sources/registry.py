"""The canonical statement items and the rules by which rows of raw statements become them.

The rules of an item are its id and its English name, both made from its key, the local and English names below, and what a row's name must not hold. A
user's own rules (see rules_of) go before or in place of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import ingest

#: The items of each statement in order; after a colon local names, the preferred first, after = English names that the key does not give, after ! what the row's name must not hold.
ITEMS = {
    "is": """
        revenue: doanh thu thuần, doanh số thuần, doanh thu = net revenue, net sales, revenue ! giảm trừ, deduction, tài chính, financial, khác, other, chưa thực hiện, unearned, nhận trước
        cogs: giá vốn hàng bán, giá vốn = cost of goods sold, cost of sales
        gross_profit: lợi nhuận gộp
        financial_income: doanh thu hoạt động tài chính
        financial_expense: chi phí tài chính ! lãi vay
        interest_expense: chi phí lãi vay
        selling_expense: chi phí bán hàng
        admin_expense: chi phí quản lý = general and administrative
        operating_profit: lợi nhuận thuần từ hoạt động kinh doanh, lợi nhuận từ hoạt động kinh doanh ! trước thuế, before tax
        profit_before_tax: tổng lợi nhuận kế toán trước thuế, lợi nhuận trước thuế, lãi trước thuế
        income_tax: chi phí thuế thu nhập doanh nghiệp, chi phí thuế tndn hiện hành, thuế thu nhập doanh nghiệp ! hoãn lại, deferred
        net_income: lợi nhuận sau thuế, lãi sau thuế = net profit after tax, profit after tax, net profit ! công ty mẹ, parent, thiểu số, minority, không kiểm soát, non-controlling, chưa phân phối, undistributed
        net_income_parent: lợi nhuận sau thuế của cổ đông công ty mẹ, cổ đông của công ty mẹ, cổ đông công ty mẹ = attributable to parent, parent company
        eps: lãi cơ bản trên cổ phiếu, eps = earnings per share ! pha loãng, diluted
        net_interest_income: thu nhập lãi thuần
        total_operating_income: tổng thu nhập hoạt động
        provision_expense: chi phí dự phòng rủi ro tín dụng = provision for credit losses""",
    "bs": """
        cash: tiền và các khoản tương đương tiền, tiền và tương đương tiền = cash and cash equivalents ! đầu kỳ, cuối kỳ, beginning, end of, tăng, giảm, increase, lưu chuyển, ảnh hưởng
        short_term_investments: đầu tư tài chính ngắn hạn
        receivables: các khoản phải thu ngắn hạn, phải thu ngắn hạn = short-term receivables ! khác, other, dự phòng, provision, nội bộ
        inventory: hàng tồn kho = inventories ! dự phòng, provision, giảm giá, tăng, giảm
        current_assets: tài sản ngắn hạn ! khác, other, dài hạn
        fixed_assets: tài sản cố định ! khấu hao, mua sắm, thanh lý, vô hình, thuê tài chính, xây dựng
        total_assets: tổng cộng tài sản, tổng tài sản ! lợi nhuận, return, roa
        current_liabilities: nợ ngắn hạn ! vay, borrow, khác, other
        long_term_liabilities: nợ dài hạn ! vay, borrow, khác, other
        payables: phải trả người bán = trade payables ! dài hạn, long-term, trả trước, advance
        short_term_debt: vay và nợ thuê tài chính ngắn hạn, vay và nợ ngắn hạn, vay ngắn hạn = short-term borrowings
        long_term_debt: vay và nợ thuê tài chính dài hạn, vay và nợ dài hạn, vay dài hạn = long-term borrowings
        total_liabilities: tổng nợ phải trả, nợ phải trả = liabilities ! ngắn hạn, dài hạn, short, long, khác, other, vốn chủ, equity, người bán, nguồn vốn
        equity: vốn chủ sở hữu = owner's equity, total equity, equity ! nợ phải trả và, liabilities and, nguồn vốn, roe, lợi nhuận, return, khác, other, vốn góp, contributed, thay đổi, change
        minority_interest: lợi ích cổ đông không kiểm soát, cổ đông thiểu số = non-controlling interest
        charter_capital: vốn góp của chủ sở hữu, vốn điều lệ, vốn cổ phần = share capital
        retained_earnings: lợi nhuận sau thuế chưa phân phối, lợi nhuận chưa phân phối = undistributed
        customer_loans: cho vay khách hàng = loans to customers ! dự phòng, provision
        customer_deposits: tiền gửi của khách hàng = deposits from customers""",
    "cf": """
        depreciation: khấu hao ! lũy kế, accumulated
        cfo: lưu chuyển tiền thuần từ hoạt động kinh doanh = net cash flows from operating, operating cash flow ! trước, before, vốn lưu động, working capital
        cfi: lưu chuyển tiền thuần từ hoạt động đầu tư = investing activities
        cff: lưu chuyển tiền thuần từ hoạt động tài chính = financing activities
        capex: tiền chi để mua sắm, mua sắm tài sản cố định = purchase of fixed assets, capital expenditure ! thanh lý, disposal, thu từ, proceeds
        dividends_paid: cổ tức, lợi nhuận đã trả = dividends paid ! nhận, received""",
    "ratio": """
        shares_outstanding: số cổ phiếu lưu hành, số cp lưu hành = outstanding shares ! tăng trưởng, bình quân, average""",
}
#: What no name of an income or balance item may hold; eps, cash flows and shares only the last; items that no unit applies to; words of units.
COMMON = ("tăng trưởng", "growth", "yoy", "qoq", "biên", "margin", "vòng quay", "turnover", "/", "trên ", " per ", "tỷ lệ", "ratio", "tỷ suất", "%")
PER_UNIT = ("eps", "shares_outstanding")
BILLIONS, MILLIONS = ("tỷ đồng", "(tỷ"), ("triệu đồng", "(triệu")


def entries() -> list[tuple[str, str, list[str], list[str], list[str], list[str]]]:
    """(item, statement, ids, local names, English names, words to pass over) in order."""
    out = []
    cut = lambda s: [x.strip() for x in s.split(", ") if x.strip()]
    for statement, lines in ITEMS.items():
        for line in lines.strip().splitlines():
            head, _, never = line.strip().partition(" ! ")
            head, _, english = head.partition(" = ")
            key, _, local = head.partition(":")
            name = key.replace("_", " ")
            common = COMMON if statement in ("is", "bs") and key != "eps" else COMMON[-1:]
            every = [*cut(english), *dict.fromkeys([name.replace("short term", "short-term").replace("long term", "long-term"), name])]
            out.append((key, statement, list(dict.fromkeys([key, *[e.replace(" ", "_").replace("-", "_") for e in cut(english)]])), cut(local) if key != "dividends_paid" else [local.strip()], every, [*common, *cut(never)]))
    return out


def rules_of(spark: SparkSession, own: list[tuple] | None = None) -> DataFrame:
    """The registry as rules of match_items(), with the statement of each; own rules (item, statement, ids, local names, English names, words to pass over) take the place of an item's."""
    named = {e[0]: e for e in entries()} | {o[0]: o for o in own or []}
    rows = [(item, statement, tier, k, pattern, never) for item, statement, ids, local, english, never in named.values() for tier, names in enumerate((ids, local, english)) for k, pattern in enumerate(names)]
    return spark.createDataFrame(rows, "item string, statement string, tier int, ordinal int, pattern string, excluded array<string>")


def shown(spark: SparkSession) -> DataFrame:
    """The registry as sheets.statement_rows() takes it: (item, statement, ordinal, label, per_unit)."""
    rows = [(e[0], e[1], i, e[3][0].capitalize(), e[0] in PER_UNIT) for i, e in enumerate(entries())]
    return spark.createDataFrame(rows, "item string, statement string, ordinal int, label string, per_unit boolean")


def canonical_cells(cells: DataFrame, statement: str | None = None, rules: DataFrame | None = None, factor: float | None = None) -> DataFrame:
    """Canonical cells (symbol, period_key, item, value) of a raw statement's (symbol, row, item_id, label, label_en, period_key, value).

    An item is the first row that its rules name; amounts take `factor`, else that of the unit which the labels name; periods without any value are not there.
    """
    rules = rules_of(cells.sparkSession) if rules is None else rules
    rules = rules if statement is None else rules.where(F.col("statement") == statement)
    rows = cells.select("symbol", "row", "item_id", "label", "label_en").distinct()
    unit = rows.select("symbol").distinct().withColumn("factor", F.lit(factor)) if factor is not None else ingest.unit_of_labels(rows, list(BILLIONS), list(MILLIONS))
    return ingest.canonicalize(cells.select("symbol", "row", "period_key", "value"), ingest.match_items(rows, rules), unit, list(PER_UNIT))
