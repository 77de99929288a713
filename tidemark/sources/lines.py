"""Statement items from the text lines of a report: sections and the unit are carried down the lines, items go by their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import text as tx

#: Codes of the statements' lines, the item of each and words of its label without accents, all of which must be there, | parting those that do alike.
CODES = {
    "is": """
        10 revenue: doanh thu thuan
        11 cogs: gia von
        20 gross_profit: loi nhuan gop
        21 financial_income: doanh thu hoat dong tai chinh
        22 financial_expense: chi phi tai chinh
        23 interest_expense: lai vay
        25 selling_expense: ban hang
        26 admin_expense: quan ly
        30 operating_profit: loi nhuan thuan, hoat dong kinh doanh
        50 profit_before_tax: truoc thue
        51 income_tax: thue
        60 net_income: sau thue
        61 net_income_parent: cong ty me
        62 minority_profit: khong kiem soat|thieu so
        70 eps: lai co ban""",
    "bs": """
        100 current_assets: ngan han
        110 cash: tien
        120 short_term_investments: dau tu tai chinh ngan han
        130 receivables: phai thu
        140 inventory: hang ton kho
        220 fixed_assets: tai san co dinh
        270 total_assets: tong, tai san
        300 total_liabilities: no phai tra
        310 current_liabilities: no ngan han
        311 payables: nguoi ban
        320 short_term_debt: vay
        330 long_term_liabilities: no dai han
        338 long_term_debt: vay
        400 equity: von chu so huu
        411 charter_capital: von gop|von dau tu|von co phan
        421 retained_earnings: chua phan phoi
        429 minority_interest: khong kiem soat|thieu so
        440 total_liabilities_and_equity: tong, nguon von""",
    "cf": """
        02 depreciation: khau hao
        20 cfo: luu chuyen tien thuan, kinh doanh
        21 capex: mua sam
        30 cfi: luu chuyen tien thuan, dau tu
        36 dividends_paid: co tuc
        40 cff: luu chuyen tien thuan, tai chinh""",
}
#: Headings of the sections, the first that a line holds counts; a heading is shorter than this.
HEADINGS, HEADING = (
    ("bs", "BANG CAN DOI KE TOAN|BAO CAO TINH HINH TAI CHINH"), ("is", "KET QUA HOAT DONG KINH DOANH"), ("cf", "LUU CHUYEN TIEN TE"), ("notes", "THUYET MINH BAO CAO TAI CHINH|BAN THUYET MINH"),
), 120
#: An amount (grouped by thousands, a small one in brackets, 0, or four digits and more), and a code.
AMOUNT = r"(?U)\(?-?\d{1,3}(?:[.,]\d{3})+\)?|\(\d{1,3}\)|(?<![\w.,])0(?![\w.,])|(?<![\w.,])\(?-?\d{4,}\)?(?![\w.,])"
CODE = r"(?U)(?<![\w.,])(\d{2,3})(?![\w.,])"
#: What says the unit, characters below which a report has no text, and how far totals may be apart.
UNIT, NO_TEXT, BALANCE, SOURCES = r"don vi(?: tinh)?\s*[::]?\s*([a-z ]{2,20})", 200, 0.01, 0.001
#: Items that a report tells but that are not of the canonical ones, and those that no unit applies to.
HELPERS, PER_UNIT = ("total_liabilities_and_equity", "minority_profit"), ("eps",)


def codes() -> list[tuple[str, str, str, list[list[str]]]]:
    """(statement, code, item, words) of each line of CODES."""
    out = []
    for statement, lines in CODES.items():
        for line in lines.strip().splitlines():
            head, words = line.strip().split(": ")
            out.append((statement, *head.split(), [w.split("|") for w in words.split(", ")]))
    return out


def unit_factor(said: Column) -> Column:
    """The factor of a unit's name without accents."""
    return F.when(F.contains(said, F.lit("trieu")), 1e6).when(said.rlike("nghin|ngan"), 1e3).when(F.split(F.trim(said), " +")[0] == "ty", 1e9).otherwise(1.0)


def sections(lines: DataFrame) -> DataFrame:
    """lines (doc, page, line, text) with `plain`, the text in lower case without accents, and `section`: that of the last heading so far, null before the first."""
    plain = tx.strip_accents(F.lower("text"))
    heading = F.lit(None).cast("string")
    for name, heads in reversed(HEADINGS):
        heading = F.when(plain.rlike(heads.lower()), name).otherwise(heading)
    heading = F.when(F.length("text") < HEADING, heading)
    order = Window.partitionBy("doc").orderBy("page", "line")
    return lines.withColumn("plain", plain).withColumn("section", F.last(heading, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("plain").over(order))


def statement_items(lines: DataFrame) -> DataFrame:
    """(doc, item, value) of the reports whose lines these are, in the report's own currency unit.

    lines has doc, page, line and text, in the order of page and line. An item is taken from the first line of its statement that has its code before the first
    amount and its words in the label; a line gives one item, that of its first code whose item is not there yet. Values take the unit that the report
    says first. Reports of under NO_TEXT characters, and those without a known code, give no rows; a null text is an empty line.
    """
    c = F.col
    d = sections(lines.select("doc", "page", "line", F.coalesce("text", F.lit("")).alias("text")))
    said = F.when(F.contains("plain", F.lit("don vi")), F.regexp_extract(F.concat_ws("\n", "plain", "next"), UNIT, 1)).otherwise("")  # a line may end before its unit
    known = d.groupBy("doc").agg(F.min_by(F.when(said != "", said), F.when(said != "", F.struct("page", "line"))).alias("said"), (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"))
    known = known.where(c("chars") >= NO_TEXT).select("doc", F.coalesce(unit_factor(c("said")), F.lit(1.0)).alias("unit"))
    first = F.regexp_extract("text", AMOUNT, 0)
    rows = d.where(c("section").isin(*CODES)).withColumn("amount", first).where("amount <> ''")
    head = F.expr("substring(plain, 1, instr(text, amount) - 1)")
    rows = rows.withColumn("head", head).select("doc", "page", "line", "section", "head", tx.money(c("amount")).alias("value"), F.posexplode(F.regexp_extract_all("head", F.lit(CODE), 1)).alias("nth", "code"))
    # which words an item asks for is a fixed table of a few dozen rows: a condition, not a join
    item = F.lit(None).cast("string")
    for statement, code, name, words in codes():
        there = (c("section") == statement) & (c("code") == code)
        for alike in words:
            there = there & c("head").rlike("|".join(alike))
        item = F.when(there, name).otherwise(item)
    rows = rows.withColumn("item", item).where("item is not null and value is not null")
    # in order, a line's first item that is not there yet; a report has some dozens of such lines
    ordered = rows.groupBy("doc", "section").agg(F.sort_array(F.collect_list(F.struct("page", "line", "nth", "item", "value"))).alias("r"))
    none = F.struct(F.array().cast("array<string>").alias("items"), F.array().cast("array<double>").alias("amounts"), F.lit(None).cast(lines.schema["page"].dataType).alias("page"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"))

    def take(acc, r):
        skip = F.array_contains(acc["items"], r["item"]) | (acc["page"].eqNullSafe(r["page"]) & acc["line"].eqNullSafe(r["line"]))
        more = F.struct(F.concat(acc["items"], F.array(r["item"])).alias("items"), F.concat(acc["amounts"], F.array(r["value"])).alias("amounts"), r["page"].alias("page"), r["line"].alias("line"))
        return F.when(skip, acc).otherwise(more)

    found = ordered.withColumn("f", F.aggregate("r", none, take)).select("doc", F.explode(F.arrays_zip(c("f.items").alias("item"), c("f.amounts").alias("value"))).alias("x")).select("doc", "x.item", "x.value")
    # the statements tell different items, so none is there twice
    return found.join(known, "doc").select("doc", "item", F.when(c("item").isin(*PER_UNIT), c("value")).otherwise(c("value") * c("unit")).alias("value"))


def checked(items: DataFrame) -> DataFrame:
    """(doc, balance_identity, assets_equal_sources): whether liabilities and equity, and all sources, come to the assets; null where an amount is missing."""
    c, of = F.col, lambda name: F.max(F.when(F.col("item") == name, F.col("value")))
    g = items.groupBy("doc").agg(*[of(x).alias(x) for x in ("total_assets", "total_liabilities", "equity", "total_liabilities_and_equity")])
    assets, sources = F.nullif(c("total_assets"), F.lit(0.0)), F.nullif(c("total_liabilities_and_equity"), F.lit(0.0))
    apart = lambda x: F.abs(assets - x) / F.abs(assets)
    return g.select("doc", (apart(c("total_liabilities") + c("equity")) < BALANCE).alias("balance_identity"), (apart(sources) < SOURCES).alias("assets_equal_sources"))


def canonical(items: DataFrame) -> DataFrame:
    """The items without those that only checks look at."""
    return items.where(~F.col("item").isin(*HELPERS))
