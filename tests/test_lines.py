"""Items of a report's text lines: values, the unit, decoys and checks."""

import pytest

from tidemark.sources import lines as ln

PAGES = [
    ["CÔNG TY MẪU", "Mục lục", "Bảng cân đối kế toán 5", "Báo cáo kết quả hoạt động kinh doanh 7"],
    ["BẢNG CÂN ĐỐI KẾ TOÁN", "Đơn vị tính: Triệu đồng", "A. Tài sản ngắn hạn 100 38.250 31.400", "I. Tiền 110 V.1 7.120 6.010", "Tổng cộng tài sản 270 70.500 61.200", "C. Nợ phải trả 300 38.700 33.900", "Vay dài hạn 320 1.111", "Vay ngắn hạn 320 10.600 9.100",
     "D. Vốn chủ sở hữu 400 31.800 27.300", "1. Vốn góp của chủ sở hữu 411 12.700 12.700", "TỔNG CỘNG NGUỒN VỐN 440 70.500 61.200"],
    ["BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH", "1. Doanh thu bán hàng 01 VI.1 61.000 52.900", "3. Doanh thu thuần 10 60.300 52.400", "Doanh thu thuần 10 1.234", "4. Giá vốn hàng bán 11 VI.2 (37.400) (32.600)", "Trong đó: Chi phí lãi vay 23 (720) (650)",
     "18. Lợi nhuận sau thuế 60 9.700", "19. Lãi cơ bản trên cổ phiếu (đồng) 70 VI.8 5.986 5.098", "Doanh thu thuần 10 và giá vốn 11 lợi nhuận gộp 20 22.900", "Chi phí thuế 51 0"],
    ["BÁO CÁO LƯU CHUYỂN TIỀN TỆ", "Khấu hao 02 2.600", "Lưu chuyển tiền thuần từ hoạt động kinh doanh 20 11.900 10.100", "THUYẾT MINH BÁO CÁO TÀI CHÍNH", "Doanh thu thuần 10 999.999", "Tiền chi mua sắm 21 (4.100)"],
]
SCHEMA = "doc string, page int, line int, text string"


def table(spark, pages, doc="d"):
    return spark.createDataFrame([(doc, p, k, t) for p, page in enumerate(pages) for k, t in enumerate(page)], SCHEMA)


def test_values_unit_and_decoys(spark):
    items = ln.statement_items(table(spark, PAGES).repartition(3))
    got = {r.item: r.value for r in items.collect()}
    want = {"revenue": 60_300e6, "cogs": -37_400e6, "interest_expense": -720e6, "total_assets": 70_500e6, "charter_capital": 12_700e6, "cfo": 11_900e6, "eps": 5986.0, "short_term_debt": 1_111e6, "gross_profit": 22_900e6, "income_tax": 0.0, "depreciation": 2_600e6}
    assert {k: got.get(k) for k in want} == want and "capex" not in got and got["net_income"] == 9_700e6
    check = ln.checked(items).first()
    assert check.balance_identity and check.assets_equal_sources
    assert ln.canonical(items).where("item = 'total_liabilities_and_equity'").count() == 0


@pytest.mark.parametrize("said,factor", [("Đơn vị: nghìn VND", 1e3), ("Đơn vị tính : tỷ đồng", 1e9), ("đơn vị tính\nTriệu đồng", 1e6), ("no unit", 1.0), ("Đơn vị: VND", 1.0)])
def test_units(spark, said, factor):
    page = ["BẢNG CÂN ĐỐI KẾ TOÁN", *said.split("\n"), "Tổng cộng tài sản 270 70.500", "Nợ phải trả 300 1.000", "Vốn chủ sở hữu 400 60.000", "x" * 200]
    items = ln.statement_items(table(spark, [page]))
    assert {r.item: r.value for r in items.collect()}["total_assets"] == 70_500 * factor
    check = ln.checked(items).first()
    assert check.balance_identity is False and check.assets_equal_sources is None


def test_no_text(spark):
    assert ln.statement_items(table(spark, [["BẢNG CÂN ĐỐI KẾ TOÁN", "Tổng cộng tài sản 270 70.500", None]])).count() == 0
    assert ln.statement_items(table(spark, [["x" * 300, None, ""]])).count() == 0
