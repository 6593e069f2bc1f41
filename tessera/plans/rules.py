"""Value parsing and text rules, on literal rows of our own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as v
from tessera.plans.registry import query


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]::VARCHAR[]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x)


def cases(name: str, schema: str, rows: list[tuple], shows: str):
    """Register rows of inputs and, last, the wanted result of f over the input columns."""

    def register(f):
        sql = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in [(k, r[-1]) for k, r in enumerate(rows)]) + f") AS x(no, {shows})"

        @query(name, sql)
        def run(t, s):
            d = s.createDataFrame([(k, *r[:-1]) for k, r in enumerate(rows)], "no int, " + schema)
            return d.select("no", f().alias(shows))

        return f

    return register


c = F.col


@cases("f01_clean_text", "t string", [("  a &amp; b\u0007  c ", "a & b c"), ("null", None), ("None", None), ("", None), ("x y", "x y"), (None, None), ("&lt;b&gt;", "<b>"), ("Caf&eacute; &#272;&#xE0; Lạt", "Café Đà Lạt"), ("nha\u0300 o\u031b\u0309 To\u0302\u0301", "nhà ở Tố"), ("a &unknown; & b&#9;c", "a &unknown; & b c")], "clean")
def f01():
    return tx.clean_text(c("t"))


@cases("f02_localized_number", "t string", [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("12,5", 12.5), ("9.630", 9630.0), ("1,234,567", 1234567.0), ("-3 m", -3.0), ("abc", None), ("3 000", 3000.0)], "n")
def f02():
    return v.localized_number(c("t"))


@cases("f03_f04_price", "t string", [("8,5 tỷ", 8.5e9), ("2 tỷ 290", 2.29e9), ("2tỷ550", 2.55e9), ("3 tỷ 200 triệu", 3.2e9), ("850 triệu", 8.5e8), ("2tr700", 2.7e6), ("11 triệu 500 nghìn", 11.5e6), ("500 nghìn", 5e5), ("Thỏa thuận", None), ("liên hệ", None), ("9.630 tỷ", 9.63e9), ("5800 tỷ", 5.8e9), ("3150000000 tỷ", 3.15e9), ("Bán nhà 52m2 giá 2tỷ360triệu", 2.36e9), ("1500000000", 1.5e9), ("0", None)], "price")
def f03():
    return v.price(c("t"))


@cases("f05_title_area", "t string", [("đất 1011,8m2", 1011.8), ("5.460,5 m2", 5460.5), ("162M²", 162.0), ("nhà 4x20m", 80.0), ("4,1mx13m", 53.3), ("không rõ", None), ("5m2", None)], "area")
def f05():
    return v.title_area(c("t"))


def judged():
    return v.plausible(v.price(c("label")), c("label"), c("area"), c("title"), c("rent"))


PLAUSIBLE = [("4.350 tỷ", 58.0, None, False, 4.35e9), ("2750 tỷ", 61.0, None, False, 2.75e9), ("48000 tỷ", 310.5, None, False, 48e9), ("1890000000 tỷ", 42.0, None, False, 1.89e9), ("6,075 tỷ", 900.0, None, False, 6.075e9), ("3.500 tỷ", 1_900_000.0, None, False, 3500e9), ("7,25 tỷ", 64.0, None, False, 7.25e9), ("9.1 triệu", 70.0, None, False, None), ("5 nghìn", 44.0, None, False, None), ("990 tỷ", 95.0, None, False, None), ("9,1 triệu", 70.0, None, True, 9.1e6)]


@cases("f06_plausible_price", "label string, area double, title string, rent boolean", PLAUSIBLE, "price")
def f06():
    return judged()["price"]


@cases("f06_plausible_reasons", "label string, area double, title string, rent boolean", [(*r[:4], w) for r, w in zip(PLAUSIBLE, (["DQ14"], ["DQ14"], ["DQ14"], ["DQ14"], ["DQ14"], ["DQ14"], [], ["DQ16"], ["DQ16"], ["DQ16"], []), strict=True)] + [("5 tỷ", 5.0, "nhà 50m2", False, ["DQ15"]), ("5 tỷ", 5.0, "nhà đẹp", False, ["DQ16"])], "reasons")
def f06b():
    return judged()["reasons"]


@cases("f07_reconciled_price", "shipped double, label string, area double", [(5e9, "8,5 tỷ", 50.0, 8.5e9), (9e9, "180 triệu / m²", 50.0, 9e9), (52e9, "Bán nhà 52m2 giá 2tỷ360triệu", 52.0, 2.36e9), (3e9, "Bán nhà giá 2 tỷ đẹp", 52.0, 3e9), (3e9, None, 52.0, 3e9), (None, "2 tỷ", 10.0, 2e9)], "price")
def f07():
    return v.reconciled(c("shipped"), c("label"), c("area"))


@cases("f08_area", "t string", [("75 m²", 75.0), ("1.234,5", 1234.5), ("0", None), (None, None)], "area")
def f08():
    return v.area_m2(c("t"))


@cases("f08_rooms", "t string", [("3 PN", 3), ("2 phòng ngủ", 2), ("4 bedrooms", 4), ("5", 5), ("vài phòng", None)], "rooms")
def f08b():
    return v.rooms(c("t"))


@cases("f09_f10_timestamps", "t string", [("2026-10-24 08:00:00", "2026-10-24 08:00:00"), ("24/10/2026", "2026-10-24 00:00:00"), ("24/10/2026 07:30:00", "2026-10-24 07:30:00"), ("1700000000000", "2023-11-14 22:13:20"), ("1700000000", "2023-11-14 22:13:20"), ("1899-01-01", None), ("bad", None)], "moment")
def f09():
    return F.date_format(v.timestamp(c("t")), "yyyy-MM-dd HH:mm:ss")


@cases("f11_relative_time", "t string", [("3 giờ trước", "2026-10-24 05:00:00"), ("15 phút trước", "2026-10-24 07:45:00"), ("2 ngày trước", "2026-10-22 08:00:00"), ("hôm qua", "2026-10-23 08:00:00"), ("lâu rồi", None)], "moment")
def f11():
    return F.date_format(v.relative_time(c("t"), F.lit("2026-10-24 08:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")


@cases("f12_coordinates", "lat double, lon double", [(10.8, 106.7, True), (0.0, 0.0, False), (91.0, 0.0, False), (None, 1.0, False), (float("nan"), 1.0, False)], "ok")
def f12():
    return v.has_point(c("lat"), c("lon"))


@cases("f13_url_cases", "t string", [("HTTPS://Ex.com/a/?q=1#x", "https://ex.com/a?q=1"), ("ftp://ex.com", None), ("http://ex.com/", "http://ex.com"), ("nope", None)], "url")
def f13():
    return v.normal_url(c("t"))


@cases("f19_fold_cases", "t string", [("Bán nhà Gò Vấp, ĐƯỜNG số 5!", "ban nha go vap duong so 5"), ("Sổ đỏ", "so do"), (None, "")], "folded")
def f19():
    return tx.fold(c("t"))


@cases("f22_json_list", "t string", [('["a","b","a",""]', ["a", "b"]), ("plain", ["plain"]), ("", [])], "items")
def f22():
    return v.json_list(c("t"))


@cases("f25_guarded_time", "a string, b string", [("2026-01-02", "2026-01-03", "2026-01-02"), ("2026-01-05", "2026-01-03", None)], "moment")
def f25():
    return F.when(c("a").cast("date") <= c("b").cast("date"), c("a"))


@cases("f28_distance_band", "km double", [(0.5, "lt3"), (3.0, "3_7"), (7.0, "7_15"), (20.0, "ge15"), (None, "na")], "band")
def f28():
    return v.distance_band(c("km"))


@cases("f29_tokens_case", "t string", [("Bán nhà HXH Lê Văn Sỹ, giá tốt", ["hxh", "le", "sy", "van"])], "tokens")
def f29():
    return tx.title_tokens(c("t"))


@cases("f30_jaccard", "a array<string>, b array<string>", [(["a", "b"], ["b", "c"], 1 / 3), ([], [], 0.0), (["x"], ["x"], 1.0)], "j")
def f30():
    return tx.jaccard(c("a"), c("b"))


@cases("p08_band_cases", "x double", [(999_999_999.0, 1), (1e9, 2), (4.5e9, 4), (20e9, 8), (0.0, -1), (None, -1), (-5.0, -1), (float("nan"), -1)], "band")
def p08():
    from tessera.operators.relational import band

    return band(c("x"), [0.0, 1e9, 2e9, 3e9, 5e9, 7e9, 10e9, 20e9, None])


@cases("p10_position", "x double, a double, b double", [(50.0, 60.0, 80.0, "below"), (60.0, 60.0, 80.0, "inside"), (80.0, 60.0, 80.0, "inside"), (81.0, 60.0, 80.0, "above"), (None, 60.0, 80.0, "no_data")], "place")
def p10():
    from tessera.operators.relational import position

    return position(c("x"), c("a"), c("b"))


TITLES = {
    "legal": [("Nhà sổ hồng riêng", "POSITIVE"), ("chưa có sổ hồng", "NEGATIVE"), ("giấy tay", "NEGATIVE"), ("xem sơ đồ", None), ("đã có sổ đỏ", "POSITIVE"), ("nhà đẹp", None), ("nhà không sđcc", "NEGATIVE"), ("chưa sđ", "NEGATIVE"), ("nhà có sổ", "POSITIVE"), ("ban nha so\u0302\u0309 đo\u0309", "POSITIVE")],
    "furnished": [("Full nội thất", "POSITIVE"), ("không nội thất", "NEGATIVE"), ("bàn giao thô", "NEGATIVE"), ("căn hộ", None)],
    "frontage": [("Mặt tiền đường lớn", "POSITIVE"), ("gần mặt tiền", None), ("MT 5m đẹp", None), ("không mặt tiền", "NEGATIVE"), ("mặt tiền hẻm", None)],
    "elevator": [("có thang máy", "POSITIVE"), ("nhà 5 tầng TM", "POSITIVE"), ("đất TM DV 3 tầng", None), ("không thang máy", "NEGATIVE")],
    "car_access": [("hẻm xe hơi", "POSITIVE"), ("gần ô tô", None), ("ô tô vào nhà", "POSITIVE"), ("nhà Ô Tô", "POSITIVE"), ("không ô tô", "NEGATIVE")],
}
for _feature, _rows in TITLES.items():
    cases(f"c01_c05_{_feature}", "t string", _rows, "status")(lambda f=_feature: tx.feature_status(f, c("t")))


@cases("c06_label_category", "t string", [("Căn hộ chung cư", "can_ho"), ("Biệt thự, liền kề", "biet_thu"), ("Đất nền dự án", "dat"), ("Nhà riêng", "nha_pho"), ("Kho, nhà xưởng", "phong_tro_khac"), ("Khác", None)], "category")
def c06():
    return tx.category_from_label(c("t"))


@cases("c07_title_category", "t string", [("Bán căn hộ 2PN", "can_ho"), ("Bán đất mặt tiền", "dat"), ("CHDV 10 phòng", "phong_tro_khac"), ("MT hẻm", "nha_pho"), ("lô CC đẹp", None)], "category")
def c07():
    return tx.category_from_title(c("t"))["category"]


@cases("c08_conflict", "label string, title string", [("Nhà riêng", "Bán căn hộ 2PN", True), ("Nhà riêng", "Biệt thự đẹp", False), ("Khác", "Bán đất", False), ("Đất nền", "đẹp", False)], "conflict")
def c08():
    return tx.model_category(c("label"), c("title"), F.lit("SOURCE_LABEL"))["conflict"]


@cases("c09_known_share", "price double, area double, rooms int", [(1.0, 2.0, 3, 1.0), (1.0, None, None, 0.333333), (None, None, None, 0.0)], "share")
def c09():
    return v.completeness("price", "area", "rooms")
