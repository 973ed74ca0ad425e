"""Tables of values for the column expressions."""

import math
from datetime import date

from pyspark.sql import functions as F

from sheafline.functions import compose, dates, formats, parse, stats, text


def apply(spark, f, values, schema="s string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["v"] for r in rows.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def test_money(spark):
    """Every unit and way to group digits, whole amounts and amounts of a unit."""
    table = {
        "7.250.000đ": 7_250_000, "42.000.000 VNĐ": 42_000_000, "3,080,500 VND": 3_080_500, "960.000 đồng": 960_000, "31 triệu": 31_000_000, "4,2 triệu đồng": 4_200_000, "  6.5 triệu": 6_500_000,
        "2.750 triệu": 2_750_000_000, "1,25 tỷ": 1_250_000_000, "9 tỷ": 9_000_000_000, "35k": 35_000, "120 nghìn": 120_000, "8 ngàn": 8_000, "17": 17, "6,25": 625, "3 tỷ 40 triệu": 3_000_000_000, "VND 5": None, ",": None, "7.7.7 trieu": None, "-12": None, " ": None, None: None,
    }
    assert apply(spark, parse.money, list(table)) == list(table.values())


def test_dates(spark):
    good = {"03/11/2031": date(2031, 11, 3), "28-02-1999": date(1999, 2, 28), "9.7.2024": date(2024, 7, 9), "2028-02-29": date(2028, 2, 29), "ngày 01 tháng 12 năm 2023": date(2023, 12, 1), "ký 5/6/2020 tại": date(2020, 6, 5)}
    assert apply(spark, parse.day, list(good)) == list(good.values())
    assert apply(spark, parse.day, ["sắp tới", "29/02/2023", "30-04", "07/13/2025", "1/1/2020/5", None]) == [None] * 6
    assert apply(spark, parse.no_end_date, ["KHÔNG thời hạn", " null ", "không", "2031"]) == [True, True, False, False]


def test_identifiers(spark):
    assert apply(spark, parse.identity, ["0790 8801 2345", "07908801234", "số 079088012345"]) == ["079088012345", None, "079088012345"]
    assert apply(spark, parse.account, ["88-77", "9704 3321 8"]) == [None, "970433218"]
    assert apply(spark, parse.phone, ["(0912) 555 018", "113"]) == ["0912555018", None]
    assert apply(spark, parse.integer, ["trong 18 kỳ", "không"]) == [18, None]
    assert apply(spark, parse.contract_kind, ["HĐLĐ KHÔNG XÁC ĐỊNH THỜI HẠN", "có xác định thời hạn 1 năm", "khoán"]) == ["khong_xac_dinh_thoi_han", "xac_dinh_thoi_han", None]


def test_names(spark):
    """Equal up to case, spaces and, if one side has none at all, accents; nothing else."""
    full, bare = "Trịnh Thị Mỹ Lệ", "Trinh Thi My Le"
    pairs = [
        (full, full.upper(), True), (full, f" {full.lower()}  ".replace(" ", "\t "), True), (full, bare, True), (bare, bare.lower(), True), (full, "Trịnh Thị Mỹ Lê", False), (bare, "Trịnh Thi Mỹ Lê", True),
        (full, "Trịnh Mỹ Lệ", False), (full, "Trịnh Thị Lệ Mỹ", False), (bare, "Trinh My Le", False), ("Đào", "Dao", True), ("Đào", "Đao", False),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumns({"ab": text.names_match(F.col("a"), F.col("b")), "ba": text.names_match(F.col("b"), F.col("a"))})
    assert all(r["ab"] == r["ba"] == r["want"] for r in rows.collect())


def test_unicode(spark):
    import unicodedata

    words = ["Đoàn Thế Hiển", "Ứng Ẵ ộ", "Çelik", "plain", "ễ", "ẩ", "o̊̃"]
    split = [unicodedata.normalize("NFD", w) for w in words] + words
    assert apply(spark, text.nfc, split) == [unicodedata.normalize("NFC", w) for w in split]
    assert apply(spark, text.strip_accents, split[:4]) == ["Doan The Hien", "Ung A o", "Celik", "plain"]
    assert apply(spark, text.foreign_chars, ["XÝ NGHIỆP Þ Số 7 – ж", "Lê đ 2,5 – ₫ (b)"]) == ["Þж", ""]


def test_canonical_forms_of_every_script(spark):
    """Random strings of marks, letters that have them, parts of Hangul and what is never kept, against Python's forms."""
    import random
    import unicodedata

    whole, rank, pairs = compose._characters()
    dice = random.Random(8)
    pool = [*whole, *rank, *(c for t in pairs.values() for c in t), *pairs, *map(chr, (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3))), *(chr(dice.randrange(0xAC00, 0xD7A4)) for _ in range(99)), *"abeo 日\n" * 60]
    texts = ["".join(dice.choice(pool) for _ in range(dice.randrange(14))) for _ in range(3000)] + [*whole] + [unicodedata.normalize("NFD", chr(c)) + "x" for c in range(0xAC00, 0xD7A4, 11)] + ["e" + "\u0301\u0323" * 200, None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", compose.nfd(F.col("x")).alias("nfd"), compose.nfc(F.col("x")).alias("nfc"), compose.bare(F.col("x")).alias("bare")).collect()
    form = lambda kind, x: None if x is None else unicodedata.normalize(kind, x)
    bare = lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")
    assert [(r["nfd"], r["nfc"], r["bare"]) for r in rows] == [(form("NFD", x), form("NFC", x), bare(x)) for x in texts]


def test_transactions(spark):
    ok = '[{"ngay":"01/02/2026","mo_ta":" a  b ","so_tien":"1.000","loai":"C"},{"ngay":"02/02/2026","mo_ta":"x","ghi_co":null,"ghi_no":"2.000"},{"ngay":"03/02/2026","mo_ta":"y","so_tien":"+3.000","loai":"Ghi nợ"}]'
    bad = [
        '[{"ngay":"01/02/2026","mo_ta":"a","ghi_co":"1","ghi_no":"2"}]', '["row"]', "{}", "no json", '[{"ngay":"01/02/2026","mo_ta":"a","so_tien":"0","loai":"C"}]',
        '[{"ngay":"x","mo_ta":"a","so_tien":"1","loai":"C"}]', '[{"mo_ta":"a","so_tien":"1","loai":"C"}]', '[{"ngay":"01/02/2026","mo_ta":"a","so_tien":"1","loai":"?"}]', None,
    ]
    got = apply(spark, parse.transactions, [ok, "[]", *bad])
    assert [(t["so_tien"], t["loai"], t["mo_ta"]) for t in got[0]] == [(1000, "ghi_co", "a b"), (2000, "ghi_no", "x"), (3000, "ghi_co", "y")]
    assert got[1] == [] and got[2:] == [None] * len(bad)


def test_formats(spark):
    v = lambda style: apply(spark, lambda s: formats.money_as(s, style), [8_400_000, 3_000_000, 7_654_321], "s bigint")
    assert v("trieu") == ["8,4 triệu đồng", "3 triệu đồng", "7.654.321 đồng"] and v("comma")[2] == "7,654,321 VND"
    assert apply(spark, lambda s: formats.account_as(s, True), ["5566778899"]) == ["5566 7788 99"]
    assert apply(spark, lambda s: formats.phone_as(s, True), ["0988000111"]) == ["0988 000 111"]
    assert apply(spark, formats.duration_shown, [59.0, 90.0], "s double") == ["59 giây", "1.5 phút"]
    assert apply(spark, formats.percent_shown, [None, 0.5], "s double") == ["–", "50.0%"]


def test_upper_bound(spark):
    """Against the sum of binomial terms: at the bound, k or fewer of n have a chance of 5 %."""
    cases = [(0, 1), (0, 40), (1, 2), (2, 37), (17, 60), (99, 100), (500, 20_000), (0, 10**6)]
    rows = spark.createDataFrame([*cases, (0, 0), (5, 5), (6, 5), (None, 5)], "k int, n int")
    got = [r["u"] for r in rows.select(stats.upper_bound_95(F.col("k"), F.col("n")).alias("u")).collect()]
    for (k, n), u in zip(cases, got, strict=False):
        chance = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(u) + (n - i) * math.log1p(-u)) for i in range(k + 1))
        assert k / n < u < 1 and math.isclose(chance, 0.05, rel_tol=1e-7), (k, n)
    assert got[len(cases) :] == [1.0, 1.0, 1.0, None]
    assert 0.02 < stats.share_bound(10**7, 5 * 10**8) < 0.0201


def test_card_expiry(spark):
    rows = spark.createDataFrame([(date(2000, 2, 29), date(2025, 2, 27)), (date(2000, 2, 29), date(2025, 2, 28)), (date(1980, 1, 1), date(2041, 1, 1))], "born date, issued date")
    assert [r["e"] for r in rows.select(dates.card_expiry(F.col("born"), F.col("issued")).alias("e")).collect()] == [date(2025, 2, 28), date(2040, 2, 29), None]


def test_foreign_characters_one_by_one(spark):
    """Each character below U+3000 is judged as by its category and letters, and ASCII is the first test of the class."""
    import unicodedata

    own = {c for c, d in text._precomposed().items() if d[0].isascii() and set(d[1:]) <= text._MARKS} | set("đĐ")
    chars = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cn"]
    # categories of newer Unicode versions may differ from the JVM's, so letters, marks and digits are judged alone
    chars = [c for c in chars if c.isascii() or c in own or unicodedata.category(c)[0] in "LN"]
    got = apply(spark, lambda s: text.foreign_chars(s, composed=True), [f"a{c}b{c}" for c in chars])
    assert got == ["" if c.isascii() or c in own else c + c for c in chars]
    assert text._own_runs().startswith(r"[\x00-\x7F[") and text._own_runs().endswith("]]+")


def test_ascii_is_not_looked_at(spark, monkeypatch):
    """Forms of ASCII text are the text; others, spaces of every kind and null are as by their definition."""
    import re

    texts = ["plain text", "", "a  b", " a\tb \n c ", "é  đ\u00a0Đ\u3000x", "a \u2003 b", "a\u0301 ", "\u1112\u1161\u11ab", "\t", None]
    spaced = lambda x: None if x is None else re.sub(r"\s+", " ", x).strip(" ")
    assert apply(spark, text.collapsed, texts) == [spaced(x) for x in texts]
    assert apply(spark, text.strip_accents, texts[:5]) == texts[:4] + ["e  d\u00a0D\u3000x"]
    assert apply(spark, lambda s: text.has_diacritics(s), texts) == [False] * 4 + [True, False, True, False, False, None]
    for name in ("plain", "bare", "nfc"):
        monkeypatch.setattr(compose, name, lambda s, *_: F.raise_error(F.concat(F.lit("looked at: "), s)).cast("string"))
    for form in (text.nfc, text.strip_accents, text.for_ascii):
        assert apply(spark, form, texts[:4]) == texts[:4]


def test_equal_names_are_not_stripped(spark, monkeypatch):
    monkeypatch.setattr(text, "strip_accents", lambda s: F.raise_error(F.lit("stripped")).cast("string"))
    assert apply(spark, lambda s: text.names_match(s, F.concat(F.lit(" "), F.lower(s))), ["Trịnh  Thị", "An"]) == [True, True]
