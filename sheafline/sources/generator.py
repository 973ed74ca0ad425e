"""Synthetic bundles with labels, generated row by row: the same seed and number give the same bundle in any partition.

Half of the bundles have an error, dealt round; a tenth of those have two (a missing document always stands alone); a
third of the sound ones have a near-miss, a valid variant that no rule may flag. Labels come from what was done to a
bundle, never from the rules.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import CARD_AGES
from ..model import CREDIT, DEBIT, DOC_IDS, DOC_TYPES, ERROR_RULE, FIXED_TERM, MANIFEST, NEAR_MISSES, OPEN_ENDED, SCHEMA

FAMILY = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Lương".split()
MIDDLE = "Văn Thị Hữu Minh Quốc Thanh Ngọc Đức Thành Kim Xuân Gia".split()
GIVEN = "An Bình Cường Dũng Hà Hải Hạnh Hiếu Hùng Hương Khánh Lan Linh Long Mai Nam Nga Phúc Quân Sơn Thảo Thịnh Trang Tuấn Việt Yến".split()
PLACES = ["Phường Bến Thành, Quận 1, TP. Hồ Chí Minh", "Phường Hòa Cường, Quận Hải Châu, Đà Nẵng", "Xã Phú Xuân, Huyện Krông Năng, Đắk Lắk", "Phường Cửa Nam, Quận Hoàn Kiếm, Hà Nội", "Phường Vĩnh Trung, TP. Nha Trang, Khánh Hòa"]
COMPANIES = ["CÔNG TY TNHH GỐM SỨ SÔNG TRÀ", "CÔNG TY CỔ PHẦN SAO VIỆT", "CÔNG TY TNHH THƯƠNG MẠI ĐÔNG HẢI", "CÔNG TY CỔ PHẦN DỆT MAY BÌNH MINH"]
TITLES, PURPOSES = ["Nhân viên kế toán", "Thợ điện bậc ba", "Chuyên viên kinh doanh", "Trưởng nhóm kho"], ["Mua máy cày", "Lợp lại mái", "Học phí", "Chi tiêu gia đình"]
SPEND, OTHER_CREDIT = ["RUT TIEN TAI QUAY", "THANH TOAN TIEN DIEN", "MUA HANG SIEU THI", "CK THUE NHA"], ["NHAN CK TU LUONG VAN AN", "BAN XE MAY CU", "HOAN TIEN MUA HANG"]
_TARGET = {"E1": ("don_vay", "ho_ten"), "E2": ("don_vay", "so_cccd"), "E3": ("don_vay", "ngay_sinh"), "E4": ("don_vay", "thu_nhap_thang"), "E5": ("cccd", "ngay_het_han"), "E6": ("don_vay", "so_tk_nhan_luong"), "E7": ("hdld", "ngay_ket_thuc"), "N1": ("don_vay", "ho_ten"), "N2": ("don_vay", "ho_ten"), "N3": ("don_vay", "thu_nhap_thang"), "N4": ("sao_ke", "giao_dich"), "N5": ("cccd", "ngay_het_han"), "N6": ("sao_ke", "giao_dich")}


def plan(i: int) -> tuple[list[str], list[str]]:
    """Errors and near-misses of the i-th bundle."""
    codes = list(ERROR_RULE)
    j = i // 2
    if i % 2 == 0:
        first = codes[j % len(codes)]
        if j % 9 == 8 and first != "E8":
            return [first, next(c for c in codes[(j + 3) % 7 :] + codes if c not in (first, "E8") and {c, first} != {"E5", "E7"})], []
        return [first], []
    return [], [NEAR_MISSES[j // 3 % len(NEAR_MISSES)]] if j % 3 == 0 else []


def months_after(d: date, k: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + k, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(d.day, last))


def bare(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")


def digits_changed(s: str, dice: random.Random) -> str:
    at = dice.sample(range(1, len(s)), dice.choice((1, 2)))
    return "".join(str((int(c) + dice.randint(1, 9)) % 10) if i in at else c for i, c in enumerate(s))


def name_changed(name: str, dice: random.Random) -> str:
    words = name.split()
    ways = [" ".join([words[0], *words[2:]])]
    if bare(words[-1]) != words[-1]:
        ways.append(" ".join([*words[:-1], bare(words[-1])]))
    if words[1] != words[-1]:
        ways.append(" ".join([words[0], words[-1], *words[2:-1], words[1]]))
    # a change that leaves one side without any accent would be a valid variant, not an error
    return dice.choice([w for w in ways if bare(w) != w and bare(name) != name] or ways[:1])


def truth(i: int, errors: list[str], near: list[str], dice: random.Random) -> dict[str, dict]:
    """The documents' true values, with what the labels say done to them."""
    name = f"{dice.choice(FAMILY)} {dice.choice(MIDDLE)} {dice.choice(GIVEN)}"
    born = date(dice.randint(1968, 2002), dice.randint(1, 12), dice.randint(1, 28))
    signed = date(2026, dice.randint(1, 8), dice.randint(8, 28))
    number = f"0{dice.randint(10, 96):02d}{dice.randint(0, 3)}{born.year % 100:02d}{dice.randint(0, 999999):06d}"
    account = str(dice.randint(10**8, 10 ** dice.randint(10, 13)))
    gross = dice.randint(90, 400) * 100_000
    net = int(gross * 0.895) // 1000 * 1000
    end = signed - timedelta(days=dice.randint(1, 20))
    start = months_after(end, -3) + timedelta(days=1)
    while months_after(start, 3) > end + timedelta(days=1):
        start -= timedelta(days=1)
    paid = []
    m = date(start.year, start.month, 1)
    while m <= end:
        d = m + timedelta(days=dice.randint(4, 9))
        if start <= d <= end:
            paid.append({"ngay": d, "mo_ta": dice.choice([f"CT LUONG KY {d.month:02d} NAM {d.year}", f"KE TOAN TRA LUONG THANG {d.month}", f"MONTHLY SALARY {d.month:02d}"]), "so_tien": net + dice.randint(-3, 3) * 50_000, "loai": CREDIT})
        m = months_after(m, 1)
    if "N6" in near and len(paid) > 1:
        paid.pop()
    average = sum(p["so_tien"] for p in paid) / len(paid)
    rows = paid + [{"ngay": start + timedelta(days=dice.randint(0, (end - start).days)), "mo_ta": dice.choice(SPEND), "so_tien": dice.randint(1, 80) * 50_000, "loai": DEBIT} for _ in range(dice.randint(8, 16))]
    if "N4" in near:
        rows.append({"ngay": start + timedelta(days=10), "mo_ta": dice.choice(OTHER_CREDIT), "so_tien": net * 2, "loai": CREDIT})
    rows.sort(key=lambda r: (r["ngay"], r["loai"]))
    declared = int(average * dice.uniform(0.9, 1.0)) // 1000 * 1000
    if "N3" in near:
        declared = int(average * dice.uniform(1.02, 1.07))
    if "E4" in errors:
        declared = int(average * dice.uniform(1.25, 1.8))
    expiry = next(day for age in CARD_AGES if (day := months_after(born, 12 * age)) > signed)
    if "N5" in near:
        expiry = signed + timedelta(days=dice.randint(1, 30))
    if "E5" in errors:
        expiry = signed - timedelta(days=dice.randint(10, 400))
    open_ended = "E7" not in errors and dice.random() < 0.4
    begun = months_after(signed, -dice.randint(14, 40))
    finish = None if open_ended else months_after(signed, dice.randint(3, 30))
    if "E7" in errors:
        finish = signed - timedelta(days=dice.randint(5, 200))
    where, company = dice.choice(PLACES), dice.choice(COMPANIES)
    form_name, form_born = name, born
    if "E1" in errors:
        form_name = name_changed(name, dice)
    if "N1" in near:
        form_name = name.upper().replace(" ", "  ", 1)
    if "N2" in near:
        form_name = bare(name)
    if "E3" in errors:
        form_born = dice.choice([born + timedelta(days=dice.choice((-3, -2, -1, 1, 2, 3))), months_after(born, dice.choice((-1, 1)))])
    return {
        "cccd": {"so_cccd": number, "ho_ten": name, "ngay_sinh": born, "gioi_tinh": dice.choice(["Nam", "Nữ"]), "que_quan": where, "noi_thuong_tru": where, "ngay_cap": months_after(signed, -dice.randint(12, 60)), "ngay_het_han": expiry},
        "don_vay": {"ho_ten": form_name, "so_cccd": digits_changed(number, dice) if "E2" in errors else number, "ngay_sinh": form_born, "so_dien_thoai": f"09{dice.randint(0, 10**8 - 1):08d}", "dia_chi": where, "ten_cong_ty": company, "thu_nhap_thang": declared, "so_tien_vay": dice.randint(2, 30) * 10_000_000, "thoi_han_thang": dice.choice((12, 24, 36, 60)), "muc_dich": dice.choice(PURPOSES), "so_tk_nhan_luong": digits_changed(account, dice) if "E6" in errors else account, "ngay_ky": signed},
        "hdld": {"ho_ten_nld": name, "ten_cong_ty": company, "chuc_danh": dice.choice(TITLES), "loai_hd": OPEN_ENDED if open_ended else FIXED_TERM, "ngay_bat_dau": begun, "ngay_ket_thuc": finish, "muc_luong": gross},
        "sao_ke": {"chu_tk": bare(name).upper(), "so_tk": account, "ky_tu": start, "ky_den": end, "giao_dich": rows},
    }


# How each layout prints dates (signing dates apart), amounts and accounts.
STYLE = {
    ("cccd", "A"): ("slash", "slash", "dong", False), ("don_vay", "A"): ("slash", "long", "dong", False), ("don_vay", "B"): ("dash", "slash", "trieu", True), ("don_vay", "C"): ("dot", "long", "comma", False),
    ("hdld", "A"): ("slash", "slash", "dong", False), ("hdld", "B"): ("long", "long", "d", False), ("hdld", "C"): ("dot", "dot", "comma", False),
    ("sao_ke", "A"): ("slash", "slash", "comma", False), ("sao_ke", "B"): ("slash", "slash", "comma", False), ("sao_ke", "C"): ("dash", "dash", "d", True),
}


def printed_date(d: date, style: str) -> str:
    if style == "long":
        return f"ngày {d.day:02d} tháng {d.month:02d} năm {d.year}"
    sign = {"slash": "/", "dash": "-", "dot": "."}[style]
    return sign.join((f"{d.day:02d}", f"{d.month:02d}", str(d.year)))


def printed_money(v: int, style: str) -> str:
    text = f"{v:,}"
    if style == "comma":
        return text + " VND"
    if style == "trieu" and v >= 10**6 and v % 10**5 == 0:
        whole, tenth = divmod(v // 10**5, 10)
        return f"{whole}{f',{tenth}' if tenth else ''} triệu đồng"
    return text.replace(",", ".") + ("đ" if style == "d" else " đồng")


def printed(doc_type: str, name: str, kind: str, value, layout: str) -> str:
    dates, signing, amounts, grouped = STYLE[doc_type, layout]
    if value is None:
        return "Không xác định"
    if kind in ("date", "opt_date"):
        return printed_date(value, signing if name == "ngay_ky" else dates)
    if kind == "money":
        return printed_money(value, amounts)
    if kind == "int":
        return f"{value} tháng" if layout != "B" else str(value)
    if kind == "loai_hd":
        return "Không xác định thời hạn" if value == OPEN_ENDED else "Xác định thời hạn"
    if kind == "account" and grouped:
        return " ".join(value[i : i + 4] for i in range(0, len(value), 4))
    if kind == "transactions":
        rows = []
        for r in value:
            amount = printed_money(r["so_tien"], amounts).removesuffix(" VND").removesuffix("đ")
            row = {"ngay": printed_date(r["ngay"], dates), "mo_ta": r["mo_ta"]}
            credit = r["loai"] == CREDIT
            if layout == "A":
                row |= {CREDIT: amount if credit else None, DEBIT: None if credit else amount}
            elif layout == "B":
                row |= {"so_tien": ("+" if credit else "-") + amount, "loai": "+" if credit else "-"}
            else:
                row |= {"so_tien": amount, "loai": "C" if credit else "D"}
            rows.append(row)
        return json.dumps(rows, ensure_ascii=False)
    return str(value)


def true_text(value) -> str | None:
    """A true value as the manifest has it: ISO dates, plain numbers, JSON lists."""
    if value is None:
        return None
    if isinstance(value, list):
        return json.dumps([{**r, "ngay": r["ngay"].isoformat()} for r in value], ensure_ascii=False)
    return value.isoformat() if isinstance(value, date) else str(value)


def bundle(i: int, split: str, seed: int) -> dict:
    """The i-th bundle of a split as a manifest row."""
    dice = random.Random(f"{seed}/{split}/{i}")
    errors, near = plan(i)
    values = truth(i, errors, near, dice)
    gone = [dice.choice(DOC_TYPES)] if "E8" in errors else []
    layouts = {d: "A" if d == "cccd" else dice.choice("ABC" if split == "test" else "AB") for d in DOC_TYPES}
    label = lambda codes: [{"code": c, "doc_id": DOC_IDS[gone[0] if c == "E8" else _TARGET[c][0]], "field": None if c == "E8" else _TARGET[c][1]} for c in codes]
    name = f"{split}_{i:04d}"
    docs = [
        {
            "doc_id": DOC_IDS[d], "type": d, "files": [f"{name}/{DOC_IDS[d]}_1.jpg"], "fields_gt": {f: true_text(values[d][f]) for f, _ in SCHEMA[d]},
            "fields_raw": {f: {"raw": printed(d, f, k, values[d][f], layouts[d]), "page": 2 if f == "ngay_cap" else 1} for f, k in SCHEMA[d]},
        }
        for d in DOC_TYPES if d not in gone
    ]
    return {"bundle_id": name, "split": split, "seed": str(seed), "layout_ids": layouts, "augment": dice.choice(["clean", "scan", "photo"]), "bank": dice.choice(["BANK A", "BANK B"]), "docs": docs, "missing_docs": gone, "injected_errors": label(errors), "near_miss": label(near), "expected_route": "REQUEST_MORE" if gone else "REVIEW" if errors else "AUTO_PASS"}


#: Bundles that a worker holds at once.
AT_ONCE = 256


def lines(batches: Iterator[pd.DataFrame], split: str, seed: int) -> Iterator[pd.DataFrame]:
    """The bundles of batches of ids as JSON lines, a few at a time: a batch has 10,000 ids."""
    for batch in batches:
        for start in range(0, len(batch), AT_ONCE):
            yield pd.DataFrame({"line": [json.dumps(bundle(int(i), split, seed), ensure_ascii=False) for i in batch["id"][start : start + AT_ONCE]]})


def generate(spark: SparkSession, n: int, split: str = "dev", seed: int = 42, skip: DataFrame | None = None) -> DataFrame:
    """n bundles as a manifest; those whose bundle_id is in skip are left out (an interrupted build goes on)."""
    ids = spark.range(n)
    if skip is not None:
        ids = ids.withColumn("bundle_id", F.format_string(f"{split}_%04d", F.col("id"))).join(skip.select("bundle_id"), "bundle_id", "left_anti").select("id")
    return ids.mapInPandas(lambda batches: lines(batches, split, seed), "line string").select(F.from_json("line", MANIFEST).alias("m")).select("m.*")
