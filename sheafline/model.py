"""The bundle model: document types, their fields, configuration, and the Spark types made from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Document types in order, and (field, kind) in the order that reasons are listed in.
SCHEMA: dict[str, list[tuple[str, str]]] = {
    "cccd": [("so_cccd", "cccd"), ("ho_ten", "name"), ("ngay_sinh", "date"), ("gioi_tinh", "text"), ("que_quan", "text"), ("noi_thuong_tru", "text"), ("ngay_cap", "date"), ("ngay_het_han", "date")],
    "don_vay": [("ho_ten", "name"), ("so_cccd", "cccd"), ("ngay_sinh", "date"), ("so_dien_thoai", "digits"), ("dia_chi", "text"), ("ten_cong_ty", "text"), ("thu_nhap_thang", "money"), ("so_tien_vay", "money"), ("thoi_han_thang", "int"), ("muc_dich", "text"), ("so_tk_nhan_luong", "account"), ("ngay_ky", "date")],
    "hdld": [("ho_ten_nld", "name"), ("ten_cong_ty", "text"), ("chuc_danh", "text"), ("loai_hd", "loai_hd"), ("ngay_bat_dau", "date"), ("ngay_ket_thuc", "opt_date"), ("muc_luong", "money")],
    "sao_ke": [("chu_tk", "name"), ("so_tk", "account"), ("ky_tu", "date"), ("ky_den", "date"), ("giao_dich", "transactions")],
}
DOC_TYPES = list(SCHEMA)
DOC_IDS = {"cccd": "d1", "don_vay": "d2", "hdld": "d3", "sao_ke": "d4"}
ROUTES = ["AUTO_PASS", "REVIEW", "REQUEST_MORE"]
RULE_IDS = [f"R{i}" for i in range(9)]
#: The rule that is to find each injected error.
ERROR_RULE = {"E1": "R1", "E2": "R2", "E3": "R3", "E4": "R4", "E5": "R5", "E6": "R6", "E7": "R7", "E8": "R0"}
NEAR_MISSES = ["N1", "N2", "N3", "N4", "N5", "N6"]
FIXED_TERM, OPEN_ENDED = "xac_dinh_thoi_han", "khong_xac_dinh_thoi_han"
CREDIT, DEBIT = "ghi_co", "ghi_no"

TRANSACTION = T.StructType([T.StructField("ngay", T.DateType()), T.StructField("mo_ta", T.StringType()), T.StructField("so_tien", T.LongType()), T.StructField("loai", T.StringType())])
RAW = T.MapType(T.StringType(), T.StructType([T.StructField("raw", T.StringType()), T.StructField("page", T.IntegerType())]))
_LABEL = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("code", "doc_id", "field")]))
MANIFEST = T.StructType(
    [
        T.StructField("bundle_id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("seed", T.StringType()),
        T.StructField("layout_ids", T.MapType(T.StringType(), T.StringType())), T.StructField("augment", T.StringType()), T.StructField("bank", T.StringType()),
        T.StructField("docs", T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("files", T.ArrayType(T.StringType())), T.StructField("fields_gt", T.MapType(T.StringType(), T.StringType())), T.StructField("fields_raw", RAW)]))),
        T.StructField("missing_docs", T.ArrayType(T.StringType())), T.StructField("injected_errors", _LABEL), T.StructField("near_miss", _LABEL), T.StructField("expected_route", T.StringType()),
    ]
)


@dataclass(frozen=True)
class RulesConfig:
    version: str = "rules-v2"
    salary_patterns: tuple[str, ...] = (r"\bCT LUONG\b", r"\bTRA LUONG\b", r"\bLUONG T\d{1,2}\b", r"\bSALARY\b")
    income_tolerance: float = 0.10
    statement_max_age_days: int = 30
    statement_min_months: int = 3


@dataclass(frozen=True)
class Thresholds:
    version: str = "thr-v1"
    critical: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "cccd": ("ho_ten", "so_cccd", "ngay_sinh", "ngay_het_han"),
        "don_vay": ("ho_ten", "so_cccd", "ngay_sinh", "thu_nhap_thang", "so_tk_nhan_luong", "ngay_ky"),
        "hdld": ("ho_ten_nld",),
        "sao_ke": ("chu_tk", "so_tk", "giao_dich"),
    })
    request_more_min_format_errors: int = 3
    use_self_consistency: bool = True

    def is_critical(self, doc_type: str, name: str) -> bool:
        return name in self.critical.get(doc_type, ())


def load_config(text: str) -> tuple[RulesConfig, Thresholds]:
    """Configuration from JSON with the keys `rules` and `thresholds`; what is absent keeps its default."""
    import json

    given = json.loads(text)
    rules, limits = given.get("rules", {}), given.get("thresholds", {})
    if "salary_patterns" in rules:
        rules["salary_patterns"] = tuple(rules["salary_patterns"])
        for p in rules["salary_patterns"]:
            re.compile(p)
    if "critical" in limits:
        limits["critical"] = {k: tuple(v) for k, v in limits["critical"].items()}
    return RulesConfig(**rules), Thresholds(**limits)


def kind_of(doc_type: str, name: str) -> str:
    return dict(SCHEMA[doc_type])[name]


def field_rows(limits: Thresholds | None = None) -> list[tuple[str, int, str, int, str, bool]]:
    """Rows (doc_type, doc_ord, field, field_ord, kind, critical) of the field dimension; 32 in all."""
    limits = limits or Thresholds()
    return [(d, i, f, j, k, limits.is_critical(d, f)) for i, d in enumerate(SCHEMA) for j, (f, k) in enumerate(SCHEMA[d])]


FIELD_DIM = "doc_type string, doc_ord int, field string, field_ord int, kind string, critical boolean"
