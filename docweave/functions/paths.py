"""Dotted-path ids (T16): base ids, ancestors, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a path's section types are called.
LABELS = {"phan": "Phần", "chuong": "Chương", "muc": "Mục", "dieu": "Điều", "khoan": "Khoản", "diem": "Điểm", "phu_luc_phan": "Phụ lục phần", "phu_luc": "Phụ lục", "modau": "Mở đầu", "chinh": "Phần chính"}


def base_id(path: Column) -> Column:
    """The path without the marks of repeats (``__dup_N``)."""
    return F.regexp_replace(path, r"__dup_\d+", "")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a dotted path, shortest first."""
    parts = F.split(path, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def is_ancestor(a: Column, b: Column) -> Column:
    return F.startswith(b, F.concat(a, F.lit(".")))


def is_kin(a: Column, b: Column) -> Column:
    return (a == b) | is_ancestor(a, b) | is_ancestor(b, a)


def section(path: Column, kind: str) -> Column:
    """Label of the path's section of a kind, such as ``Điều 6``; null where it has none.  ``_`` within an index is a dot."""
    index = F.regexp_extract(base_id(path), rf"(?:^|\.){kind}(?:_([^.]*))?(?=\.|$)", 1)
    has = F.rlike(base_id(path), F.lit(rf"(?:^|\.){kind}(?:_[^.]*)?(?:\.|$)"))
    return F.when(has, F.trim(F.concat(F.lit(LABELS[kind] + " "), F.replace(index, F.lit("_"), F.lit(".")))))


def document_of(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def decoded(path: Column) -> list[Column]:
    """so_hieu and a label column per section type.  ``phu_luc_phan`` is told from ``phu_luc`` (longest type first)."""
    return [document_of(path).alias("so_hieu"), *(section(path, k).alias(k) for k in LABELS if k != "phu_luc"), F.when(section(path, "phu_luc_phan").isNull(), section(path, "phu_luc")).alias("phu_luc")]
