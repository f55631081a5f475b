"""Waveform matrices: a wide block of numeric-named columns (time offsets)
packed into one array column per capture, and the header checks against a
declared descriptor (A11, G4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.files import is_number_text


def split_header(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """(scalar columns, numeric-named columns) in source order."""
    return [n for n in names if not is_number_text(n)], [n for n in names if is_number_text(n)]


def verify_waveform(names: Sequence[str], declared: dict) -> dict:
    """Header vs descriptor: n_cols, window [min, max] (1e-6), timestamp column,
    numeric block trailing. Returns measured values and warning codes."""
    scalar, numeric = split_header(names)
    warnings = []
    if declared.get("n_cols") is not None and declared["n_cols"] != len(numeric):
        warnings.append("n_cols_mismatch")
    if numeric and declared.get("window"):
        vals = sorted(float(c) for c in numeric)
        lo, hi = declared["window"]
        if abs(vals[0] - lo) > 1e-6 or abs(vals[-1] - hi) > 1e-6:
            warnings.append("window_mismatch")
    ts = declared.get("timestamp_col")
    if ts and ts not in scalar:
        warnings.append("timestamp_col_missing")
    trailing = list(names[len(names) - len(numeric):]) == numeric if numeric else True
    if not trailing:
        warnings.append("numeric_block_not_trailing")
    return {"scalar_cols": scalar, "n_numeric": len(numeric), "trailing": trailing, "warnings": warnings}


def waveform_pack(df: DataFrame, array_col: str = "wave") -> tuple[DataFrame, DataFrame]:
    """Pack the numeric-named block into ``array<double>`` (source order) and
    return (packed frame, axis frame with one row per offset)."""
    scalar, numeric = split_header(df.columns)
    packed = df.select(*[F.col(f"`{c}`") for c in scalar],
                       F.array(*[F.col(f"`{c}`").cast("double") for c in numeric]).alias(array_col))
    axis = df.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate(numeric)], "pos int, offset double")
    return packed, axis
