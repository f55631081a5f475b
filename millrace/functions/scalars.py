"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Cell values that the masking cleanup treats as "no value" (compared after trim).
MASK_TOKENS = ("*", "**", "***", "-", "N/A", "n/a", "null", "NULL", "")

# Words a CSV reader treats as missing on read (pandas' default NA words).
CSV_NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ---------------------------------------------------------------------------

# A plain decimal / scientific number, optionally signed and padded.  Spark's
# cast also accepts "1d", "1f" and similar suffixes; pandas does not, so the
# guard keeps the two in step.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INF_PATTERN = r"(?i)^\s*[+-]?(inf|infinity)\s*$"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (Spark keeps them apart; the data model has one missing)."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def try_to_double(c: str | Column, keep_inf: bool = True) -> Column:
    """Lenient numeric parse: numbers (and numeric strings) become double,
    everything else NULL. NaN becomes NULL."""
    c = col_of(c)
    s = c.cast("string")
    ok = s.rlike(NUMBER_PATTERN)
    if keep_inf:
        ok = ok | s.rlike(INF_PATTERN)
    parsed = F.trim(s).try_cast("double")
    return F.when(ok, nan_to_null(parsed))


def is_number(c: str | Column) -> Column:
    return try_to_double(c).isNotNull()


def clean_mask(c: str | Column) -> Column:
    """Masked cells (after trim) -> NULL, the rest parsed as numbers."""
    c = col_of(c)
    s = c.cast("string")
    return F.when(~F.trim(s).isin(*MASK_TOKENS), try_to_double(s)).cast("double")


def slug(c: str | Column) -> Column:
    """lower(trim) -> runs of chars outside [a-z0-9_] become '_' -> runs of '_'
    collapsed -> leading/trailing '_' stripped."""
    c = col_of(c)
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_]+", "_")
    s = F.regexp_replace(s, r"_+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def safe_file_id(c: str | Column) -> Column:
    """Characters other than letters, digits, '-', '_' become '_'."""
    return F.regexp_replace(col_of(c), r"[^\p{L}\p{N}_-]", "_")


def percent_in_text(c: str | Column) -> Column:
    """the first figure like '12.34%' of a text, as a double; NULL without one."""
    figure = F.regexp_extract(col_of(c), r"([0-9]+[.][0-9]+)%", 1)
    return F.when(figure != "", figure.cast("double"))


def human_size(c: str | Column) -> Column:
    """Bytes -> '12.3 KB' style text (B, KB, MB, GB, TB; base 1024)."""
    b = col_of(c).cast("double")
    units = [("TB", 1024.0 ** 4), ("GB", 1024.0 ** 3), ("MB", 1024.0 ** 2), ("KB", 1024.0)]
    out = F.concat(F.format_string("%.0f", b), F.lit(" B"))
    for name, scale in reversed(units):
        out = F.when(b >= scale, F.concat(F.format_string("%.1f", b / scale), F.lit(" " + name))).otherwise(out)
    return out


def iso_utc(ts: Column) -> Column:
    """a timestamp as ISO text with microseconds; the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_time(text: Column, patterns: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd")) -> Column:
    """the timestamp of the first pattern that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])


def utc_now() -> Column:
    """the time the query began, as ISO text."""
    return iso_utc(F.current_timestamp())
