"""Signal operators over an ordered numeric column.

Signals are numbered with the distributed ``global_index`` after dropping
NULLs; window means and RMS windows are plain group-bys on the index, so no
task sees more than its share of the signal. The spectrum works on the
window-mean signal, which has at most 4096 points by construction; only that
bounded signal goes to one Python worker (np.fft.rfft via applyInPandas).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rowindex import global_index
from millrace.operators.profile import value_of

# --- fixed values -----------------------------------------------------------
SIGNAL_WINDOW = 4096
MIN_SIGNAL_POINTS = 8
SPECTRUM_MAX_BINS = 512
RMS_WINDOWS = 64
# ---------------------------------------------------------------------------


def indexed_signal(df: DataFrame, column: str, order_by: Sequence[str]) -> tuple[DataFrame, int]:
    """(idx, x) with NULLs dropped before numbering, and the signal length."""
    sig = df.select(*order_by, value_of(df, column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    n = sig.count()
    return global_index(sig, list(order_by), idx_col="idx", unique_key=True).select("idx", "x"), n


def window_mean_signal(df: DataFrame, column: str, order_by: Sequence[str], window: int = SIGNAL_WINDOW) -> DataFrame:
    """G1: n <= window -> the signal unchanged; else floor(n / window) windows
    averaged position-wise, the tail dropped. pos, value."""
    sig, n = indexed_signal(df, column, order_by)
    if n <= window:
        return sig.select(F.col("idx").alias("pos"), F.col("x").alias("value"))
    nwin = n // window
    return (sig.filter(F.col("idx") < nwin * window)
            .groupBy((F.col("idx") % window).alias("pos"))
            .agg(F.avg("x").alias("value")))


def _rfft_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    sig = pdf.sort_values("pos")["value"].to_numpy(dtype=float)
    freqs = np.fft.rfftfreq(len(sig))
    mag = np.abs(np.fft.rfft(sig))
    k = np.arange(len(freqs))
    if len(freqs) > SPECTRUM_MAX_BINS:
        step = len(freqs) // SPECTRUM_MAX_BINS
        k, freqs, mag = k[::step], freqs[::step], mag[::step]
    peak = float(freqs[int(np.argmax(mag))]) if len(mag) else None
    return pd.DataFrame({"k": k.astype("int64"), "freq": freqs, "magnitude": mag,
                         "window_len": np.full(len(k), len(sig), dtype="int64"),
                         "peak_freq": np.full(len(k), peak)})


def fft_spectrum(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """>= 8 points; window-mean signal; rfft magnitude and frequencies k/N;
    more than 512 bins -> every (len // 512)-th; peak taken after decimation,
    DC included. k, freq, magnitude, window_len, peak_freq."""
    wm = window_mean_signal(df, column, order_by)
    schema = "k long, freq double, magnitude double, window_len long, peak_freq double"
    n = wm.count()
    if n < MIN_SIGNAL_POINTS:
        return df.sparkSession.createDataFrame([], schema)
    # one bounded group (<= 4096 rows) per signal
    return wm.withColumn("__sig", F.lit(0)).groupBy("__sig").applyInPandas(
        lambda pdf: _rfft_frame(pdf), schema=schema)


def rms_trend(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """>= 8 points; window = max(8, n // 64); n // window windows (tail
    dropped); RMS per window. win, rms, window_size."""
    sig, n = indexed_signal(df, column, order_by)
    if n < MIN_SIGNAL_POINTS:
        return df.sparkSession.createDataFrame([], "win long, rms double, window_size long")
    window = max(MIN_SIGNAL_POINTS, n // RMS_WINDOWS)
    nwin = n // window
    return (sig.filter(F.col("idx") < nwin * window)
            .groupBy(F.floor(F.col("idx") / window).cast("long").alias("win"))
            .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
            .withColumn("window_size", F.lit(window).cast("long")))


def multi_signal_spectrum(df: DataFrame, key_cols: Sequence[str], column: str, order_by: str) -> DataFrame:
    """Spectra of many signals at once (one per key). Each signal is first
    reduced to its <= 4096-point window mean with distributed group-bys, so a
    Python worker never receives more than 4096 points per key."""
    keys = list(key_cols)
    sig = df.select(*keys, order_by, value_of(df, column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    from millrace.functions.rowindex import rank_in_group
    ranked = rank_in_group(sig, keys, [order_by], rank_col="idx")
    n = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    r = ranked.join(n, keys)
    nwin = F.floor(F.col("n") / SIGNAL_WINDOW)
    pos = F.when(F.col("n") <= SIGNAL_WINDOW, F.col("idx")).otherwise(F.col("idx") % SIGNAL_WINDOW)
    keep = (F.col("n") <= SIGNAL_WINDOW) | (F.col("idx") < nwin * SIGNAL_WINDOW)
    wm = r.filter(keep).groupBy(*keys, pos.alias("pos")).agg(F.avg("x").alias("value"), F.first("n").alias("n"))
    wm = wm.filter(F.col("n") >= MIN_SIGNAL_POINTS).drop("n")
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    schema = key_schema + ", k long, freq double, magnitude double, window_len long, peak_freq double"

    def per_key(kv, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _rfft_frame(pdf)
        for name, v in zip(keys, kv):
            out.insert(0, name, v)
        return out

    return wm.groupBy(*keys).applyInPandas(per_key, schema=schema)
