"""Pure-Python helpers (no Spark): header naming, audits, clamps, bins,
file headers, workbooks, specs."""

import math

import numpy as np
import pandas as pd

from millrace.operators.charts import auto_bin_count
from millrace.operators.ml import clamp_params
from millrace.operators.transforms import bounds_of
from millrace.sources.files import detect_encoding, header_audit, probe_bytes, uniquify_headers
from millrace.sources.images import fake_image_bytes, image_header
from millrace.sources.workbook import parse_xlsx, write_xlsx


def test_uniquify_cases():
    assert uniquify_headers(["a", "b", "a"])[0] == ["a", "b", "a__dup2"]
    assert uniquify_headers(["a", "a", "a"])[0] == ["a", "a__dup2", "a__dup3"]
    # generated name already taken -> counter bumps
    assert uniquify_headers(["a", "a__dup2", "a"])[0] == ["a", "a__dup2", "a__dup3"]
    # idempotent on unique names
    names = ["x", "y", "z"]
    assert uniquify_headers(uniquify_headers(names)[0])[0] == names


def test_header_audit_buckets(spark):
    raw = ["A", "A", "A", "단위", "단위.1", "단위.2", "단위.3", ""]
    named = [c if c.strip() else f"__unnamed_{i}" for i, c in enumerate(raw)]
    names, _ = uniquify_headers(named)
    headers = {"h": names, "numbers": ["0.02875", "0.025", "0.05"], "with base": ["0", "0.1", "0.2"]}
    frame = spark.createDataFrame([(h, n) for h, ns in headers.items() for n in ns], "h string, name string")
    got = {r["h"]: (r["n_dup"], r["n_unnamed"], r["n_dotn"]) for r in header_audit(frame, "h", "name").collect()}
    assert got == {"h": (2, 1, 3), "numbers": (0, 0, 0), "with base": (0, 0, 2)}


def test_encoding_probe_incremental_cut():
    text = ("헤더,값\n" + "가나다,1\n" * 20000).encode("cp949")
    assert detect_encoding(text[:65536]) == "cp949"
    utf = ("α,β\n" + "한글,2\n" * 20000).encode("utf-8")
    cut = utf[:65535]  # may cut a multibyte character
    # first codec that decodes wins; utf-8-sig also reads BOM-less UTF-8
    assert detect_encoding(cut) == "utf-8-sig"
    assert detect_encoding("﻿a,b\n1,2\n".encode("utf-8")) == "utf-8-sig"
    p = probe_bytes("x", "0,1.5,2\n3,4,5\n".encode())
    assert p["headerless"] and p["header"] == ["col_0", "col_1", "col_2"]
    p = probe_bytes("x", "a,,b\n1,2,3\n".encode())
    assert not p["headerless"] and p["header"] == ["a", "__unnamed_1", "b"]


def test_clamp_params():
    safe, notes = clamp_params("RandomForestClassifier", {"n_estimators": 5000, "max_depth": 1, "class_weight": "x",
                                                          "foo": 1, "random_state": 7})
    assert safe == {"random_state": 42, "n_estimators": 500, "max_depth": 2, "class_weight": "balanced"}
    assert len(notes) == 5


def test_bounds():
    assert bounds_of([10, 90]) == (10.0, 90.0)
    assert bounds_of({"min": 10, "max": None}) == (10.0, None)
    assert bounds_of({"min": "x"}) == (None, None)
    assert bounds_of(None) == (None, None)


def test_auto_bins_match_numpy_2_1_rule():
    rng = np.random.default_rng(42)
    for x in (rng.normal(size=1000), rng.exponential(size=357), np.arange(100.0)):
        q1, q3 = np.percentile(x, [25, 75])
        nb, lo, hi = auto_bin_count(len(x), x.min(), x.max(), q1, q3)
        ptp = x.max() - x.min()
        fd = 2 * (q3 - q1) * len(x) ** (-1 / 3)
        st = ptp / (math.log2(len(x)) + 1)
        w = min(fd, st) if fd else st
        assert nb == int(math.ceil(ptp / w))
    assert auto_bin_count(5, 3.0, 3.0, 3.0, 3.0) == (1, 2.5, 3.5)


def test_image_headers():
    for fmt, mode in (("PNG", "RGBA"), ("JPEG", "L"), ("BMP", "RGB"), ("GIF", "P"), ("WEBP", "RGB")):
        w, h, m, f = image_header(fake_image_bytes(fmt, 357, 345, mode))
        assert (w, h, m, f) == (357, 345, mode, fmt)


def test_xlsx_roundtrip():
    s1 = pd.DataFrame({"LOT_NO": ["L1", "L2"], "TEMP_1": [1.5, 2.5]})
    s2 = pd.DataFrame({"LOT_NO": ["L1", "L3"], "JUDGE": ["OK", "NG"]})
    cells = parse_xlsx(write_xlsx({"s1": s1, "s2": s2}))
    assert ("s1", 0, 1, 0, "LOT_NO") in cells
    assert ("s2", 1, 3, 1, "NG") in cells


def test_uniquify_frame_matches_sequential(spark):
    from millrace.sources.files import uniquify_frame
    headers = {1: ["a", "b", "a", "", "a"], 2: ["x", "x__dup2", "x", "x"], 3: ["p", "q"]}
    rows = [(h, i, n) for h, ns in headers.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "hid long, pos long, name string")
    got = {}
    for r in uniquify_frame(df, "hid", "pos", "name").collect():
        got.setdefault(r["hid"], {})[r["pos"]] = r["name"]
    for h, ns in headers.items():
        named = [n if n.strip() else f"__unnamed_{i}" for i, n in enumerate(ns)]
        assert [got[h][i] for i in range(len(ns))] == uniquify_headers(named)[0]


def test_classify_names_local_matches_rules():
    from millrace.plans.rules import classify_names
    got = {n: (g, s) for n, _, g, s in classify_names(
        ["LOT No.", "TimeStamp", "1ST INJECTION VELOCITY", "2nd Injection Switch Pos", "PACK PRESSURE 3",
         "BACK PRESSURE", "PASS_YN", "CNC_ServoLoad_1", "TEMP_1", "Cycle_Time", "misc"])}
    assert got["LOT No."] == ("metadata", "passthrough")
    assert got["TimeStamp"] == ("metadata", "passthrough")
    assert got["1ST INJECTION VELOCITY"] == ("injection_sequence", "sequence_preserve")
    assert got["2nd Injection Switch Pos"] == ("injection_switch_sequence", "sequence_preserve")
    assert got["PACK PRESSURE 3"] == ("pack_pressure_profile", "profile_group")
    assert got["BACK PRESSURE"] == ("back_pressure", "single_zscore")
    assert got["PASS_YN"] == ("label", "label")
    assert got["CNC_ServoLoad_1"] == ("servo_load", "single_zscore")
    assert got["TEMP_1"] == ("temperature", "single_zscore")
    assert got["Cycle_Time"] == ("cycle", "single_zscore")
    assert got["misc"] == ("unknown", "single_zscore")


def test_jpeg_frame_behind_long_metadata():
    """The frame header may stand anywhere behind other segments."""
    import struct
    image = fake_image_bytes("JPEG", 640, 480, "RGB")
    notes = b"".join(b"\xff\xe1" + struct.pack(">H", 60_002) + bytes(60_000) for _ in range(3))
    assert image_header(image[:2] + notes + image[2:]) == (640, 480, "RGB", "JPEG")


def test_workbook_shared_strings_and_missing_references():
    import io
    import zipfile
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO(write_xlsx({"a": pd.DataFrame({"x": [1]})}))
    z = zipfile.ZipFile(buf)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as w:
        for name in z.namelist():
            if "sheet1" not in name:
                w.writestr(name, z.read(name))
        w.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        w.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>1</v></c><c r="C1" t="b"><v>1</v></c><c><v>5</v></c></row><row r="4"><c t="s"><v>0</v></c><c/></row></sheetData></worksheet>')
    assert parse_xlsx(out.getvalue()) == [("a", 0, 1, 0, "two"), ("a", 0, 1, 2, "TRUE"), ("a", 0, 1, 3, "5"), ("a", 0, 4, 0, "one"), ("a", 0, 4, 1, None)]
