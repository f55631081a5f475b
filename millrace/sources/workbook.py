"""Multi-sheet workbooks (xlsx) without a spreadsheet library, and the
sheet merge / stacking rules (A7, C1, U2).

Workbook bytes -> cell rows is a file-parallel job: sheets are pulled row by row
from the archive, shared strings are read once a workbook, and cells leave in
batches, so a task holds one workbook's bytes and strings but no parsed sheet.
Each sheet becomes a DataFrame by pivoting its cells on the (known) header columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rowindex import quoted
from millrace.sources.files import uniquify_headers

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELL_SCHEMA = "path string, sheet string, sheet_idx int, row long, col int, value string"
#: Rows that a sheet can hold, by the format; cells of one output batch.
SHEET_ROWS = 1_048_576
BATCH_CELLS = 8192


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _elements(stream, tag: str) -> Iterator[ET.Element]:
    """Every element of that name, one at a time; what was read is let go."""
    root = None
    for event, element in ET.iterparse(stream, ("start", "end")):
        if root is None:
            root = element
        elif event == "end" and element.tag == tag:
            yield element
            root.clear()


def _texts(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def sheet_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str | None]]:
    """(sheet, sheet_idx, row (1-based), col (0-based), value) of every cell. Rows
    and cells without a reference follow the one before."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            shared = [_texts(si) for si in _elements(f, f"{_MAIN}si")]
    target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_REL_NS}Relationship")}
    for si, sh in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
        path = target[sh.get(f"{_OFFICE}id")]
        r = 0
        with z.open(path.lstrip("/") if path.startswith("/") else "xl/" + path) as f:
            for row in _elements(f, f"{_MAIN}row"):
                r = int(row.get("r") or r + 1)
                col = -1
                for c in row.iter(f"{_MAIN}c"):
                    col = _col_index(c.get("r")) if c.get("r") else col + 1
                    kind, v = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        value = _texts(c)
                    elif v is None:
                        value = None
                    else:
                        value = shared[int(v.text)] if kind == "s" else ("TRUE" if v.text == "1" else "FALSE") if kind == "b" else v.text
                    yield sh.get("name"), si, r, col, value


def parse_xlsx(data: bytes) -> list[tuple[str, int, int, int, str | None]]:
    """All cells of a (small) workbook."""
    return list(sheet_cells(data))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string())
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            cells = sheet_cells(content)
            while some := list(islice(cells, BATCH_CELLS)):
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), *[pa.array([c[i] for c in some], k) for i, k in enumerate(kinds)]],
                                                 names=["path", "sheet", "sheet_idx", "row", "col", "value"])


def workbook_cells(files: DataFrame) -> DataFrame:
    """The cells of workbooks given as rows: ``path, content``."""
    return files.select("path", "content").mapInArrow(_cells, CELL_SCHEMA)


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of every workbook below ``path``."""
    return workbook_cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path))


def sheet_frames(cells: DataFrame) -> dict[str, DataFrame]:
    """One all-string DataFrame per sheet name: header = row 1 (blank -> __unnamed_i,
    duplicates uniquified), data = the following rows of all workbooks, with
    ``path`` and ``row_ord``. Workbooks whose sheets of one name have different headers
    are refused."""
    heads = (cells.filter(F.col("row") == 1).groupBy("sheet", "col", "value").agg(F.min("sheet_idx").alias("sheet_idx"), F.count_distinct("path").alias("n"))
             .join(cells.groupBy("sheet").agg(F.count_distinct("path").alias("books")), "sheet").orderBy("sheet_idx", "col").collect())  # header cells only
    sheets: dict[str, dict[int, str | None]] = {}
    for h in heads:
        columns = sheets.setdefault(h["sheet"], {})
        if h["col"] in columns or h["n"] != h["books"]:
            raise ValueError(f"workbooks have different headers in sheet {h['sheet']!r}")
        columns[h["col"]] = h["value"]
    out = {}
    for sheet, columns in sheets.items():
        names = [v if (v is not None and str(v).strip()) else f"__unnamed_{i}" for i, v in enumerate(columns.values())]
        names, _ = uniquify_headers(names)
        data = cells.filter((F.col("sheet") == sheet) & (F.col("row") > 1))
        wide = data.groupBy("path", "row").pivot("col", list(columns)).agg(F.first("value"))
        out[sheet] = wide.select("path", F.col("row").alias("row_ord"), *[quoted(str(c)).alias(n) for c, n in zip(columns, names, strict=True)])
    return out


def build_workbooks(sheets: Mapping[str, DataFrame], by: str, order_by: str) -> DataFrame:
    """One workbook per value of ``by``, as rows ``path, content``: each frame's
    rows of that value are a sheet, in ``order_by`` order. A workbook is built in one
    task, which the format bounds: more rows than a sheet can hold are refused."""
    parts = None
    for i, (name, df) in enumerate(sheets.items()):
        columns = [c for c in df.columns if c != by]
        row = df.select(quoted(by).cast("string").alias("path"), F.lit(i).alias("sheet"), quoted(order_by).cast("string").alias("at"),
                        F.array(*[quoted(c).cast("string") for c in columns]).alias("cells"))
        parts = row if parts is None else parts.unionByName(row)
    heads = {name: ([c for c in df.columns if c != by], [str(df.schema[c].dataType.typeName()) in ("integer", "long", "double", "short", "float") for c in df.columns if c != by])
             for name, df in sheets.items()}

    def build(key, rows):
        book = {}
        for i, (name, (columns, numeric)) in enumerate(heads.items()):
            own = rows.filter(pyarrow.compute.equal(rows["sheet"], i)).sort_by("at")
            if own.num_rows >= SHEET_ROWS:
                raise ValueError(f"sheet {name!r} of {key[0].as_py()!r} would have more than {SHEET_ROWS} rows")
            cells = [[float(v) if n and v is not None else v for v, n in zip(r, numeric, strict=True)] for r in own["cells"].to_pylist()]
            book[name] = pd.DataFrame(cells, columns=columns, dtype=object)
        return pa.table({"path": pa.array([f"{key[0].as_py()}.xlsx"], pa.string()), "content": pa.array([write_xlsx(book)], pa.binary())})

    return parts.groupBy("path").applyInArrow(build, "path string, content binary")


def merge_sheets(frames: Sequence[DataFrame], key: str = "LOT_NO", suffix: str = "_dup") -> DataFrame:
    """More than one sheet and all carry ``key`` -> successive full
    outer merges on it (colliding non-key columns of the right side get
    ``suffix``; many-to-many allowed); otherwise the sheets are stacked by
    name with missing columns as NULL."""
    frames = list(frames)
    if len(frames) == 1:
        return frames[0]
    if all(key in f.columns for f in frames):
        def step(left: DataFrame, right: DataFrame) -> DataFrame:
            ren = {c: (c + suffix if c in left.columns and c != key else c) for c in right.columns}
            r = right.select(*[F.col(f"`{c}`").alias(n) for c, n in ren.items()])
            return left.join(r, key, "full")
        return reduce(step, frames)
    return union_by_name(frames)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames with differing columns (missing -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_xlsx(sheets: dict[str, pd.DataFrame]) -> bytes:
    """Minimal xlsx writer (inline strings, numbers) for fixtures and exports."""
    buf = io.BytesIO()
    z = zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED)

    def colname(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    names = list(sheets)
    z.writestr("[Content_Types].xml",
               '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
               '<Default Extension="xml" ContentType="application/xml"/>'
               '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
               '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
               + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" '
                         'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                         for i in range(len(names))) + "</Types>")
    z.writestr("_rels/.rels",
               '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
               '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
               'Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml",
               '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
               'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
               + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
               + "</sheets></workbook>")
    z.writestr("xl/_rels/workbook.xml.rels",
               '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
               + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
                         f'Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
    for i, n in enumerate(names):
        pdf = sheets[n]
        rows = [list(pdf.columns)] + pdf.astype(object).where(pdf.notna(), None).values.tolist()
        xml = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
        for r, vals in enumerate(rows, start=1):
            xml.append(f'<row r="{r}">')
            for c, v in enumerate(vals):
                ref = f"{colname(c)}{r}"
                if v is None:
                    continue
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    xml.append(f'<c r="{ref}"><v>{v}</v></c>')
                else:
                    xml.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
            xml.append("</row>")
        xml.append("</sheetData></worksheet>")
        z.writestr(f"xl/worksheets/sheet{i + 1}.xml", "".join(xml))
    z.close()
    return buf.getvalue()
