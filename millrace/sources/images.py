"""Image folders: files are listed a folder level at a time and opened by tasks
(other stores: Spark's ``binaryFile`` reader), their header bytes decoded
(PNG / JPEG / BMP / GIF / WebP, standard library only), plus the attribute
profile, rule checks, set checks and the metadata-only image operations
(A8, A12, C8, D4, B14, J8)."""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rowindex import global_index, written
from millrace.session import scratch_path

# --- fixed values -----------------------------------------------------------
IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp")
LABEL_EXTS = (".txt",)
FILES_PER_TASK = 10_000
# ---------------------------------------------------------------------------

LISTING_SCHEMA = "file string, is_folder boolean, size long"
ATTR_SCHEMA = "path string, width int, height int, mode string, format string, error string"


def image_header(data: bytes) -> tuple[int, int, str, str]:
    """(width, height, mode, format) from an image's header, wherever the frame
    header of a JPEG stands behind its other segments."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth, ctype = struct.unpack(">IIBB", data[16:26])
        mode = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[ctype]
        if ctype == 0 and depth == 1:
            mode = "1"
        elif ctype == 0 and depth == 16:
            mode = "I;16"
        return w, h, mode, "PNG"
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                i += 1
                continue
            marker = data[i + 1]
            if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
                i += 2
                continue
            seg = struct.unpack(">H", data[i + 2:i + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w, comps = struct.unpack(">HHB", data[i + 5:i + 10])
                return w, h, {1: "L", 3: "RGB", 4: "CMYK"}.get(comps, "RGB"), "JPEG"
            i += 2 + seg
        raise ValueError("no JPEG frame header")
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        bpp = struct.unpack("<H", data[28:30])[0]
        mode = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}.get(bpp, "RGB")
        return w, abs(h), mode, "BMP"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", data[6:10])
        return w, h, "P", "GIF"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF, "RGB", "WEBP"
        if kind == b"VP8L":
            b = data[21:25]
            w = 1 + (((b[1] & 0x3F) << 8) | b[0])
            h = 1 + (((b[3] & 0x0F) << 10) | (b[2] << 2) | ((b[1] & 0xC0) >> 6))
            alpha = (b[3] >> 4) & 1
            return w, h, "RGBA" if alpha else "RGB", "WEBP"
        if kind == b"VP8X":
            flags = data[20]
            w = 1 + int.from_bytes(data[24:27], "little")
            h = 1 + int.from_bytes(data[27:30], "little")
            return w, h, "RGBA" if flags & 0x10 else "RGB", "WEBP"
    raise ValueError("unrecognised image header")


def _attributes(path: str, content: bytes) -> tuple:
    try:
        w, h, m, f = image_header(content)
        return path, w, h, m, f, None
    except (ValueError, KeyError, IndexError, struct.error):  # what a damaged header leads to
        return path, None, None, None, None, "corrupt/unreadable"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([_attributes(p, c) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "width", "height", "mode", "format", "error"])


def _any_case(exts: tuple[str, ...]) -> str:
    """A glob of files with one of the extensions, in capitals or not."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in exts) + "}"


def _shared_folder(root: str) -> str | None:
    """The folder as tasks open it, if it is one of a shared file system."""
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    return root if root.startswith("/") else None


def tasks_for(spark: SparkSession, n_files: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_files // FILES_PER_TASK))


def _list_folders(base: str):
    """What lies in each folder; as for Spark's readers, names in ``_`` and ``.`` are hidden."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for folder in pdf["file"]:
                with os.scandir(os.path.join(base, folder)) as entries:
                    for x in entries:
                        if x.name.startswith(".") or x.name.startswith("_") and "=" not in x.name or x.name.endswith("._COPYING_"):
                            continue
                        below = x.is_dir()
                        rows.append((os.path.join(folder, x.name), below, 0 if below else x.stat().st_size))
                        if len(rows) == FILES_PER_TASK:
                            yield pd.DataFrame(rows, columns=["file", "is_folder", "size"])
                            rows = []
            yield pd.DataFrame(rows, columns=["file", "is_folder", "size"])
    return run


def _open_images(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                with open(os.path.join(base, name), "rb") as fh:
                    rows.append(_attributes(name, fh.read()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "mode", "format", "error"])
    return run


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """``file`` (relative) of every file below a shared folder that isn't empty.
    The folders of a level are listed by tasks and written, so that no list of
    files stands in the driver."""
    at, depth, found = scratch_path(spark, f"image-listing-{uuid.uuid4().hex}"), 0, None
    level = spark.createDataFrame([("",)], "file string")
    while found is None or not level.isEmpty():
        (level.repartition(spark.sparkContext.defaultParallelism, "file").mapInPandas(_list_folders(base), schema=LISTING_SCHEMA)
         .write.parquet(f"{at}/{depth}"))
        inside = spark.read.schema(LISTING_SCHEMA).parquet(f"{at}/{depth}")
        found = inside if found is None else found.unionByName(inside)
        level, depth = inside.filter("is_folder").select("file"), depth + 1
    return found.filter("NOT is_folder AND size > 0").select("file")


def _with_ext(files: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    return files.filter(F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1)).isin(*exts))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """A8 + C8: file (relative), width, height, mode, format, label (first
    sub-folder, NULL at top level), has_txt_label (same-stem .txt), error."""
    root = root.rstrip("/")
    base = _shared_folder(root)
    if base:
        files = list_files(spark, base)
        images, texts = _with_ext(files, IMAGE_EXTS).withColumnRenamed("file", "path"), _with_ext(files, LABEL_EXTS).withColumnRenamed("file", "path")
        attrs = images.repartition(tasks_for(spark, images.count()), "path").mapInPandas(_open_images(base), schema=ATTR_SCHEMA)
        rel = F.col("path")
    else:
        # only images are opened
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        imgs = files.option("pathGlobFilter", _any_case(IMAGE_EXTS)).load(root).select("path", "content")
        attrs = imgs.mapInPandas(_decode, schema=ATTR_SCHEMA)
        texts = files.option("pathGlobFilter", _any_case(LABEL_EXTS)).load(root).select("path")
        rel = F.regexp_replace("path", r"^.*?" + re.escape(root.split(":")[-1]) + "/", "")
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    txt = texts.select(stem.alias("__stem")).distinct().withColumn("has_txt_label", F.lit(True))
    parts = F.split(rel, "/")
    out = (attrs.withColumn("__stem", stem).join(txt, "__stem", "left")
           .select(rel.alias("file"), "width", "height", "mode", "format",
                   F.when(F.size(parts) > 1, parts[0]).alias("label"),
                   F.coalesce("has_txt_label", F.lit(False)).alias("has_txt_label"), "error"))
    # the attribute table (one small row per file) feeds several aggregates:
    # write it instead of opening every file again for each of them
    return written(out, "image-attributes")


def image_profile(scan: DataFrame, top: int = 5) -> DataFrame:
    """Per attribute (width, height, mode, format, label): null_count,
    n_unique, mixed (more than one value, not for label), top-k 'value:count'."""
    ok = scan.filter(F.col("error").isNull())
    attrs = ["width", "height", "mode", "format", "label"]
    long = ok.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("val"))
                                         for a in attrs])).alias("r")).select("r.*")
    counts = long.filter(F.col("val").isNotNull()).groupBy("attr", "val").agg(F.count(F.lit(1)).alias("n"))
    n_rows = ok.agg(F.count(F.lit(1)).alias("__n"))
    from millrace.functions.small import attach_row
    from pyspark.sql import Window
    # per attribute a distributed top-k, then ranks over at most k rows each
    heads = None
    for a in attrs:
        h = counts.filter(F.col("attr") == a).orderBy(F.desc("n"), F.asc("val")).limit(top)
        heads = h if heads is None else heads.unionByName(h)
    w = Window.partitionBy("attr").orderBy(F.desc("n"), F.asc("val"))
    ranked = heads.withColumn("rk", F.row_number().over(w))
    summary = counts.groupBy("attr").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_values"))
    tops = (ranked.filter(F.col("rk") <= top).groupBy("attr")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "val", "n"))),
                                          lambda s: F.concat(s["val"], F.lit(":"), s["n"].cast("string"))), "|").alias("top")))
    base = F.broadcast(ok.sparkSession.createDataFrame([(a,) for a in attrs], "attr string"))
    out = attach_row(base.join(summary, "attr", "left").join(tops, "attr", "left"), n_rows)
    return out.select("attr", (F.col("__n") - F.coalesce("n_values", F.lit(0))).alias("null_count"),
                      F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
                      ((F.col("attr") != "label") & (F.col("n_unique") > 1)).alias("mixed"), "top")


def image_set_check(spark: SparkSession, root: str, declared_n: int | None = None,
                    declared_formats: dict | None = None) -> DataFrame:
    """n_images, per-format counts and label-file count, compared with
    the declared values (mismatch flags). One listing job (no content read)."""
    base = _shared_folder(root)
    files = list_files(spark, base) if base else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"))
    listing = files.select(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).alias("ext"))
    counts = listing.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
    img = counts.filter(F.col("ext").isin(*[e[1:] for e in IMAGE_EXTS]))
    rows = img.select(F.lit("format").alias("kind"), F.col("ext").alias("key"), "n")
    tot = img.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("n_images").alias("kind"), F.lit(None).cast("string").alias("key"), "n")
    lab = (counts.filter(F.col("ext").isin(*[e[1:] for e in LABEL_EXTS])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
           .select(F.lit("label_files").alias("kind"), F.lit(None).cast("string").alias("key"), "n"))
    out = rows.unionByName(tot).unionByName(lab)
    decl = [("n_images", None, declared_n)] + [("format", k, v) for k, v in (declared_formats or {}).items()]
    d = spark.createDataFrame(decl, "kind string, key string, declared bigint")
    cond = out["kind"].eqNullSafe(d["kind"]) & out["key"].eqNullSafe(d["key"])
    return (out.join(d, cond, "left").select(out["kind"], out["key"], "n", "declared")
            .withColumn("mismatch", F.col("declared").isNotNull() & ~F.col("n").eqNullSafe(F.col("declared"))))


def image_ops(scan: DataFrame, target_mode: str = "RGB", target_size: tuple[int, int] | None = None) -> DataFrame:
    """J8 metadata-only operations: mode unify, resize, stats and label
    re-index. Originals are untouched; the result is the attribute table as
    it would be after the operations, with a label_index column."""
    ok = scan.filter(F.col("error").isNull())
    if target_size is None:
        common = (ok.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n"))
                  .orderBy(F.desc("n"), "width", "height").first())
        target_size = (common["width"], common["height"]) if common else (None, None)
    labels = ok.select("label").filter(F.col("label").isNotNull()).distinct()
    idx = global_index(labels, ["label"], "label_index", unique_key=True).withColumn("label_index", F.col("label_index").cast("int"))
    return (ok.join(idx, "label", "left")  # AQE broadcasts the class table when its runtime size allows
            .select("file", F.lit(target_size[0]).alias("width"), F.lit(target_size[1]).alias("height"),
                    F.lit(target_mode).alias("mode"), "format", "label", "label_index",
                    F.col("mode").alias("mode_before"), F.col("width").alias("width_before"),
                    F.col("height").alias("height_before")))


def image_stats(scan: DataFrame) -> DataFrame:
    """J8 stats: files per mode and distinct (width, height) sizes per mode."""
    ok = scan.filter(F.col("error").isNull())
    return ok.groupBy("mode").agg(F.count(F.lit(1)).alias("n_files"),
                                  F.count_distinct("width", "height").alias("n_sizes"))


# --- header-only fixture writer (tests and registered queries) --------------------
def fake_image_bytes(fmt: str, w: int, h: int, mode: str = "RGB") -> bytes:
    """Smallest header that ``image_header`` decodes (no pixel data)."""
    if fmt == "PNG":
        ctype = {"L": 0, "RGB": 2, "P": 3, "LA": 4, "RGBA": 6}[mode]
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0)
    if fmt == "JPEG":
        comps = {"L": 1, "RGB": 3, "CMYK": 4}[mode]
        return b"\xff\xd8" + b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * comps, 8, h, w, comps) + b"\x00" * (3 * comps)
    if fmt == "BMP":
        bpp = {"1": 1, "P": 8, "RGB": 24}[mode]
        return b"BM" + b"\x00" * 12 + struct.pack("<IiiHH", 40, w, h, 1, bpp) + b"\x00" * 24
    if fmt == "GIF":
        return b"GIF89a" + struct.pack("<HH", w, h) + b"\x00" * 3
    if fmt == "WEBP":
        flags = 0x10 if mode == "RGBA" else 0
        body = b"VP8X" + struct.pack("<I", 10) + bytes([flags, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    raise ValueError(fmt)
