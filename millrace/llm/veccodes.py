"""Vector code compression with norm-of-sum bounds.

Vectors are cut into parts, and every part is coded by the nearest entry of its
position's codebook, which a few rounds of reassignment and averaging fit. Each
part keeps an upper bound of the distance to its own entry and a lower bound per
group of the others, each stamped with the round in which it was measured. All
rounds' codebooks are kept, so a bound is brought up to date by the length of its
entry's true net displacement since its stamp, which is at most the sum of the
single rounds' moves. Only groups that the bounds can't rule out are scanned
again. All distances are exact integers.

A round is one pass without a shuffle: rows are read, coded and written with their
bounds, and each task adds one row with its sums by entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Groups of entries that have a lower bound of their own.
GROUPS = 8
#: Rows handled at once in a task, and labels whose sums are broadcast.
CHUNK_ROWS = 8192
BROADCAST_LABELS = 100_000
#: Share by which bounds are widened; many times the rounding of 32-bit floats.
_SLACK = 1e-6


def _state_type(groups: int) -> np.dtype:
    return np.dtype([("code", "u1"), ("up_at", "u1"), ("low_at", "u1", (groups,)), ("up", "<f4"), ("low", "<f4", (groups,))])


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances; exact, as the caller's type holds all partial sums."""
    return (x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1) - 2 * (x @ entries.T)


def entry_groups(entries: np.ndarray, groups: int) -> np.ndarray:
    """Group of every entry: the nearest of ``groups`` entries far apart."""
    pivots, least = [0], _squares(entries, entries[[0]])[:, 0]
    while len(pivots) < min(groups, len(entries)):
        pivots.append(int(least.argmax()))
        least = np.minimum(least, _squares(entries, entries[[pivots[-1]]])[:, 0])
    return _squares(entries, entries[pivots]).argmin(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign(x: np.ndarray, state: np.ndarray, history: list[np.ndarray], group: np.ndarray, first: bool) -> int:
    """Bring ``state`` (code and bounds of every row) to the latest codebook of
    ``history``; returns the number of distances that were computed."""
    now, entries = len(history) - 1, history[-1]
    members = [np.flatnonzero(group == g) for g in range(state["low"].shape[1])]
    if first:
        far = _squares(x, entries)
        state["code"] = code = far.argmin(axis=1)
        rows = np.arange(len(x))
        state["up"], state["up_at"], state["low_at"] = _up(np.sqrt(far[rows, code])), now, now
        far = far.astype(np.float64)
        far[rows, code] = np.inf
        for g, m in enumerate(members):
            state["low"][:, g] = _down(np.sqrt(far[:, m].min(axis=1))) if len(m) else np.inf
        return far.size
    moved = np.stack([np.sqrt(((entries - old) ** 2).sum(axis=1).astype(np.float64)) for old in history])
    most = np.stack([moved[:, m].max(axis=1) if len(m) else np.zeros(len(history)) for m in members], axis=1)
    upper = state["up"] + moved[state["up_at"], state["code"]]
    lower = state["low"] - most[state["low_at"], np.arange(len(members))]
    slack = _SLACK * (1 + upper[:, None] + np.where(np.isinf(state["low"]), 0, state["low"]))
    open_ = np.flatnonzero((lower <= upper[:, None] + slack).any(axis=1))
    if not len(open_):
        return 0
    own = state["code"][open_].astype(np.int64)
    best = ((x[open_] - entries[own]) ** 2).sum(axis=1)
    mine, done = best.copy(), len(open_)
    code = own.copy()
    upper = np.sqrt(best.astype(np.float64))
    low = lower[open_]
    scan = low <= upper[:, None] + slack[open_]
    nearest, second = np.full(scan.shape, -1), np.full(scan.shape, np.inf)
    leading = np.full(scan.shape, np.inf)
    for g, m in enumerate(members):
        k = np.flatnonzero(scan[:, g])
        if not len(k) or not len(m):
            continue
        far = _squares(x[open_[k]], entries[m])
        done += far.size
        at = far.argmin(axis=1)
        least = far[np.arange(len(k)), at]
        nearest[k, g], leading[k, g] = m[at], least
        far = far.astype(np.float64)
        far[np.arange(len(k)), at] = np.inf
        second[k, g] = far.min(axis=1)
        nearer = (least < best[k]) | ((least == best[k]) & (m[at] < code[k]))
        best[k[nearer]], code[k[nearer]] = least[nearer], m[at[nearer]]
    low = np.where(scan, np.sqrt(np.where(nearest == code[:, None], second, leading)), low)
    at = np.where(scan, now, state["low_at"][open_])
    kept = np.where(scan, low, state["low"][open_])
    # a group that was not scanned and whose own entry was left now holds that entry too
    left = np.flatnonzero((code != own) & ~scan[np.arange(len(own)), group[own]])
    g = group[own[left]]
    kept[left, g], at[left, g] = np.minimum(low[left, g], np.sqrt(mine[left].astype(np.float64))), now
    state["code"][open_], state["up"][open_], state["up_at"][open_] = code, _up(np.sqrt(best.astype(np.float64))), now
    state["low"][open_], state["low_at"][open_] = _down(np.maximum(kept, 0)), at
    return done


class _Shape:
    """Sizes and types of the vectors: ``work`` holds every distance exactly."""

    def __init__(self, width: int, largest: float, parts: int, entries: int, scale: int, groups: int) -> None:
        self.parts, self.entries, self.scale, self.groups = parts, entries, scale, groups
        self.part_width = max(1, math.ceil(width / parts))
        self.width = self.part_width * parts
        self.limit = math.isqrt((1 << 62) // (4 * self.part_width))
        top = min(self.limit, math.floor(largest * scale) + 1)
        self.work = np.dtype(np.float64 if 4 * self.part_width * top * top < 1 << 53 else np.int64)
        self.stored = np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")
        self.state = _state_type(groups)

    def integers(self, column: pa.ListArray) -> np.ndarray:
        """Components as integers, short vectors filled up with zeros."""
        lengths = column.value_lengths().to_numpy()
        flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out = np.zeros((len(lengths), self.width), np.int64)
        values = np.clip(np.floor(flat * self.scale), -self.limit, self.limit).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        return out

    def part(self, x: np.ndarray, p: int) -> np.ndarray:
        return x[:, p * self.part_width:(p + 1) * self.part_width]


def _chunks(batches) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _binary(column: pa.ChunkedArray, kind: np.dtype, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``width`` items."""
    data, at = _column(column)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind).reshape(-1, width).copy()


def _column(column: pa.ChunkedArray):
    array = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    _, at, data = array.buffers()
    return data, np.frombuffer(at, np.int64)[array.offset:array.offset + len(array) + 1]


def _blobs(rows: np.ndarray) -> pa.Array:
    width = rows.itemsize * rows.shape[1]
    at = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _load(table: pa.Table, shape: _Shape, raw: bool) -> tuple[np.ndarray, np.ndarray]:
    if raw:
        return shape.integers(table["vector"].combine_chunks()), np.zeros((table.num_rows, shape.parts), shape.state)
    return _binary(table["x"], shape.stored, shape.width).astype(np.int64), _binary(table["state"], shape.state, shape.parts)


def _round(shape: _Shape, history: list[np.ndarray], group: np.ndarray, raw: bool):
    """Code every row, and add up the rows of each entry."""
    def run(batches):
        books = [h.astype(shape.work) for h in history]
        sums = np.zeros((shape.parts, shape.entries, shape.part_width + 1), np.int64)
        scanned = 0
        for table in _chunks(batches):
            x, state = _load(table, shape, raw)
            for p in range(shape.parts):
                values = shape.part(x, p)
                own = state[:, p].copy()
                scanned += assign(values.astype(shape.work), own, [b[p] for b in books], group[p], raw)
                state[:, p] = own
                order = np.argsort(own["code"], kind="stable")
                used, heads, count = np.unique(own["code"][order], return_index=True, return_counts=True)
                sums[p, used, :-1] += np.add.reduceat(values[order], heads, axis=0)
                sums[p, used, -1] += count
            n = table.num_rows
            yield from pa.table([table["vec_id"], table["label"], _blobs(x.astype(shape.stored)), _blobs(state), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())],
                                names=["vec_id", "label", "x", "state", "sums", "scanned"]).to_batches()
            label = table.schema.field("label").type
        if sums[:, :, -1].any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, label), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                              pa.array([sums.tobytes()], pa.binary()), pa.array([scanned], pa.int64())], names=["vec_id", "label", "x", "state", "sums", "scanned"])
    return run


def _entry_sums(shape: _Shape):
    def run(batches):
        for batch in batches:
            for packed in batch["sums"].to_pylist():
                sums = np.frombuffer(packed, np.int64).reshape(shape.parts * shape.entries, -1)
                used = np.flatnonzero(sums[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(used // shape.entries, pa.int32()), pa.array(used % shape.entries, pa.int32()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                                                 names=["part", "entry", "sums"])
    return run


def _moved_entries(written: DataFrame, shape: _Shape, book: np.ndarray) -> np.ndarray:
    """The next codebook: componentwise floor(sum / count) of each entry's parts.
    The driver sees one row per entry of the codebook."""
    rows = written.filter(F.col("sums").isNotNull()).select("sums").mapInArrow(_entry_sums(shape), "part int, entry int, sums array<long>")
    total = rows.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(shape.part_width + 1)]).alias("sums"))
    book = book.copy()
    for part, entry, sums in total.collect():
        *sums, count = (int(v) for v in sums)
        book[part, entry] = [v // count for v in sums]
    return book


def _final(shape: _Shape, history: list[np.ndarray], group: np.ndarray, raw: bool):
    def run(batches):
        books = [h.astype(shape.work) for h in history]
        for table in _chunks(batches):
            x, state = _load(table, shape, raw)
            error, codes = np.zeros(table.num_rows, np.int64), np.empty((table.num_rows, shape.parts), np.uint8)
            for p in range(shape.parts):
                values = shape.part(x, p)
                own = state[:, p].copy()
                assign(values.astype(shape.work), own, [b[p] for b in books], group[p], raw)
                codes[:, p] = own["code"]
                error += ((values - history[-1][p][own["code"]]) ** 2).sum(axis=1)
            yield from pa.table([table["vec_id"], table["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())],
                                names=["vec_id", "label", "code", "error"]).to_batches()
    return run


class Codebooks:
    """Fitted codebooks: ``history`` of integer arrays (part, entry, component),
    the last one final, and ``scanned``: exact distances computed a round."""

    def __init__(self, history: list[np.ndarray], scanned: list[int]) -> None:
        self.history, self.scanned = history, scanned

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, groups: int = GROUPS,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, ``vec_id, label, code, error, label_error``, and the
    codebooks.

    A component x counts as floor(scale * x). The codebooks begin as the parts of
    the ``entries`` smallest ids (fewer, if there are fewer vectors); a round gives
    every part its nearest entry (ties: the lower index) and moves every entry to
    the floor of its parts' mean; an entry without parts stays. ``code`` has two hex digits
    per part; ``error`` is the summed squared distance; ``label_error`` its sum
    over rows of the same label, NULLs together.

    Left out are NULL vectors and those with a NULL, NaN or infinite component.
    Vectors shorter than the longest, or than a multiple of ``parts``, count as
    filled up with zeros. Equal ids are ordered by their vectors, NULL ids come
    last; repeated rows are coded each. Integers beyond what 64-bit distances
    hold exactly (2 ** 28 in parts of 16 components) count as that bound. An empty table
    gives an empty result; other columns are ignored.
    """
    if not 1 <= entries <= 256 or rounds > 254:
        raise ValueError("codes have one byte a part: at most 256 entries and 254 rounds")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    width, largest = rows.agg(F.max(F.size("vector")), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).toArrow()
    shape = _Shape(width or 0, largest or 0.0, parts, max(1, head.num_rows), scale, groups)
    start = shape.integers(head["vector"].combine_chunks()) if head.num_rows else np.zeros((1, shape.width), np.int64)
    history = [start.reshape(-1, parts, shape.part_width).transpose(1, 0, 2)]
    group = np.stack([entry_groups(history[0][p].astype(shape.work), groups) for p in range(parts)])
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, x binary, state binary, sums binary, scanned long"
    held, raw, scanned = rows, True, []
    for k in range(rounds):
        written = materialize(held.mapInArrow(_round(shape, list(history), group, raw), schema), f"vector-codes-{k}")
        history.append(_moved_entries(written, shape, history[-1]))
        scanned.append(int(written.agg(F.sum("scanned")).first()[0] or 0))
        held, raw = written.filter(F.col("sums").isNull()).select("vec_id", "label", "x", "state"), False
    coded = materialize(held.mapInArrow(_final(shape, history, group, raw), f"vec_id long, label {label}, code string, error long"), "vector-codes")
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error"), Codebooks(history, scanned)
