"""Personal data: patterns, and a linear-chain conditional random field over
word shapes that adds what the patterns' exact forms miss.

The field is trained on a small labelled table: lines around the patterns' own
finds in a bounded sample of documents, and the same lines with the finds
rewritten in forms that people also use (a number without its leading plus, a
card with dots). Words without a digit or an at sign are never personal data
here, so they cut a text into short chains; all chains of a batch are decoded
together by Viterbi in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import doc_rows

KINDS = ("email", "ip", "card", "phone")
#: Documents, at most, whose finds make up the labelled table.
MAX_FIT_ROWS = 400
#: Least posterior of every word of a span that the field adds.
MIN_POSTERIOR = 0.9
EPOCHS = 120

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a digit run that can't begin a match can't begin one further right either, so
# the possessive forms find what the plain ones find, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
_EDGE = "\"'()[]{}<>,;:!?"


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    digits = _digits(found)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else "@" in found


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' valid matches, by kind, then start."""
    if not _HINT.search(text):
        return []
    spans = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return spans


# ---- chains of words -------------------------------------------------------

LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]


def _shape(word: str) -> str:
    out = []
    for c in word[:40]:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


def _features(word: str, before: str, after: str) -> list[str]:
    digits = _digits(word)
    shape = _shape(word)
    return [f"s={shape}", f"b={_shape(before)}", f"a={_shape(after)}", f"n={min(len(digits), 20)}", f"d={min(word.count('.'), 4)}{min(word.count('-'), 4)}{'@' in word}",
            f"h={shape[:2]}", f"t={shape[-2:]}", f"l={min(len(word), 24) // 3}", f"ds={shape}/{len(digits)}", "1"]


def _chains(text: str):
    """Spans of the words of every chain: neighbouring words with a digit or an
    at sign; with the word before and the one after."""
    words = [m.span() for m in _WORD.finditer(text)]
    i, n = 0, len(words)
    while i < n:
        if not _HINT.search(text, *words[i]):
            i += 1
            continue
        j = i
        while j < n and _HINT.search(text, *words[j]):
            j += 1
        yield words[i:j], text[slice(*words[i - 1])] if i else "", text[slice(*words[j])] if j < n else ""
        i = j


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes and marks around (brackets stay where both are inside)."""
    while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
        start += 1
    while end > start and (text[end - 1] in _EDGE or text[end - 1] == "."):
        end -= 1
    return start, end


class Field:
    """Weights of features by label and of steps between labels."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        ids = np.array([[self.names.get(f, len(self.names)) for f in r] for r in rows])
        return self.emit[ids].sum(axis=1)

    def _padded(self, scores: np.ndarray, lengths: np.ndarray):
        """(chains, longest, labels), closed by O's that cost nothing to pass."""
        at = np.concatenate(([0], np.cumsum(lengths)))
        longest = int(lengths.max())
        place = np.minimum(at[:-1, None] + np.arange(longest), len(scores) - 1)
        inside = np.arange(longest) < lengths[:, None]
        return scores[place], inside

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label of every word (Viterbi) and that label's posterior, chain
        after chain; chains begin and end next to an O."""
        labels, sure = np.zeros(len(scores), np.int64), np.zeros(len(scores))
        at = np.concatenate(([0], np.cumsum(lengths)))
        size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for z in np.unique(size):  # chains of like length together: memory stays near the words'
            group = np.flatnonzero(size == z)
            rows = np.concatenate([np.arange(at[g], at[g + 1]) for g in group])
            emit, inside = self._padded(scores[rows], lengths[group])
            n, longest, k = emit.shape
            best, back = np.empty_like(emit), np.zeros((n, longest, k), np.int64)
            alpha = np.empty_like(emit)
            best[:, 0] = alpha[:, 0] = emit[:, 0] + self.step[0]
            for t in range(1, longest):
                total = best[:, t - 1, :, None] + self.step
                back[:, t] = total.argmax(axis=1)
                go = inside[:, t, None]
                best[:, t] = np.where(go, total.max(axis=1) + emit[:, t], best[:, t - 1])
                alpha[:, t] = np.where(go, _logsum(alpha[:, t - 1, :, None] + self.step, 1) + emit[:, t], alpha[:, t - 1])
            end = self.step[:, 0]
            path = np.empty((n, longest), np.int64)
            path[:, -1] = (best[:, -1] + end).argmax(axis=1)
            beta = np.broadcast_to(end, (n, k)).copy()
            norm = _logsum(alpha[:, -1] + end, 1)
            post = np.empty((n, longest))
            for t in range(longest - 1, -1, -1):
                if t < longest - 1:
                    go = inside[:, t + 1]
                    path[:, t] = np.where(go, back[np.arange(n), t + 1, path[:, t + 1]], path[:, t + 1])
                    beta = np.where(go[:, None], _logsum(self.step + (emit[:, t + 1] + beta)[:, None, :], 2), beta)
                post[:, t] = np.exp((alpha[:, t] + beta)[np.arange(n), path[:, t]] - norm)
            labels[rows], sure[rows] = path[inside], post[inside]
        return labels, sure


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _labelled(text: str, spans: list[tuple[str, int, int]]):
    """(features, labels) of every chain of a text with known spans."""
    for words, before, after in _chains(text):
        strings = [before, *[text[s:e] for s, e in words], after]
        labels = []
        for s, e in words:
            inside = next(((k, a) for k, a, b in spans if a < e and s < b), None)
            labels.append(0 if inside is None else LABELS.index(f"{'B' if inside[1] >= s else 'I'}-{inside[0]}"))
        yield [_features(strings[i + 1], strings[i], strings[i + 2]) for i in range(len(words))], labels


def _rewritten(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its numbers in other usual forms, and the spans there."""
    out, moved, at = "", [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s < at:
            continue
        found = text[s:e]
        if kind == "phone":
            rest = re.sub(r"^\+[0-9]{1,3}[ .-]", "", found)
            found = rest if len(_digits(rest)) >= 9 else found[1:]
        elif kind == "card" and found.isdigit() and len(found) == 16:
            found = ".".join(found[i:i + 4] for i in range(0, 16, 4))
        out += text[at:s] + found
        moved.append((kind, len(out) - len(found), len(out)))
        at = e
    return out + text[at:], moved


def train(texts: list[str], epochs: int = EPOCHS, penalty: float = 0.02) -> Field:
    """Maximum likelihood by gradient steps on the labelled chains of ``texts``
    (deterministic). Without any find every label but O is ruled out."""
    chains = []
    for text in texts:
        spans = pattern_spans(text)
        chains += list(_labelled(text, spans))
        if spans:
            chains += list(_labelled(*_rewritten(text, spans)))
    chains = [(f[:64], y[:64]) for f, y in chains]
    names: dict[str, int] = {}
    for rows, _ in chains:
        for r in rows:
            for f in r:
                names.setdefault(f, len(names))
    k = len(LABELS)
    emit, step = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    forbidden = np.zeros((k, k), bool)
    for i in range(2, k, 2):  # I-kind follows B-kind or I-kind only
        forbidden[:, i] = True
        forbidden[[i - 1, i], i] = False
    if not any(any(y) for _, y in chains):
        emit[:, 1:] = -50.0
        return Field(names, emit, np.where(forbidden, -1e4, 0.0))
    ids = [np.array([[names[f] for f in r] for r in rows]) for rows, _ in chains]
    lengths = np.array([len(y) for _, y in chains])
    longest = int(lengths.max())
    inside = np.arange(longest) < lengths[:, None]
    x = np.full((len(chains), longest, ids[0].shape[1]), len(names))
    y = np.zeros((len(chains), longest), np.int64)
    for c, (i, (_, labels)) in enumerate(zip(ids, chains, strict=True)):
        x[c, :len(labels)], y[c, :len(labels)] = i, labels
    n = len(chains)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, step)]
    previous = np.concatenate((np.zeros((n, 1), np.int64), y), axis=1)[:, :-1]
    last = y[np.arange(n), lengths - 1]
    for epoch in range(1, epochs + 1):
        moves = np.where(forbidden, -1e4, step)
        e = emit[x].sum(axis=2)
        alpha, beta = np.empty((n, longest, k)), np.empty((n, longest, k))
        alpha[:, 0] = e[:, 0] + moves[0]
        for t in range(1, longest):
            alpha[:, t] = np.where(inside[:, t, None], _logsum(alpha[:, t - 1, :, None] + moves, 1) + e[:, t], alpha[:, t - 1])
        norm = _logsum(alpha[:, -1] + moves[:, 0], 1)
        beta[:, -1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(inside[:, t + 1, None], _logsum(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), beta[:, t + 1])
        post = np.exp(alpha + beta - norm[:, None, None]) * inside[..., None]
        want = np.eye(k)[y] * inside[..., None]
        grad_emit = np.zeros_like(emit)
        np.add.at(grad_emit, x, (want - post)[:, :, None, :])
        grad_step = np.zeros_like(step)
        np.add.at(grad_step, (previous[inside], y[inside]), 1.0)
        np.add.at(grad_step, (last, 0), 1.0)
        grad_step[0] -= post[:, 0].sum(axis=0)
        grad_step[:, 0] -= post[np.arange(n), lengths - 1].sum(axis=0)
        for t in range(1, longest):
            on = inside[:, t]
            if on.any():
                pair = alpha[on, t - 1, :, None] + moves + (e[on, t] + beta[on, t])[:, None, :] - norm[on, None, None]
                grad_step -= np.exp(pair).sum(axis=0)
        grad_emit[len(names)] = 0
        for w, g, m in ((emit, grad_emit / n - penalty / n * emit, moments[0]), (step, grad_step / n - penalty / n * step, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w += 0.2 * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.99**epoch)) + 1e-8)
    return Field(names, emit, np.where(forbidden, -1e4, step))


def fit(docs: DataFrame, max_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Train on the finds in the ``max_rows`` documents whose ids' hashes are
    smallest in a thinned-out set of documents with a digit or an at sign."""
    rows = doc_rows(docs, id_col, text_col)
    every = max(1, rows.count() // (8 * max_rows))
    drawn = F.xxhash64("doc_id", F.lit(3))
    got = (rows.filter((F.pmod(drawn, F.lit(every)) == 0) & F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000))
           .orderBy(drawn, "text").limit(max_rows).select("text").collect())
    return train([r["text"] for r in got])


def add_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field, least: float) -> list[list[tuple[str, int, int]]]:
    """The field's spans that overlap no span of the patterns, per text."""
    rows, lengths, where = [], [], []
    for i, text in enumerate(texts):
        if _HINT.search(text):
            for words, before, after in _chains(text):
                strings = [before, *[text[s:e] for s, e in words], after]
                rows += [_features(strings[j + 1], strings[j], strings[j + 2]) for j in range(len(words))]
                lengths.append(len(words))
                where.append((i, words))
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return found
    labels, sure = field.decode(field.scores(rows), np.array(lengths))
    at = 0
    for (i, words), n in zip(where, lengths, strict=True):
        y, p = labels[at:at + n].tolist(), sure[at:at + n].tolist()
        at += n
        t = 0
        while t < n:
            if y[t] == 0:
                t += 1
                continue
            kind, end = LABELS[y[t]][2:], t + 1
            while end < n and y[end] and LABELS[y[end]] == f"I-{kind}":
                end += 1
            if min(p[t:end]) >= least:
                s, e = _trim(texts[i], words[t][0], words[end - 1][1])
                if s < e and _valid(kind, texts[i][s:e]) and not any(a < e and s < b for _, a, b in base[i]):
                    found[i].append((kind, s, e))
            t = end
    return found


def _spans_of(texts: list[str], field: Field, least: float):
    base = [pattern_spans(t) for t in texts]
    added = add_spans(texts, base, field, least)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, [sorted(b + a, key=lambda x: (order[x[0]], x[1])) for b, a in zip(base, added, strict=True)]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None, least: float = MIN_POSTERIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (the patterns' finds),
    ``base`` and ``spans``: kind:start:end by kind, then start, joined by
    commas, in code points, end exclusive; ``spans`` has the field's too.

    NULL texts are empty; empty texts have no spans; NULL ids, ties and repeated
    rows are rows like any other; an empty table gives an empty result; other
    columns are ignored. The field adds only spans that pass their kind's checks
    (digits, Luhn sum, parts) and overlap none of the patterns'.
    """
    field = field or fit(docs, id_col=id_col, text_col=text_col)

    def run(batches):
        for batch in batches:
            base, every = _spans_of(batch["text"].to_pylist(), field, least)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, pa.array([_joined(b) for b in base], pa.string()), pa.array([_joined(e) for e in every], pa.string())],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])
    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(docs: DataFrame, field: Field | None = None, least: float = MIN_POSTERIOR, id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with every span replaced by its kind in
    square brackets; ``length_col``, where there is one, follows the text. Texts
    without personal data, and NULLs, stay as they are."""
    field = field or fit(docs, id_col=id_col, text_col=text_col)
    names = docs.columns

    def clean(text: str, spans) -> str:
        out, at = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if e > at:
                out += [text[at:max(s, at)], f"[{kind}]" if s >= at else ""]
                at = e
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            texts = batch[text_col].to_pylist()
            spans = _spans_of([t or "" for t in texts], field, least)[1]
            new = [clean(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = {n: batch[n] for n in names}
            columns[text_col] = pa.array(new, batch[text_col].type)
            if length_col in columns:
                kind = batch[length_col].type
                columns[length_col] = pa.array([len(n) if s else v for n, s, v in zip(new, spans, batch[length_col].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)
    return docs.mapInArrow(run, docs.schema)
