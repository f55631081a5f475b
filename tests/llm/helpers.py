"""Rows for the tests, and plain versions of what the operators compute."""

import re
from collections import Counter

import pyarrow.dataset as ds

from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table_rows():
    t = ds.dataset(f"{SF_SMALL}/documents.parquet").to_table(columns=["doc_id", "text", "lang", "source", "n_chars"])
    return [tuple(r.values()) for r in t.to_pylist()]


def odd_rows():
    """NULLs, empty and very long texts, ties, repeated rows, white space of all
    kinds, characters of one to four bytes."""
    long = " ".join(f"w{i * i % 977}" for i in range(60_000))
    some = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion in the old tower " * 3
    texts = [None, "", " \t\n\x0b\f\r", "one", "two words", "a b c", "A B c", long, long[:200_000] + " end", some, some, some.upper(),
             "ha " * 4000, "a" * 30_000, "café 你好 \U0001f600 naïve  x y <|endoftext|> it's  we'll\n\n  x " * 8, "\x00\x01 nul " * 60]
    rows = [(10_000 + i, t, "en", "odd", 0) for i, t in enumerate(texts)]
    rows += [(10_003, "one", "en", "odd", 3), (10_009, some, None, None, None), (None, some, "de", None, 1), (None, None, None, None, None), (-5, some, "xx", "", 1)]
    return rows


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def as_counter(rows):
    return Counter(tuple(r) for r in rows)
