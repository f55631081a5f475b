"""Language of web pages by Bayesian fusion of evidence.

The likelihood of a page's text (byte trigrams, learned from documents of known
language) is combined with that of the language its markup declares and of its
address's suffix, and with a prior for its host. All three are learned from the
pages' own text likelihoods by grouped sums; a host with few pages leans on its
registered domain, that on the suffix and that on all pages.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import materialize

#: Documents, at most, that trigrams are learned from.
MAX_FIT_ROWS = 4_000
_SLOTS = 1 << 16
#: Trigrams of one page count as no more than this many independent ones.
EFFECTIVE_TRIGRAMS = 60.0
#: Pages by which each level of the hierarchy is drawn to the one above, and
#: pages added to every cell of the tables of declarations and suffixes.
PULL = 8.0
SMOOTH = 1.0

# each opening is closed at the latest by the end of the page, so that markup
# without an end is passed once
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")
_DECLARED = re.compile(r"(?is)<html\b[^>]{0,2000}?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def visible_text(page: str) -> str:
    return markup.unescape(_HIDDEN.sub(" ", page))


def declared_language(page: str) -> str | None:
    found = _DECLARED.search(page)
    return found.group(1).lower() if found else None


def address_parts(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain (its last two labels) and suffix; empty strings
    where the address has no host."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


@dataclass(frozen=True)
class Trigrams:
    languages: tuple[str, ...]
    weights: np.ndarray  # slot, language: log probability

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability of every text's trigrams by language, and their number."""
        out, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        data, offsets = tk.column_bytes(pa.array([" ".join(t.lower().split()) for t in texts], pa.large_string()))
        for i, j in tk.slices(offsets):
            slots, text = _trigrams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            n = np.bincount(text, minlength=j - i)
            counts[i:j] = n
            for k in range(len(self.languages)):
                out[i:j, k] = np.bincount(text, weights=self.weights[slots, k], minlength=j - i) / np.maximum(n, 1)
        return out, counts


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    d = data.astype(np.uint32)
    h = (d[:-2] * np.uint32(0x01000193) ^ d[1:-1] * np.uint32(0x85EBCA6B) ^ d[2:] * np.uint32(0xC2B2AE35))
    slots = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    inside = text[2:] == text[:-2]
    return slots[inside], text[:-2][inside]


def train(rows: list[tuple[str, str]], smooth: float = 0.5) -> Trigrams:
    """From (text, language) rows."""
    languages = tuple(sorted({lang for _, lang in rows}))
    counts = np.full((_SLOTS, len(languages)), smooth)
    for k, lang in enumerate(languages):
        data, offsets = tk.column_bytes(pa.array([" ".join(t.lower().split()) for t, x in rows if x == lang], pa.large_string()))
        for i, j in tk.slices(offsets):
            slots, _ = _trigrams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            counts[:, k] += np.bincount(slots, minlength=_SLOTS)
    return Trigrams(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, max_rows: int = MAX_FIT_ROWS, lang_col: str = "lang") -> Trigrams:
    """Learn from the at most ``max_rows`` documents of known language whose ids'
    hashes are smallest in a thinned-out set."""
    known = docs.select("doc_id", "text", F.col(lang_col).alias("lang")).dropna()
    every = max(1, known.count() // (2 * max_rows))
    drawn = F.xxhash64("doc_id", F.lit(29))
    got = known.filter(F.pmod(drawn, F.lit(every)) == 0).orderBy(drawn, "text").limit(max_rows).collect()
    return train([(r["text"], r["lang"]) for r in got])


def page_evidence(pages: DataFrame, model: Trigrams, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its address parts, declaration and tempered log likelihoods."""
    def run(batches):
        for batch in batches:
            htmls = [h or "" for h in batch["text"].to_pylist()]
            mean, counts = model.log_likelihoods([visible_text(h) for h in htmls])
            tempered = mean * np.minimum(counts, EFFECTIVE_TRIGRAMS)[:, None]
            parts = [address_parts(u) for u in batch["url"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array([p[k] for p in parts], pa.string()) for k in range(3)], pa.array([declared_language(h) for h in htmls], pa.string()),
                 pa.array(counts, pa.int64()), pa.array(list(tempered), pa.list_(pa.float64()))], names=["page_id", "host", "domain", "suffix", "declared", "n_trigrams", "text_ll"])
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, n_trigrams long, text_ll array<double>")


def _softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, key: str, k: int, out: str) -> DataFrame:
    """Sum of the text posteriors by language, per key (summed before the shuffle)."""
    return rows.groupBy(key).agg(*[F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(k)]).select(key, F.array(*[F.col(f"_{i}") for i in range(k)]).alias(out))


def _drawn(own: Column, above: Column) -> Column:
    """Shares of ``own`` sums drawn to the shares ``above``."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, above, lambda x, y: (x + PULL * y) / (total + PULL))


def identify_languages(pages: DataFrame, model: Trigrams, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, declared, n_trigrams, text_language, language,
    probability`` of every page.

    A page's own text is left out of its host's, domain's and suffix's sums, so
    it isn't counted twice. NULL or empty pages have no text evidence, pages
    without a declaration or an address none of these; without any, the shares
    of all pages decide, and ties go to the first language. NULL ids and repeated
    rows are pages each; an empty table gives an empty result; other columns are
    ignored. Languages are those of the model.
    """
    names, k = list(model.languages), len(model.languages)
    if not k:
        raise ValueError("the model knows no language")
    label = F.array(*[F.lit(x) for x in names])
    best = lambda logs: F.element_at(label, F.array_position(logs, F.array_max(logs)).cast("int"))
    seen = page_evidence(pages, model, id_col, url_col, html_col).withColumn("declared", F.coalesce("declared", F.lit("")))
    rows = materialize(seen.withColumn("p", _softmax(F.col("text_ll"))), "pages")
    told = rows.filter("n_trigrams > 0")  # others would say nothing about their host
    everything = told.agg(*[F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(k)]).first()
    overall = [float(everything[f"_{i}"] or 0.0) for i in range(k)]
    total = sum(overall)
    base = F.array(*[F.lit((x + 1.0) / (total + k)) for x in overall])
    joined = rows
    for key in ("host", "domain", "suffix", "declared"):
        joined = joined.join(_sums(told, key, k, f"{key}_sums"), key, "left")
    own = F.when(F.col("n_trigrams") > 0, F.col("p")).otherwise(F.array(*[F.lit(0.0)] * k))
    nothing = F.array(*[F.lit(0.0)] * k)

    def others(key: str) -> Column:
        return F.zip_with(F.coalesce(f"{key}_sums", nothing), own, lambda s, x: F.greatest(s - x, F.lit(0.0)))

    # levels of the prior; an empty name is no group
    level = lambda key, above: F.when(F.col(key) != "", _drawn(others(key), above)).otherwise(above)
    staged = joined.withColumn("prior", base)
    for key in ("suffix", "domain", "host"):
        staged = staged.withColumn("prior", level(key, F.col("prior")))
    said = F.when(F.col("declared") != "", F.zip_with(others("declared"), F.array(*[F.lit(x) for x in overall]), lambda s, t: F.log((s + SMOOTH * F.lit(1.0 / k)) / (t + SMOOTH)))).otherwise(nothing)
    fused = staged.withColumn("logs", F.zip_with(F.zip_with(F.col("text_ll"), said, lambda a, b: a + b), F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b))
    done = fused.withColumn("post", _softmax(F.col("logs")))
    return done.select("page_id", "host", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), "n_trigrams",
                       F.when(F.col("n_trigrams") > 0, best(F.col("text_ll"))).alias("text_language"), best(F.col("logs")).alias("language"), F.array_max("post").alias("probability"))
