"""Toxicity by a lexicon matched with spelling errors, in context.

The lexicon is learned: terms that stand in many different contexts of documents
labelled toxic and hardly in others. A Levenshtein automaton is intersected with
the lexicon's trie; its deterministic states are made as texts need them, and
all words of a batch step through it together. The words around a match tell
abuse from quotation; counts of both are weighed by a logistic regression.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import doc_rows

#: Labelled rows, at most, that lexicon and weights are learned from.
MAX_FIT_ROWS = 20_000
#: Different (word before, word after) pairs a term needs in toxic texts, the share
#: of its texts that may be clean, and the different toxic texts it must stand in.
MIN_CONTEXTS = 6
MAX_CLEAN_SHARE = 0.1
MIN_TEXTS = 3
#: Spelling errors allowed in a term of at least ``MIN_FUZZY`` characters.
MAX_ERRORS = 1
MIN_FUZZY = 5
WINDOW = 6

#: Words of reported speech, and of address, around a term.
REPORTING = frozenset("said says say wrote writes called calls quoted quote word term sagte schrieb nannte zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra".split())
ADDRESS = frozenset("you your yours youre u du dich dir ihr dein tu te toi vous ton tú ti usted vosotros".split())
_QUOTES = frozenset("\"'`“”„«»‘’‹›")


def _alnum() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalnum()]] = True
    return table


_is_word = functools.lru_cache(maxsize=1)(_alnum)


class Automaton:
    """Words within ``MAX_ERRORS`` edits of a term, two neighbours swapped being
    one, as a lazily determinised product of the lexicon's trie and the
    Levenshtein automaton: a state maps trie nodes to the fewest errors that lead
    there. A node below the trie's stands for a swap of which one character is read."""

    def __init__(self, terms: list[str], max_errors: int = MAX_ERRORS, min_fuzzy: int = MIN_FUZZY):
        self.terms, self.max_errors, self.min_fuzzy = terms, max_errors, min_fuzzy
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = i
        self.swaps: list[dict[str, list[int]]] = [{} for _ in self.children]
        self.half = len(self.children)  # nodes from here on are half-read swaps
        for node in range(self.half):
            for first, child in list(self.children[node].items()):
                for second, end in self.children[child].items():
                    if first != second:
                        self.swaps[node].setdefault(second, []).append(len(self.children))
                        self.children.append({first: end})
                        self.ends.append(-1)
        self.letters = sorted({c for t in terms for c in t})
        self.classes = np.zeros(0x110000, np.int16)
        for k, c in enumerate(self.letters):
            self.classes[ord(c)] = k + 1
        self.sets: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.empty((0, len(self.letters) + 1), np.int32)
        self.best = np.empty(0, np.int32)  # term * 4 + errors, or -1
        self.dead = self._number({})
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving out characters of a term."""
        todo = list(state.items())
        while todo:
            node, errors = todo.pop()
            if errors < self.max_errors and node < self.half:
                for child in self.children[node].values():
                    if state.get(child, 99) > errors + 1:
                        state[child] = errors + 1
                        todo.append((child, errors + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(state)
            ends = [(e, self.ends[n]) for n, e in state.items() if self.ends[n] >= 0 and (e == 0 or len(self.terms[self.ends[n]]) >= self.min_fuzzy)]
            if len(self.sets) > len(self.table):
                grown = max(1024, 2 * len(self.sets))
                table, best = np.full((grown, len(self.letters) + 1), -1, np.int32), np.full(grown, -1, np.int32)
                table[:len(self.table)], best[:len(self.best)] = self.table, self.best
                self.table, self.best = table, best
            number = len(self.sets) - 1
            if ends:
                errors, term = min(ends)
                self.best[number] = term * 4 + errors
            if not state:
                self.table[number] = number
        return self.numbers[key]

    def _next(self, state: int, letter: int) -> int:
        c = self.letters[letter - 1] if letter else None
        out: dict[int, int] = {}
        for node, errors in self.sets[state].items():
            if node >= self.half:
                moves = [(end, errors) for x, end in self.children[node].items() if x == c]
            else:
                moves = [(node, errors + 1)] + [(child, errors + (x != c)) for x, child in self.children[node].items()]
                moves += [(swap, errors + 1) for swap in self.swaps[node].get(c, ())]
            for n, e in moves:
                if e <= self.max_errors and out.get(n, 99) > e:
                    out[n] = e
        return self._number(self._closed(out))

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that match, and term * 4 + errors of each."""
        if not self.terms:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        lengths = ends - starts
        sizes = [len(t) for t in self.terms]
        live = np.flatnonzero((lengths >= min(sizes) - self.max_errors) & (lengths <= max(sizes) + self.max_errors))
        state = np.full(len(live), self.start, np.int32)
        done, found = [], []
        step = 0
        while len(live):
            over = lengths[live] == step
            if over.any():
                best = self.best[state[over]]
                done.append(live[over][best >= 0])
                found.append(best[best >= 0])
                live, state = live[~over], state[~over]
            letter = self.classes[points[starts[live] + step]]
            to = self.table[state, letter]
            missing = np.flatnonzero(to < 0)
            if len(missing):
                for pair in np.unique(state[missing].astype(np.int64) * 65536 + letter[missing]).tolist():
                    number = self._next(pair >> 16, pair & 65535)
                    self.table[pair >> 16, pair & 65535] = number
                to = self.table[state, letter]
            alive = to != self.dead
            live, state, step = live[alive], to[alive], step + 1
        if not done:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        words, found = np.concatenate(done), np.concatenate(found)
        order = np.argsort(words, kind="stable")
        return words[order], found[order]


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    harmless: frozenset = field(default_factory=frozenset)  # misspellings that are clean words


@functools.lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]) -> Automaton:
    return Automaton(list(terms))


FEATURES = ("exact", "fuzzy", "quoted", "addressed", "share", "strongest", "kinds")


def hits(texts: list[str], lexicon: Lexicon) -> tuple[list[list[tuple[int, int, str, bool, bool]]], np.ndarray]:
    """Per text its matches (term, errors, word, quoted, addressed), and the
    number of its words."""
    joined = "\n".join(texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower() may lengthen a text: borders are counted after it
    sizes = np.array([len(t.lower()) for t in texts], np.int64) if texts else np.empty(0, np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    word = _is_word()[points]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, np.append(begins, len(points) + 1))
    which, codes = _automaton(lexicon.terms).match(points, starts, ends)
    out: list[list[tuple[int, int, str, bool, bool]]] = [[] for _ in texts]
    text_of = np.searchsorted(first, which, "right") - 1
    for w, code, t in zip(which.tolist(), codes.tolist(), text_of.tolist(), strict=True):
        form = joined[starts[w]:ends[w]]
        if code % 4 and form in lexicon.harmless:
            continue
        lo, hi = max(int(first[t]), w - WINDOW), min(int(first[t + 1]), w + WINDOW + 1)
        around = {joined[starts[i]:ends[i]] for i in range(lo, hi) if i != w}
        before = joined[starts[w] - 1] if starts[w] else " "
        after = joined[ends[w]] if ends[w] < len(joined) else " "
        quoted = before in _QUOTES or after in _QUOTES or bool(around & REPORTING)
        out[t].append((code // 4, code % 4, form, quoted, bool(around & ADDRESS)))
    return out, np.diff(first)


def features(found: list[tuple[int, int, str, bool, bool]], n_words: int, lexicon: Lexicon) -> list[float]:
    """All but ``quoted`` are of the hits that are not quoted."""
    abuse = [h for h in found if not h[3]]
    exact = sum(e == 0 for _, e, *_ in abuse)
    return [math.log1p(exact), math.log1p(len(abuse) - exact), math.log1p(len(found) - len(abuse)), math.log1p(sum(a for *_, a in abuse)),
            min(1.0, 20 * len(abuse) / max(n_words, 1)), max((lexicon.weights[t] / (1 + e) for t, e, *_ in abuse), default=0.0),
            math.log1p(len({t for t, *_ in abuse}))]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]  # the last is the constant

    def scores(self, texts: list[str]) -> np.ndarray:
        found, n_words = hits(texts, self.lexicon)
        x = np.array([features(f, int(n), self.lexicon) for f, n in zip(found, n_words, strict=True)]).reshape(len(texts), len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge on all but the constant."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(rows: DataFrame, min_contexts: int = MIN_CONTEXTS, max_clean_share: float = MAX_CLEAN_SHARE, min_texts: int = MIN_TEXTS) -> Lexicon:
    """Terms from ``rows`` (``doc_id, text, toxic``): words that stand in several
    contexts and several different texts that are toxic, and in few that are not.
    Texts whose smallest hash of five words is the same, as exact copies have and
    near ones mostly, count once, and so does a text that repeats a word."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " ")))
    texts = rows.select("toxic", words.alias("w")).withColumn("text_id", F.array_min(runs)).groupBy("text_id").agg(F.max_by("w", F.size("w")).alias("w"), F.max("toxic").alias("toxic"))
    tokens = texts.select("text_id", "toxic", "w", F.posexplode("w").alias("i", "word"))
    around = F.xxhash64(F.coalesce(F.get("w", F.col("i") - 1), F.lit("")), F.lit(0), F.coalesce(F.get("w", F.col("i") + 1), F.lit("")))
    bad = F.col("toxic") == 1
    each = tokens.select("word", "text_id", "toxic", F.when(bad, around).alias("context")).groupBy("word").agg(
        F.count_distinct("context").alias("contexts"), F.count_distinct(F.when(bad, F.col("text_id"))).alias("bad"), F.count_distinct(F.when(~bad, F.col("text_id"))).alias("good"))
    few_clean = F.col("good") <= max_clean_share * (F.col("bad") + F.col("good"))
    got = each.filter((F.col("contexts") >= min_contexts) & (F.col("bad") >= min_texts) & few_clean & (F.length("word") >= 3)).orderBy("word").collect()
    return Lexicon(tuple(r["word"] for r in got), tuple(math.log((r["bad"] + 0.5) / (r["good"] + 0.5)) for r in got))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn lexicon and weights from at most ``max_rows`` labelled rows, those
    whose ids' hashes are smallest. Labels of one id that disagree count as toxic."""
    drawn = F.xxhash64("doc_id", F.lit(11))
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(drawn, "doc_id").limit(max_rows))
    rows = doc_rows(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
    lexicon = learn_lexicon(rows)

    def run(batches):
        for batch in batches:
            found, n_words = hits(batch["text"].to_pylist(), lexicon)
            flat = [[f"{t}\t{e}\t{w}\t{int(q)}\t{int(a)}" for t, e, w, q, a in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(n_words, pa.int64()), pa.array(flat, pa.list_(pa.string()))], names=["toxic", "n", "hits"])
    got = rows.select("toxic", "text").mapInArrow(run, "toxic int, n long, hits array<string>").collect()
    if not got:
        return Model(lexicon, (0.0,) * len(FEATURES) + (-2.0,))
    parsed = [[(int(t), int(e), w, q == "1", a == "1") for t, e, w, q, a in (h.split("\t") for h in r["hits"])] for r in got]
    variants: dict[str, Counter] = {}
    for r, found in zip(got, parsed, strict=True):
        for w in {w for _, e, w, _, _ in found if e}:
            variants.setdefault(w, Counter())[r["toxic"]] += 1
    harmless = frozenset(w for w, c in variants.items() if c[0] > MAX_CLEAN_SHARE * (c[0] + c[1]))
    lexicon = Lexicon(lexicon.terms, lexicon.weights, harmless)
    x, y = [], []
    for r, found in zip(got, parsed, strict=True):
        kept = [h for h in found if not (h[1] and h[2] in harmless)]
        x.append(features(kept, r["n"], lexicon))
        y.append(float(r["toxic"]))
        if r["toxic"] and kept:  # the same text with its terms quoted, and with them addressed to the reader
            for quoted, addressed in ((True, False), (False, True)):
                x.append(features([(*h[:3], quoted, addressed) for h in kept], r["n"], lexicon))
                y.append(float(not quoted))
    return Model(lexicon, tuple(_regression(np.array(x), np.array(y))))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: likelier toxic) of every row. NULL and
    empty texts get the score of a text without any match; NULL ids, ties and
    repeated rows are scored each; an empty table gives an empty result; other
    columns are ignored."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.scores(batch["text"].to_pylist()), pa.float64())], names=["doc_id", "score"])
    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2
