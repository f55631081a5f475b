"""Quality counts and verdicts, personal data, toxicity, languages, chunks and
the pipeline, against plain versions and on held-out rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import chunks, langid, pii, quality, toxicity
from tests.conftest import SF_SMALL
from tests.llm.helpers import as_counter, words


# ---- quality ---------------------------------------------------------------

def _counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd):
    docs, rows = odd
    got = quality.quality_verdicts(docs).collect()
    want = Counter((r[0], *_counts(r[1])) for r in rows)
    assert Counter((g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) for g in got) == want
    for g in got:
        assert g["base_failed"] == (g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"])
        assert not (g["base_failed"] and g["kept"])


def test_js_distance(llm):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    rows = [(rng.dirichlet(np.ones(6)).tolist(), rng.dirichlet(np.ones(6)).tolist()) for _ in range(20)] + [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5])]
    got = llm.createDataFrame(rows, "p array<double>, q array<double>").select("p", "q", quality.js_distance(F.col("p"), F.col("q")).alias("d")).collect()
    for r in got:
        p, q = np.array(r["p"]), np.array(r["q"])
        m = (p + q) / 2
        kl = lambda a: float(sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0))
        assert r["d"] == pytest.approx(max(0.0, (kl(p) + kl(q)) / 2) ** 0.5, abs=1e-7)


def test_quality_rejects_what_diverges(llm):
    plain = llm.read.parquet(f"{SF_SMALL}/documents.parquet").filter("length(text) > 600").limit(40).collect()
    junk = [(1000 + i, " ".join(f"{x.upper()}$$$" for x in r["text"].split()), r["lang"]) for i, r in enumerate(plain[:3])]
    docs = llm.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in plain] + junk, "doc_id long, text string, lang string")
    got = {g["doc_id"]: g for g in quality.quality_verdicts(docs).collect()}
    assert not any(got[j[0]]["kept"] for j in junk)
    kept = quality.keep_good_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, g in got.items() if g["kept"]}


def test_quality_rejects_other_languages_and_no_common_words(llm):
    """Clean texts of all languages stay; the same under another language, and
    with every listed word taken out, go."""
    lists = {lang: set(w) for lang, w in quality.COMMON_WORDS.items()}
    rows = llm.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("length(text) BETWEEN 2500 AND 60000").collect()
    clean = [r for r in rows if not re.search(r"[#*$%&|<>]", r["text"]) and _counts(r["text"])[4] * 10 < len(words(r["text"]))
             and sum(w.lower() in lists[r["lang"]] for w in words(r["text"])) * 8 > len(words(r["text"]))]
    some = [r for lang in sorted(lists) for r in [r for r in clean if r["lang"] == lang][:8]]
    other = {"de": "fr", "en": "de", "es": "fr", "fr": "es"}
    wrong = [(100_000 + i, r["text"], other[r["lang"]]) for i, r in enumerate(some[::4])]
    bare = [(200_000 + i, " ".join(w for w in words(r["text"]) if w.lower() not in lists[r["lang"]]), r["lang"]) for i, r in enumerate(some[::4])]
    docs = llm.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in clean] + wrong + bare, "doc_id long, text string, lang string")
    got = {g["doc_id"]: g for g in quality.quality_verdicts(docs).collect()}
    assert len(some) >= 20 and len({r["lang"] for r in some}) == 4
    assert all(got[r["doc_id"]]["kept"] for r in clean)
    assert not any(got[x[0]]["base_failed"] or got[x[0]]["kept"] for x in wrong + bare)


def test_junk_does_not_move_the_references(llm):
    """Good texts are kept alike beside two and beside eighty rows of junk, which go;
    columns stay, whatever their names."""
    rows = [r for r in llm.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' AND length(text) BETWEEN 2500 AND 60000").orderBy("doc_id").collect()
            if not re.search(r"[#*$%&|<>]", r["text"]) and _counts(r["text"])[4] * 10 < len(words(r["text"]))][:20]
    rng = np.random.default_rng(8)
    letters = np.array(list("QXZ0123456789#$%&|"))
    junk = [(1000 + i, " ".join("".join(rng.choice(letters, 6)) for _ in range(400)), "en", "j") for i in range(80)]
    good = [(r["doc_id"], r["text"], "en", "g") for r in rows]
    kept = []
    for n in (2, 80):
        got = quality.quality_verdicts(llm.createDataFrame(good + junk[:n], "doc_id long, text string, lang string, `_words` string"))
        assert got.columns[:2] == ["doc_id", "_words"]
        kept.append({r["doc_id"] for r in got.filter("kept").collect()})
    assert kept[0] == kept[1] == {r["doc_id"] for r in rows}


def test_quality_is_native(llm):
    plan = quality.quality_verdicts(llm.read.parquet(f"{SF_SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---- personal data ---------------------------------------------------------

def _base(text):
    def digits(s):
        return re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]


TRICKY = ["a@b.c@d.e", "a@b@c.d", "@x.y", "..a@b", "a@b.", "1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3.4", "0001.2.3.4", "999999999999999.1.1.1", "+1 (608) 555-2280 37.92.178.161",
          "+1+12 3456789", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111", "+1 . . .", "tél. +33 1 23 45 67 89, x", "é@b.c", "u٠@b.c 1١.2.3.4", "-1@-.-"]


def test_patterns():
    import random
    rnd = random.Random(7)
    for text in TRICKY + ["".join(rnd.choices("a1.@+ -()9", k=rnd.randrange(60))) for _ in range(4000)]:
        assert pii.pattern_spans(text) == _base(text), text


def test_personal_data(odd):
    docs, rows = odd
    got = pii.find_personal_data(docs).collect()
    base = {}
    for r in rows:
        spans = _base(r[1] or "")
        base.setdefault(r[0], []).append((Counter(k for k, _, _ in spans), pii._joined(spans)))
    assert len(got) == len(rows)
    for g in got:
        assert any((c["email"], c["ip"], c["card"], c["phone"], b) == (g["n_email"], g["n_ip"], g["n_card"], g["n_phone"], g["base"]) for c, b in base[g["doc_id"]])
        assert set(filter(None, g["base"].split(","))) <= set(g["spans"].split(","))


@pytest.fixture(scope="module")
def field(llm):
    return pii.fit(llm.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_adds_other_forms(llm, field):
    texts = ["call (608) 555-2280 now", "the end of that. +1 (608) 555-2280 37.92.178.161 is", "a plain line of words without any", "in 1999 and 2024 there were 12 of 4,500", "version 1.2.3 of 300.1.2.3"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, field).collect()}
    assert "phone:17:34" in got[1].split(",") and got[2] == got[3] == got[4] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, field).collect()}
    assert clean[1] == "the end of that. [phone] [ip] is" and clean[3] == texts[3]


def test_viterbi_is_best(field):
    """Decoded paths score as high as any, by enumeration."""
    from itertools import product
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    lengths = np.array([1, 2, 3])
    scores = rng.normal(size=(6, k)) * 3
    labels, sure = field.decode(scores, lengths)
    at = 0
    for n in lengths:
        own = scores[at:at + n]
        value = {p: field.step[0, p[0]] + sum(own[i, p[i]] for i in range(n)) + sum(field.step[p[i], p[i + 1]] for i in range(n - 1)) + field.step[p[-1], 0] for p in product(range(k), repeat=int(n))}
        best = max(value, key=value.get)
        assert tuple(labels[at:at + n]) == best
        total = np.logaddexp.reduce(list(value.values()))
        for i in range(n):
            p = np.exp(np.logaddexp.reduce([v for q, v in value.items() if q[i] == best[i]]) - total)
            assert sure[at + i] == pytest.approx(p, abs=1e-6)
        at += n


def test_redact_keeps_columns(llm, field):
    docs = llm.createDataFrame([(1, "mail ab@cd.example.com please", "x", 29), (2, None, "y", None), (2, "", None, 0)], "doc_id long, text string, extra string, n_chars long")
    got = pii.redact(docs, field)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "mail [email] please", "x", 19), (2, None, "y", None), (2, "", None, 0)], key=str)


# ---- toxicity --------------------------------------------------------------

def _edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton():
    import random
    rnd = random.Random(9)
    terms = ["idiot", "scum", "moron", "worthless", "loser", "losers", "él"]
    auto = toxicity.Automaton(terms)
    forms = {"".join(rnd.choices("idotmrnscu", k=rnd.randrange(1, 8))) for _ in range(500)} | set(terms)
    for t in terms:
        for i in range(len(t) + 1):
            forms |= {t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + "o" + t[i + 1:], t[:i] + "éé" + t[i:], t[:i] + t[i:i + 2][::-1] + t[i + 2:], t[:i] + t[i:i + 3][::-1] + t[i + 3:]}
    forms = sorted(forms - {""})
    points = np.frombuffer("\n".join(forms).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(f) + 1 for f in forms]) - 1
    starts = ends - [len(f) for f in forms]
    which, codes = auto.match(points, starts, ends)
    got = {forms[w]: c % 4 for w, c in zip(which, codes, strict=True)}
    want = {}
    for f in forms:
        near = [e for t in terms if (e := _edits(f, t)) <= (toxicity.MAX_ERRORS if len(t) >= toxicity.MIN_FUZZY else 0)]
        if near:
            want[f] = min(near)
    assert got == want


def test_context():
    lexicon = toxicity.Lexicon(("idiot",), (3.0,))
    found, n = toxicity.hits(["you idiot", 'he said "idiot" twice', "an idoit or idiott", "", "x\nidiot"], lexicon)
    assert list(n) == [2, 4, 4, 0, 2]
    assert found[0] == [(0, 0, "idiot", False, True)] and found[1][0][3] and found[2] == [(0, 1, "idoit", False, False), (0, 1, "idiott", False, False)] and found[3] == [] and len(found[4]) == 1


def test_toxicity_on_held_out_rows(llm):
    from pyspark.sql import functions as F
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    held = docs.join(labels.filter(toxicity.held_out(F.col("doc_id"))), "doc_id")
    got = toxicity.score_toxicity(held, model).join(labels, "doc_id").collect()
    flagged = [r for r in got if r["score"] >= 0.3]
    assert sum(r["toxic"] for r in flagged) >= 0.9 * sum(r["toxic"] for r in got)
    assert sum(r["toxic"] for r in flagged) >= 0.8 * len(flagged)
    for abuse, quotation in (("you are an idiot", 'he said "idiot" to them'), ("what a moron, you moron", "they wrote »moron« and »moron« again"), ("you idoit", 'the word was "idoit"')):
        assert model.scores([abuse])[0] >= 0.3 > model.scores([quotation])[0]
    odd = llm.createDataFrame([(1, None), (None, ""), (1, "plain words only"), (1, "plain words only")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score_toxicity(odd, model).collect()]
    assert len(scores) == 4 and len(set(scores)) == 1 and 0 <= scores[0] < 0.3


def test_lexicon_needs_different_texts(llm):
    """Neither one text that repeats a word nor its copies give a term."""
    filler = [f"w{i}x" for i in range(400)]
    def text(k, word):
        return " ".join(x for i in range(12) for x in (filler[(31 * k + 7 * i) % 400], word if i % 3 == 0 else filler[(17 * k + i) % 400], filler[(13 * k + 5 * i) % 400]))
    alone = text(1, "glorp")
    rows = [(1, alone, 1), (2, alone, 1), (3, alone + " end", 1), (4, " ".join(f"v{i % 7} blorb" for i in range(40)), 1)] + [(10 + k, text(100 + k, "scumbag"), 1) for k in range(4)] + [(50 + k, text(200 + k, "nice"), 0) for k in range(20)]
    got = toxicity.learn_lexicon(llm.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "scumbag" in got.terms and not {"glorp", "blorb", "nice"} & set(got.terms)


def test_toxicity_without_labels(llm, empty):
    labels = llm.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(empty, labels)
    assert toxicity.score_toxicity(empty, model).count() == 0


# ---- chunks ----------------------------------------------------------------

@pytest.mark.parametrize("chunk_bytes", [1 << 30, 50_000])
def test_edit_trial(odd, chunk_bytes):
    docs, rows = odd
    got = chunks.edit_trial(docs, chunk_bytes).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        c = len(t) // 3
        want[i, len(t), hashlib.sha256((t[:len(t) - c] + f[:c]).encode()).hexdigest()] += 1
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == want
    for g in got:
        assert g["near_edited"] == pytest.approx(chunks.likeness(g["fingerprint"], g["edited_fingerprint"]))
        assert 0 <= g["near_next"] <= 1
    long = [g for g in got if 2000 < g["n_chars"] < 20_000]
    assert np.median([g["near_edited"] for g in long]) > 0.5 > np.median([g["near_next"] for g in long])
    prints = chunks.fingerprints(docs).collect()
    assert as_counter((p["doc_id"], p["n_chars"], p["fingerprint"]) for p in prints) == as_counter((g["doc_id"], g["n_chars"], g["fingerprint"]) for g in got)


def test_chunks_resist_shifts():
    import pyarrow as pa
    rng = np.random.default_rng(6)
    text = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(600))
    a, b, c = chunks.Prints(pa.array([text, "xy" + text, text[:1500] + "inserted words here" + text[1500:]])).strings()
    assert chunks.likeness(a, b) > 0.95 and chunks.likeness(a, c) > 0.9 and chunks.containment(a, a) == 1.0
    data = np.frombuffer(text.encode(), np.uint8)
    ends = chunks.boundaries(data, np.array([0, len(data)]))
    sizes = np.diff(ends, prepend=0)
    assert ends[-1] == len(data) and sizes[:-1].min() >= chunks.LEAST and sizes.max() <= chunks.MOST
    assert chunks.likeness("", "") == 1.0 and chunks.likeness(a, "") == 0.0


# ---- languages -------------------------------------------------------------

def test_languages(llm):
    docs, pages = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pages"))
    model = langid.fit(docs)
    got = langid.identify_languages(pages, model).collect()
    truth = {r["page_id"]: re.match(r"https?://[^/]+/([a-z]{2})/", r["url"]).group(1) for r in pages.collect()}
    assert len(got) == len(truth) and sum(g["language"] == truth[g["page_id"]] for g in got) >= 0.97 * len(got)
    odd = llm.createDataFrame([(1, None, None, "x"), (None, "http://[bad", "", "x"), (2, "https://a.example.de/x", '<html lang="de"><script>no end', "x"), (2, "no host", "<p>the of and to in a is that it", "x")],
                              "page_id long, url string, html string, host string")
    found = langid.identify_languages(odd, model).collect()
    assert len(found) == 4 and all(abs(f["probability"]) <= 1 for f in found)
    assert langid.identify_languages(odd.limit(0), model).count() == 0


def test_evidence_parts():
    assert langid.declared_language('<!DOCTYPE html><HTML dir=ltr lang="fr-CA">') == "fr" and langid.declared_language("<html>") is None
    assert langid.address_parts("https://m.blog.example.co:80/en/") == ("m.blog.example.co", "example.co", "co")
    assert langid.visible_text("<p>a &amp; b</p><script>x<y</script><!-- z --> c <style>q").split() == ["a", "&", "b", "c"]


def test_declaration_decides_short_pages(llm):
    """Little text leans on what pages with the same declaration turned out to be."""
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = llm.createDataFrame([(9999, "https://new.example.fr/", '<html lang="de"></html>')], "page_id long, url string, html string")
    got = {g["page_id"]: g for g in langid.identify_languages(pages.unionByName(extra), langid.fit(docs)).collect()}
    assert got[9999]["language"] == "de" and got[9999]["text_language"] is None
