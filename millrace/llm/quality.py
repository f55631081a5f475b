"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's histograms of character classes and of its language's common
words are compared with the language's own by the Jensen-Shannon distance. A
language's histograms are the mean over the documents that speak it: those that pass
the base rules and hold enough of its listed words, each with the same weight, so
neither junk, however much, nor one long text moves them. Guards on length keep short
texts, whose histograms say little, out of the comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die das und in zu den von mit für auf ist im nicht ein eine als auch es an werden aus er hat dass sie".split(),
    "en": "the of and to in a is that it was for on are as with his they at be this from have or by one had not but".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont".split(),
}
WHITE = " \t\n\x0b\f\r"
#: Character classes counted by pattern; white space and all other characters
#: (lower-case and uncased letters) make two more.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{N}", "symbol": r"[#*$%&|<>]", "mark": r"[\p{P}\p{S}&&[^#*$%&|<>]]"}

#: Distance of classes above which a document is rejected; for words, the share
#: of the distance that a text without any listed word has; and the words a
#: document must have for either comparison.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_SHARE = 0.5
MIN_CLASS_WORDS = 50
MIN_WORD_WORDS = 200
#: Share of listed words with which a document speaks for its language; all
#: documents of a language without a list, and of one for which none speaks, do.
SPEAKER_SHARE = 0.1


def _covered_by_repeats(grams: Column) -> Column:
    """Words in 3-word windows that stand twice or more in ``grams`` (sorted
    pairs of window hash and place): equal windows are neighbours."""
    def place(x, j):
        same = (F.coalesce(F.get(grams, j - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(grams, j + 1)["h"] == x["h"], F.lit(False)))
        return F.when(same, F.array(x["i"], x["i"] + 1, x["i"] + 2)).otherwise(F.array().cast("array<int>"))
    return F.size(F.array_distinct(F.flatten(F.transform(grams, place)))).cast("long")


def document_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                    common: dict[str, list[str]] | None = None) -> DataFrame:
    """Add ``q_lang`` and the counts of every text: ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``classes`` and
    ``commons`` (arrays of counts). All in one pass over each text, with no
    shuffle; repeated windows are found by sorting a text's window hashes."""
    common = common or COMMON_WORDS
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.columns
    wanted = sorted({w for words in common.values() for w in words})
    lists = F.create_map(*[x for lang, words in sorted(common.items()) for x in (F.lit(lang), F.lit(words))])
    split = docs.select(*kept, text.alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("q_lang"),
                        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
                        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "").alias("_lines"))
    n = F.size("_words")
    hashed = split.select(
        *kept, "q_lang", "_text", n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                                   lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("_grams"),
        F.transform(F.filter("_words", lambda w: w.isin(wanted + [w.capitalize() for w in wanted])), lambda w: F.lower(w)).alias("_commons"),
        *[F.regexp_count("_text", F.lit(p)).cast("long").alias(f"_{c}") for c, p in CLASSES.items()])
    grams = F.when(F.size("_grams") == F.size(F.array_distinct("_grams")), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_grams = hashed.select("*", grams.alias("_sorted"), F.length("_text").cast("long").alias("_chars"),
                                 F.coalesce(F.element_at(lists, F.col("q_lang")), F.array().cast("array<string>")).alias("_list")).drop("_text", "_grams")
    counted = F.transform("_list", lambda c: (F.size("_commons") - F.size(F.array_remove("_commons", c))).cast("long"))
    filled = sorted_grams.select("*", F.when(F.size("_sorted") == 0, F.lit(0)).otherwise(_covered_by_repeats(F.col("_sorted"))).cast("long").alias("n_repeat_words"),
                                 counted.alias("_counted"))
    white = F.col("_chars") - F.col("word_chars")
    other = F.col("word_chars") - sum((F.col(f"_{c}") for c in CLASSES), F.lit(0))
    rest = F.col("n_words") - F.aggregate("_counted", F.lit(0).cast("long"), lambda a, x: a + x)
    return filled.select(*kept, "q_lang", "n_words", "word_chars", F.col("_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                         F.array(*[F.col(f"_{c}") for c in CLASSES], white, other).alias("classes"),
                         F.when(F.size("_list") > 0, F.concat("_counted", F.array(rest))).otherwise(F.array().cast("array<bigint>")).alias("commons"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language_references(counts: DataFrame) -> DataFrame:
    """Per ``q_lang`` the mean shares of character classes and common words over
    the documents that speak it (see the module; partial sums before the shuffle)."""
    listed = 1 - F.element_at("commons", -1) / F.col("n_words")
    rank = F.when(base_failed(), 0).when((F.size("commons") > 0) & (listed < SPEAKER_SHARE), 1).otherwise(2)
    ranked = counts.select("q_lang", "classes", "commons", rank.alias("_rank"))
    best = ranked.groupBy("q_lang").agg(F.max("_rank").alias("_best"))  # one row a language
    speakers = ranked.join(best, "q_lang").filter(F.col("_rank") == F.col("_best"))

    def mean(column: str) -> DataFrame:
        return (speakers.select("q_lang", F.posexplode(_shares(F.col(column))).alias("k", "x")).groupBy("q_lang", "k").agg(F.sum("x").alias("x"))
                .groupBy("q_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias(column)))
    return mean("classes").join(mean("commons"), "q_lang", "left").select(
        "q_lang", _shares(F.col("classes")).alias("_class_ref"), _shares(F.col("commons")).alias("_word_ref")) \
        .withColumn("_bare", F.when(F.size("_word_ref") > 0, js_distance(F.transform("_word_ref", lambda x, i: F.when(i == F.size("_word_ref") - 1, 1.0).otherwise(0.0)), F.col("_word_ref")))) \
        .withColumn("_cells", F.size(F.filter("_word_ref", lambda x: x > 0)))


def word_limit(share: float) -> Column:
    """Word distance above which a document is rejected: ``share`` of the
    distance ``_bare`` of a text without any listed word, and what drawing
    ``n_words`` words from the reference itself is expected to add (squares add
    up; the divergence of a draw is about (cells - 1) / (8 n ln 2))."""
    return F.sqrt(F.pow(share * F.col("_bare"), F.lit(2.0)) + (F.col("_cells") - 1) / (8 * math.log(2) * F.col("n_words")))


def _verdict(counts: DataFrame, references: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Add the distances, ``base_failed`` and ``kept`` to counted documents.
    ``references`` is read from a small written table, whose size the planner
    knows: it is broadcast only where it is under Spark's limit."""
    joined = counts.join(references, "q_lang", "left")
    compared = F.col("n_words") > 0
    distances = joined.withColumn("class_distance", F.when(compared, js_distance(_shares(F.col("classes")), F.col("_class_ref")))) \
        .withColumn("word_distance", F.when(compared & (F.size("commons") > 0), js_distance(_shares(F.col("commons")), F.col("_word_ref"))))
    far = (((F.col("n_words") >= limits["min_class_words"]) & F.coalesce(F.col("class_distance") > limits["max_class_distance"], F.lit(False)))
           | ((F.col("n_words") >= limits["min_word_words"]) & F.coalesce(F.col("word_distance") > word_limit(limits["max_word_share"]), F.lit(False))))
    return (distances.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~far))


LIMITS = {"max_class_distance": MAX_CLASS_DISTANCE, "max_word_share": MAX_WORD_SHARE, "min_class_words": MIN_CLASS_WORDS, "min_word_words": MIN_WORD_WORDS}


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: dict[str, list[str]] | None = None, **limits) -> DataFrame:
    """Every input row without its text, with its counts, ``class_distance``,
    ``word_distance``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated 3-word windows. ``kept`` is false if ``base_failed``, or if a
    distance to the language's reference exceeds its limit (``LIMITS``, or
    keyword arguments of the same names; ``word_limit`` for words) in a document
    long enough for that comparison. A distance is NULL where there is nothing to compare: no words,
    or for words a language without a list. NULL texts are empty (and fail); a
    NULL language counts as one of its own; ties and repeated rows are judged
    each; an empty table gives an empty result. Columns of the input named like
    a result are replaced; all others, whatever their names, stay.
    """
    names = ("q_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons",
             "class_distance", "word_distance", "base_failed", "kept")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in names and c not in (text_col, lang_col)]
    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("none"))  # in one column, so that no name clashes
    narrowed = docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_t"), F.col(f"`{lang_col}`").alias("_l"))
    counts = materialize(document_counts(narrowed, "_t", "_l", common).drop("_t", "_l"), "quality")
    references = materialize(language_references(counts), "references")
    judged = _verdict(counts, references, LIMITS | limits)
    return judged.select(*(["_row.*"] if keep else []), *names[1:6], "class_distance", "word_distance", "base_failed", "kept")


def keep_good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                        common: dict[str, list[str]] | None = None, **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_verdicts`` keeps. Rows
    are found again by id, hash of the text and language; the verdicts are
    written first, so that texts are counted once."""
    ids, key, lang = F.col(id_col), F.xxhash64(text_col), F.col(lang_col)
    judged = quality_verdicts(docs.select(ids.alias("id"), key.alias("key"), lang.alias("of"), F.col(text_col).alias("text"), lang.alias("lang")), common=common, **limits)
    kept = materialize(judged.filter("kept").select("id", "key", "of").distinct(), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), ids.alias("_id"), key.alias("_key"), lang.alias("_of"))
    same = (rows["_key"] == kept["key"]) & rows["_id"].eqNullSafe(kept["id"]) & rows["_of"].eqNullSafe(kept["of"])
    return rows.join(kept, same, "left_semi").select("row.*")
