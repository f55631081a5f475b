"""The registered queries of this subpackage: one per operator, and the
pipeline. Each applies its operator, with production parameters, to a whole
table and derives the asked columns from its results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import prepare
from millrace.llm.oracles import SQL
from millrace.session import table

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@_query
def op1_pack(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    from millrace.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), added_tokens=True).drop("filled")


@_query
def op10_windows(spark, sf_dir):
    """Documents without windows of 13 words that a smaller id has too."""
    from millrace.llm.windows import cut_repeated_windows, digests
    return digests(cut_repeated_windows(table(spark, sf_dir, "documents")))


@_query
def op4_quality(spark, sf_dir):
    """Counts and verdict of every document."""
    from millrace.llm.quality import quality_verdicts
    out = quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


@_query
def op3_mix(spark, sf_dir):
    """Words of every document that a mix of the sources takes."""
    from millrace.llm.mixing import mix_counts
    return mix_counts(table(spark, sf_dir, "documents"))


@_query
def op8_jaccard(spark, sf_dir):
    """Components of documents linked by 3-word shingles at 0.9."""
    from millrace.llm.partenum import near_duplicate_components
    return near_duplicate_components(table(spark, sf_dir, "documents"), shingle=3, similarity=0.9)


@_query
def op6_suffixes(spark, sf_dir):
    """Documents without 200-byte strings that start more than once."""
    from millrace.llm.suffixes import cut_repeated_bytes, digests
    return digests(cut_repeated_bytes(table(spark, sf_dir, "documents")))


@_query
def op7_personal(spark, sf_dir):
    """Personal data in every document."""
    from pyspark.sql import functions as F

    from millrace.llm.pii import find_personal_data
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@_query
def op2_chunks(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    from millrace.llm.chunks import edit_trial
    return edit_trial(table(spark, sf_dir, "documents"))


@_query
def op9_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labels not held out."""
    from pyspark.sql import functions as F

    from millrace.llm.toxicity import fit, held_out, score_toxicity
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op5_language(spark, sf_dir):
    """Language of every page, from its text, markup and address."""
    from millrace.llm.langid import fit, identify_languages
    return identify_languages(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))


@_query
def op11_divergence(spark, sf_dir):
    """Distances between the sources of each language, and their own terms."""
    from millrace.llm.divergence import source_divergence
    return source_divergence(table(spark, sf_dir, "documents"))


@_query
def op12_codes(spark, sf_dir):
    """Codes of all vectors, and a digest of the codebooks."""
    from pyspark.sql import functions as F

    from millrace.llm.veccodes import encode_vectors
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@_query
def op13_decontaminate(spark, sf_dir):
    """What every document shares with the benchmark."""
    from millrace.llm.decontaminate import digests, find_contamination
    return digests(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
