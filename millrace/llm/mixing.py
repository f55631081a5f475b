"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points fall into the sources' shares of the mix; the slots of each
source are ranked and joined, in that order, to equal-token blocks of its
shuffled documents. A source that runs out starts again with its first block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words of a block: so many that the schedule has ``SLOTS_A_SOURCE`` slots for
#: an average source, between 1 and ``MAX_BLOCK``.
SLOTS_A_SOURCE = 4096
MAX_BLOCK = 4096
#: Rows whose running sums one task orders at a time.
BUCKET_ROWS = 100_000
_GOLDEN = 0.6180339887498949
_STEP = 1 << 20


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six white space ones."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def golden_point(slot: Column) -> Column:
    """Fraction of slot * golden ratio, in two parts that keep its precision."""
    high, low = F.floor(slot / _STEP), slot % _STEP
    x = high * ((_STEP * _GOLDEN) % 1.0) + low * _GOLDEN
    return x - F.floor(x)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target``: the sources in code-point order (NULL
    last) weigh ``weights``, repeating, and share all words; no target exceeds
    ``max_repeats`` times its source's size, and what is cut off is shared out
    again by weight until none does.

    That is target = min(limit, level * weight) with one level for all; it is
    raised until the targets sum up. Each step is one aggregate over the table
    of sources, which has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    table = materialize(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)), "sources")
    limit = F.col("source_size") * float(max_repeats)
    level, total = 0.0, float(table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        got = table.agg(F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        risen = (total - (got["held"] or 0.0)) / got["open"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return table.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def _running(rows: DataFrame, key: str, value: str, order: list[str], bucket: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same ``key`` before each
    row in (bucket, order): within buckets by a window, plus the buckets' sums
    before. A key of any size spreads over its buckets. Needs a non-NULL key."""
    dealt = rows.withColumn("_bucket", bucket)
    inner = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return (dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(starts, [key, "_bucket"]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before"))


def schedule(sources: DataFrame, slots: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sid, slot, rank``: the source of every slot and the slot's rank among
    its source's. ``sources``: ``sid, low, high`` (shares of [0, 1))."""
    spark = sources.sparkSession
    cells = max(1, 4 * sources.count())
    spread = sources.filter("high > low").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * cells).cast("long"), F.least(F.floor(F.col("high") * cells).cast("long"), F.lit(cells - 1)))))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", golden_point(F.col("slot")))
    dealt = (points.withColumn("cell", F.floor(F.col("point") * cells).cast("long")).join(spread, "cell")
             .filter("point >= low AND point < high").select("sid", "slot", F.lit(1).alias("one")))
    return _running(dealt, "sid", "one", ["slot"], F.floor(F.col("slot") / bucket_rows), "rank").select("sid", "slot", F.col("rank").cast("long"))


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, slots_a_source: int = SLOTS_A_SOURCE,
               max_block: int = MAX_BLOCK, seed: int = 17, bucket_rows: int = BUCKET_ROWS,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: bool = False) -> DataFrame:
    """How much of each document the mix takes.

    Returns one row per input row: ``doc_id, size`` (words), ``source_size,
    target`` (its source's) and ``taken`` (words, repeats counted; at most
    ``max_repeats`` times ``size``). A source's taken words are its target,
    rounded down. The order of documents in a source is that of a seeded hash,
    so reruns agree; rows that are repeated are taken each. NULL texts have no
    words; NULL sources are one source, the last; sources without words have
    target 0; an empty table gives an empty result; other columns are ignored.
    With ``key`` the result has ``text_key``, a hash of the text, too.
    """
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
                    *([F.xxhash64(text_col).alias("text_key")] if key else []))
        .withColumn("nth", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(sized, weights, max_repeats)
    spark = docs.sparkSession
    totals = targets.agg(F.sum("source_size").alias("t"), F.sum("target").alias("g"), F.count(F.lit(1)).alias("n")).first()
    total, n_sources = int(totals["t"] or 0), int(totals["n"])
    block = min(max_block, max(1, -(-total // max(1, slots_a_source * n_sources))))
    slots = total // block
    # numbered sources with their share of the slots, blocks and words to take
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.col("target") / F.lit(max(float(totals["g"] or 0.0), 1.0))
    numbered = materialize(
        targets.withColumn("sid", F.row_number().over(by_name)).withColumn("share", share)
        .withColumn("high", F.sum("share").over(by_name)).withColumn("low", F.col("high") - F.col("share"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("words", F.least(F.floor(F.col("target") + 1e-6).cast("long"), F.col("source_size") * max_repeats)), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    needed = whole * F.col("blocks") + F.ceil((F.col("words") - whole * F.col("source_size")) / block)
    plan = schedule(numbered, slots, bucket_rows)
    # the schedule misses a source's share by a few slots at most: these close it
    counted = plan.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    closing = (numbered.join(counted, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)))
               .withColumn("needed", needed.cast("long")).filter("needed > had")
               .select("sid", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("rank")))
    ranked = plan.select("sid", "rank").unionByName(closing)
    lap, turn = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    reached = lap * F.col("source_size") + turn * block
    played = (ranked.join(numbered.filter("blocks > 0").select("sid", "blocks", "source_size", "words"), "sid")
              .withColumn("block", turn).withColumn("until", F.least(F.lit(block), F.col("words") - reached))
              .filter("until > 0").groupBy("sid", "block").agg(F.collect_list("until").alias("plays")))  # at most max_repeats + 1 a block
    extra = ["text_key"] if key else []
    # documents on their source's line of words, in shuffled order
    keyed = sized.join(numbered.select("source", "sid", "source_size", "target"), sized["source"].eqNullSafe(numbered["source"])).drop("source")
    mixed = keyed.withColumn("mixed", F.xxhash64("doc_id", F.lit(seed)))
    n_buckets = max(1, sized.count() // bucket_rows)
    laid = _running(mixed, "sid", "size", ["mixed", "doc_id", "size", "nth"], F.floor((F.col("mixed") / float(2**64) + 0.5) * n_buckets), "at")
    laid = materialize(laid.select("nth", "doc_id", *extra, "sid", "size", "source_size", "target", "at"), "laid")
    parts = (laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
             .withColumn("lo", F.greatest(F.col("at") - F.col("block") * block, F.lit(0)))
             .withColumn("hi", F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block)))
             .select("nth", "sid", "block", "lo", "hi"))
    words = F.aggregate("plays", F.lit(0).cast("long"), lambda s, u: s + F.greatest(F.least(F.col("hi"), u) - F.col("lo"), F.lit(0)))
    taken = parts.join(played, ["sid", "block"]).groupBy("nth").agg(F.sum(words).alias("taken"))
    return laid.join(taken, "nth", "left").select("doc_id", *extra, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17,
                  id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it: the
    words taken by its size, rounded. Only the one document of each source that
    the mix ends in is taken in part, so a source's words miss its target by half
    a document at most. Documents without words are not taken. Rows with the same
    id and text share what is taken of them."""
    taken = mix_counts(docs, weights, max_repeats, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, key=True)
    copies = F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int")
    wanted = materialize(taken.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(copies.alias("_copies")).filter("_copies > 0"), "copies")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"))
    same = (keyed["_key"] == wanted["_key"]) & keyed["_id"].eqNullSafe(wanted["_id"])
    return keyed.join(wanted, same).select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth")).select("row.*")
