"""Mixing sources by temperature.

Source weights are token shares raised to an exponent and normalised.  The
exponent is bisected (a grid of it in each pass over the shares) to the
largest one at which the weights reach a target entropy, or to the smallest
one that repeats no source more often than a limit.  The token budget is then
realised: a source of ``r`` times its size gets ``floor(r)`` full passes and
one part of a pass, which takes documents in the order of a hash permutation
until the rest of its budget is met.  Passes of all sources are cut into
blocks that hold their shares of the budget, and each block has a permutation
of its own.

Tokens are runs of characters other than blank and U+0009 to U+000D.  A null
source is a source of its own; null or empty texts have no tokens and come
along with each pass of their source (one pass if the whole source has none).
Rows equal in id, source and text have one place and are taken together.  An
empty table gives an empty result.  The stage form leaves all columns as they
are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyho.llm.common import staged

BLOCK_TOKENS = 1 << 20
MAX_REPEATS = 4.0
SEED = 20
KEY_BITS, DIGIT_BITS = 48, 12      # the permutation key, found 12 bits at a time
GRID, PASSES = 32, 4


def _rows(source: Column, text: Column, doc_id: Column) -> list[Column]:
    """Columns ``_source, _tokens, _key`` of a row."""
    return [F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("_source"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_tokens"),
            F.shiftrightunsigned(F.xxhash64(F.lit(SEED), source, doc_id, text), 64 - KEY_BITS).alias("_key")]


def find_exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """Bisect the exponent in [0, 1] over the positive shares ``p``.

    Entropy falls and repetition (against the largest source) falls as the
    exponent grows from 0 (uniform) to 1 (as found).  ``entropy`` is a
    fraction of the logarithm of the number of sources.
    """
    positive = shares.where("p > 0")
    ends = positive.agg(F.max("p").alias("top"), F.min("p").alias("low"), F.count("*").alias("n")).first()
    if not ends.n or ends.n == 1:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        steps = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        if max_repeats is not None:
            fits = [(ends.top / ends.low) ** (1 - a) <= max_repeats for a in steps]
            first = fits.index(True) if any(fits) else GRID
            low, high = steps[max(0, first - 1)], steps[first]
            continue
        power = {i: F.pow(F.col("p"), F.lit(a)) for i, a in enumerate(steps)}
        sums = positive.agg(*[F.sum(x).alias(f"z{i}") for i, x in power.items()],
                            *[F.sum(x * F.log("p")).alias(f"l{i}") for i, x in power.items()]).first()
        reached = [math.log(sums[f"z{i}"]) - a * sums[f"l{i}"] / sums[f"z{i}"] >= entropy * math.log(ends.n)
                   for i, a in enumerate(steps)]
        last = max((i for i, x in enumerate(reached) if x), default=0)
        low, high = steps[last], steps[min(GRID, last + 1)]
    return high if max_repeats is not None else low


def mixing_plan(rows: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
                budget: int | None = None) -> tuple[DataFrame, int]:
    """Plan of each source, and the number of blocks.

    ``rows`` has ``_source, _tokens, _key``.  ``budget`` is in tokens; by
    default it is the least that takes every document at least once.  The
    plan has one row a source: weight, repeats, full passes, and ``cut``, the
    last key of the part of a pass (-1: no part).
    """
    sums = staged(rows.groupBy("_source").agg(F.sum("_tokens").alias("size")), "sources")
    total = sums.agg(F.sum("size").alias("s"), F.max("size").alias("m")).first()
    if not total.s:
        plan = sums.select("_source", "size", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"),
                           F.lit(1).alias("full"), F.lit(-1).cast("long").alias("cut"))
        return plan, 1
    shares = sums.withColumn("p", F.col("size") / total.s)
    a = find_exponent(shares, entropy, None if entropy is not None else max_repeats)
    z = shares.where("p > 0").agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    top = total.m / total.s
    tokens = float(budget) if budget else total.s * top ** (1 - a) * z
    planned = (shares.withColumn("weight", F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / z).otherwise(0.0))
               .withColumn("repeats", F.when(F.col("p") > 0, F.col("weight") * tokens / F.col("size")).otherwise(1.0))
               .withColumn("full", F.floor(F.col("repeats") + 1e-9).cast("int"))
               .withColumn("rest", F.greatest(F.lit(0.0), (F.col("repeats") - F.col("full")) * F.col("size"))))
    cut = find_cuts(rows, planned.where("rest > 1e-6 * size").select("_source", "rest"))
    plan = (planned.join(cut, "_source", "left")
            .select("_source", "size", "weight", "repeats", "full",
                    F.coalesce("cut", F.lit(-1)).cast("long").alias("cut")))
    return staged(plan, "mixplan"), max(1, math.ceil(tokens / BLOCK_TOKENS))


def find_cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_source, cut``: the least key up to which a source holds ``rest`` tokens.

    The key is found from its highest digits down: tokens are summed by digit
    (at most 4,096 sums a source, whatever its size), and only documents of
    the digit in which the running sum reaches ``rest`` are looked at next.
    """
    found = staged(wanted.select("_source", F.col("rest").cast("double").alias("rest"),
                                 F.lit(0).cast("long").alias("cut")), "cuts")
    order = Window.partitionBy("_source").orderBy("digit")
    for level in range(1, KEY_BITS // DIGIT_BITS + 1):
        shift = KEY_BITS - level * DIGIT_BITS
        at = rows.withColumn("digit", F.shiftright("_key", shift))
        if level > 1:
            at = at.withColumn("cut", F.shiftright("digit", DIGIT_BITS)).join(found.select("_source", "cut"), ["_source", "cut"])
        sums = at.groupBy("_source", "digit").agg(F.sum("_tokens").alias("t"))
        running = (sums.join(found.select("_source", "rest"), "_source")
                   .withColumn("upto", F.sum("t").over(order)).where("upto >= rest"))
        found = staged(running.groupBy("_source").agg(
            F.min_by("digit", "digit").alias("cut"),
            F.min_by(F.col("rest") - (F.col("upto") - F.col("t")), "digit").alias("rest")), "cuts")
    return found.select("_source", "cut")


def _schedule(rows: DataFrame, plan: DataFrame, blocks: int) -> DataFrame:
    """``rows`` once for each pass that takes them, with ``_pass, _block, _place``.

    The plan has one row a source; the planner sends it to all tasks if it is
    small, and otherwise joins on the source with skewed parts split.
    """
    part = F.col("_key") / float(1 << KEY_BITS)
    return (rows.join(plan.select("_source", "repeats", "full", "cut"), "_source")
            .withColumn("_times", F.col("full") + (F.col("_key") <= F.col("cut")).cast("int"))
            .where("_times > 0")
            .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
            .withColumn("_block", F.least(F.lit(blocks - 1), F.floor(
                (F.col("_pass") + part) / F.greatest("repeats", F.lit(1e-12)) * blocks)).cast("long"))
            .withColumn("_place", F.xxhash64(F.lit(SEED), "_block", "_pass", "_key")))


def mix_query(docs: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The schedule: a row for each document and pass, with its block and its
    place in the block's permutation (by ``place``, then ``doc_id``)."""
    rows = staged(docs.select("doc_id", "source", *_rows(F.col("source"), F.col("text"), F.col("doc_id"))), "mixrows")
    plan, blocks = mixing_plan(rows, max_repeats=max_repeats)
    return _schedule(rows, plan, blocks).select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_pass").alias("pass"),
        F.col("_block").alias("block"), F.col("_place").alias("place"))


def mix_documents(docs: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as planned, in scheduled order."""
    names = docs.columns
    column = {c.lower(): F.col("_doc")[c] for c in names}
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    rows = boxed.select("_doc", *_rows(column["source"], column["text"], column["doc_id"]))
    plan, blocks = mixing_plan(staged(rows.drop("_doc"), "mixrows"), max_repeats=max_repeats)
    mixed = _schedule(rows, plan, blocks).select("_doc", "_block", "_place")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (mixed.repartitionByRange(parts, "_block", "_place").sortWithinPartitions("_block", "_place")
            .select(*[F.col("_doc")[c].alias(c) for c in names]))
