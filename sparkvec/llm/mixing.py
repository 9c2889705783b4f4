"""Mixing sources to target weights by temperature: native, without Python on the executors.

A source with token share p gets weight p**a / sum(p**a). The exponent a is found by bisection: 1 keeps
the natural shares, 0 makes all sources equal. Weights times the token budget are quotas; a quota is
realised as whole epochs of its source and a part of one more. Every epoch has a permutation of its
own: ids are hashed into blocks of about BLOCK_ROWS rows that are taken in hash order, so that the end
of the part epoch is found from block totals and the rows of a single block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_of

BLOCK_ROWS = 4096
# Interior points of one pass: it takes this many + 1 sections, i.e. four steps of bisection.
SECTIONS = 15
PASSES = 9
# Sources that are broadcast at most; with more, rows meet their source in a shuffled join.
BROADCAST_SOURCES = 100_000
KEY_SPAN = 1 << 60


def words(text: Column) -> Column:
    """Number of words, the stand-in for tokens: runs without ASCII white space, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[^ \\t-\\r]+"))).cast("long")


def key_of(seed: int, epoch: Column, id_: Column) -> Column:
    """Place of a row in an epoch's permutation: 60 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def find_exponent(shares: DataFrame, holds: Callable[[Column, Column, Column, Column], Column], low_is_good: bool,
                  low: float = 0.0, high: float = 1.0) -> float:
    """The exponent at which a condition turns, to 36 bits of bisection, rounded to nine decimals.

    `shares` has p. `holds` gets the aggregates sum(p**a), entropy of the weights, min(p), max(p) of one
    exponent and says whether the condition holds. With `low_is_good` it holds for small exponents
    and the largest is sought, else the smallest. If it holds at neither end, the end nearer to
    holding is returned. Each pass is one aggregate over the sources.
    """
    for _ in range(PASSES):
        points = [low + (high - low) * k / (SECTIONS + 1) for k in range(SECTIONS + 2)]
        grid = shares.select("p", F.posexplode(F.array(*map(F.lit, points))).alias("k", "a"))
        power = F.pow("p", "a")
        sums = grid.groupBy("k", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"),
                                          F.min("p").alias("least"), F.max("p").alias("most"))
        entropy = F.log("z") - F.col("a") * F.col("l") / F.col("z")
        good = {r["k"]: r["good"] for r in sums.select("k", holds(F.col("a"), F.col("z"), entropy, F.struct("least", "most")).alias("good")).collect()}
        if not good:
            return high
        order = range(SECTIONS + 2) if low_is_good else range(SECTIONS + 1, -1, -1)
        turn = next((k for k in order if not good[k]), None)
        if turn is None:
            return round(high if low_is_good else low, 9)
        if turn == order[0]:
            return round(points[turn], 9)
        low, high = sorted((points[turn], points[turn - 1 if low_is_good else turn + 1]))
    return round(low if low_is_good else high, 9)


def mix(docs: DataFrame, max_repetition: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: input columns and, per copy, _epoch, _place, _weight, _tokens (in place of input columns so named).

    Give one target: `max_repetition` (the flattest weights that repeat no source more often) or
    `entropy` (the weights closest to the natural ones with at least this entropy, in nats). `budget` is in
    tokens; None takes the smallest one that uses each source in full at least once, so that no row is lost.
    With a budget, a source gets its whole documents up to its quota. Sorting by _place, from 0
    to 1, interleaves the sources in proportion. Null and empty source names are one source; null and
    empty texts count as one token; rows that repeat an id are placed alike; rows without an id share a
    place; an empty table gives an empty mixture. Texts aren't shuffled unless there are more
    than BROADCAST_SOURCES sources.
    """
    if (max_repetition is None) == (entropy is None):
        raise ValueError("give max_repetition or entropy")
    spark = docs.sparkSession
    source = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    slim = store(docs.select(docs[id_col].alias("id"), source.alias("source"), docs[text_col].alias("text"))
                 .select("id", "source", words(text_of()).alias("tokens")), "mix-tokens")
    totals = store(slim.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")), "mix-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    shares = totals.select("source", "n", "rows", (F.col("n") / F.lit(float(max(1, total)))).alias("p"))
    if entropy is not None:
        exponent = find_exponent(shares, lambda a, z, h, ends: h >= entropy, True)
    elif budget is None:
        spread = lambda a, z, h, ends: F.pow(ends["most"] / ends["least"], 1 - a) <= max_repetition
        exponent = find_exponent(shares, spread, False)
    else:
        most = lambda a, z, h, ends: F.pow(ends["least"], a - 1) / z * (budget / max(1, total)) <= max_repetition
        exponent = find_exponent(shares, most, False)
    norm, fullest = shares.agg(F.sum(F.pow("p", F.lit(exponent))), F.max(F.col("p") / F.pow("p", F.lit(exponent)))).first()
    tokens = float(budget) if budget is not None else float(total) * (norm or 0.0) * (fullest or 0.0)
    weight = F.pow("p", F.lit(exponent)) / F.lit(norm or 1.0)
    quota = F.round(weight * F.lit(tokens), 3)
    plan = shares.select("source", "n", "rows", F.round(weight, 9).alias("weight"), quota.alias("quota"),
                         F.floor(quota / F.col("n")).alias("epochs"))
    plan = store(plan.withColumn("rest", F.floor(F.col("quota") - F.col("epochs") * F.col("n"))), "mix-plan")
    plan = store(plan.join(_cuts(slim, plan, seed), "source", "left").select(
        F.col("source").alias("_source"), F.col("weight").alias("_weight"), (F.col("quota") / F.col("n")).alias("_times"), "epochs", "cut"), "mix-cuts")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    made = ("_epoch", "_place", "_weight", "_tokens")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in made]).alias("_row"), docs[id_col].alias("_id"),
                       docs[text_col].alias("_text"), source.alias("_source"))
    met = rows.withColumn("_tokens", words(text_of("_text"))).drop("_text").join(plan, "_source")
    part = F.when(key_of(seed, F.col("epochs"), F.col("_id")) <= F.col("cut"), 1).otherwise(0)
    copies = met.withColumn("_copies", (F.col("epochs") + part).cast("int")).where("_copies > 0")
    copies = copies.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    key = key_of(seed, F.col("_epoch"), F.col("_id"))
    place = F.round((F.col("_epoch") + key / F.lit(float(KEY_SPAN))) / F.col("_times"), 9)
    return copies.withColumn("_place", place).select("_row.*", *made)


def _cuts(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """source, cut: rows with a key up to `cut` fill the part epoch without passing its budget."""
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    sized = plan.select("source", "epochs", "rest", blocks.alias("blocks")).where("rest > 0")
    fits = sized.count() <= BROADCAST_SOURCES
    keyed = slim.join(F.broadcast(sized) if fits else sized, "source")
    keyed = keyed.withColumn("key", key_of(seed, F.col("epochs"), F.col("id")))
    keyed = keyed.withColumn("block", F.floor(F.col("key") / F.lit(float(KEY_SPAN)) * F.col("blocks")))
    keyed = store(keyed.select("source", "block", "key", "tokens", "rest"), "mix-keys")
    sums = keyed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("t"), F.max("key").alias("top"))
    sums = sums.withColumn("through", F.sum("t").over(Window.partitionBy("source").orderBy("block")))
    sums = store(sums, "mix-blocks")
    whole = sums.where("through <= rest").select("source", F.col("top").alias("key"))
    edge = sums.where("through > rest and through - t <= rest").select("source", "block", (F.col("through") - F.col("t")).alias("before"))
    inside = keyed.join(edge, ["source", "block"])
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    part = inside.withColumn("through", running).where("through <= rest").select("source", "key")
    return whole.union(part).groupBy("source").agg(F.max("key").alias("cut"))
