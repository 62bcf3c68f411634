"""Mixing sources to target weights by a low-discrepancy schedule.

* Targets: sources weigh 5, 2, 1, repeating, in code point order (null last). They share all words; no
  target exceeds ``MAX_PASSES`` times its source's words, the excess goes to the others by weight.
* Blocks: the documents of a source, shuffled by a hash of their id, are one run of words that is cut
  into equal blocks of at most ``block_words`` words (at least ``MIN_BLOCKS`` blocks, or one a word).
* Schedule: slot j carries the point j * A mod M, a golden-ratio sequence in integers. The points fall
  into the cumulative shares of the sources; the r-th slot of a source takes its block r mod blocks.
  A slot beyond ``MAX_PASSES`` passes over its source stays empty.

A source may hold most of all rows: its running sums go over hash buckets and then within each, and
slots are ranked over chunks and then within each, so no task holds a source. Targets need windows over
one row per source, nothing larger.

Null texts have no words; documents without words are returned with 0 taken. Repeated ids are told
apart by nothing but their rows and get one result row each. No rows: no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.llm.common import documents, n_words, words

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 128
MIN_BLOCKS = 1024
#: Points of the schedule are j * GOLDEN mod MODULUS; GOLDEN is odd, so a period meets every point once.
MODULUS = 1 << 31
GOLDEN = 1327217885
#: Documents of a source in one window, and slots of a source in one window, at most about so many.
DOCS_PER_BUCKET = 20_000
SLOTS_PER_CHUNK = 1 << 16


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, size) -> one row per source: source_size, target, blocks, and its slots' bounds in the schedule."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS)) + 1)
    totals = totals.withColumn("weight", weight).withColumn("limit", MAX_PASSES * F.col("source_size"))
    # Sources reach their limit in the order of limit / weight; the level is fixed by the first that does not.
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = totals.withColumn("k", F.row_number().over(by_ratio)).withColumn("level", left / weights)
    free = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("k"))
    df = df.withColumn("first", F.min(free).over(everyone))
    level = F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everyone)
    df = df.withColumn(
        "target",
        F.when(F.col("k") < F.col("first"), F.col("limit").cast("double")).otherwise(level * F.col("weight")),
    )
    whole = F.greatest(F.ceil(F.col("source_size") / block_words), F.least(F.lit(MIN_BLOCKS), "source_size"))
    df = df.withColumn("blocks", whole.cast("long"))
    # Slots a source should get; blocks of one source are equal, those of two sources need not be.
    df = df.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("due").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("due").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.row_number().over(in_order) == F.count(F.lit(1)).over(everyone)
    df = df.withColumn("high", F.when(last, F.lit(MODULUS)).when(total > 0, F.floor(upto / total * MODULUS)).otherwise(0).cast("long"))
    df = df.withColumn("low", F.coalesce(F.lag("high").over(in_order), F.lit(0)).cast("long"))
    df = df.withColumn("slots", F.ceil(total).cast("long"))
    return df.select("source", "source_size", "target", "blocks", "low", "high", "slots")


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """One row per filled slot: slot, source, block, pass."""
    count = targets.agg(F.max("slots")).first()[0] or 0
    rows = [r for r in targets.select("source", "blocks", "low", "high").collect() if r["high"] > r["low"]]
    rows.sort(key=lambda r: r["low"])
    ends = F.array(*[F.lit(r["high"]) for r in rows]) if rows else F.array(F.lit(0))
    slots = spark.range(1, count + 1).select(F.col("id").alias("slot"))
    point = (F.col("slot") % MODULUS) * GOLDEN % MODULUS
    slots = slots.withColumn("point", point)
    # The number of sources whose interval ends at or before the point: the place of the source.
    slots = slots.withColumn("place", F.size(F.filter(ends, lambda e: e <= F.col("point"))))
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / SLOTS_PER_CHUNK))
    per_chunk = slots.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("in_chunk", rank).join(per_chunk, ["place", "chunk"])
    ranked = ranked.withColumn("rank", F.col("in_chunk") + F.col("earlier"))
    names = F.array(*[F.lit(r["source"]).cast("string") for r in rows]) if rows else F.array(F.lit(None).cast("string"))
    blocks = F.array(*[F.lit(r["blocks"]) for r in rows]) if rows else F.array(F.lit(1))
    ranked = ranked.withColumn("source", names[F.col("place")]).withColumn("blocks", blocks[F.col("place")])
    ranked = ranked.filter(F.col("rank") < MAX_PASSES * F.col("blocks"))
    return ranked.select(
        "slot", "source",
        (F.col("rank") % F.col("blocks")).alias("block"),
        F.floor(F.col("rank") / F.col("blocks")).alias("pass"),
    )


def document_runs(sizes: DataFrame) -> DataFrame:
    """Adds ``first``: the words of the source before each document in the shuffled order.

    ``sizes``: row_id (unique), doc_id, source, size. Order: md5 of the id, then row_id.
    """
    buckets = max(1, -(-sizes.count() // DOCS_PER_BUCKET))
    df = sizes.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    df = df.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    sums = df.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"),
    )
    within = Window.partitionBy("source", "bucket").orderBy("order", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return df.withColumn("first", F.col("earlier") + F.col("within")).drop("earlier", "within", "s", "b", "order", "bucket")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken: one row per row of ``docs``."""
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    sizes = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words("text").alias("size"), text_hash.alias("text_hash"))
    # Rows of one id differ by text at most; equal rows may swap places without changing any result.
    sizes = sizes.withColumn("row_id", F.col("text_hash"))
    targets = source_targets(sizes, block_words)
    runs = document_runs(sizes).join(
        targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    times = schedule(spark, targets).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    has = F.col("size") > 0
    # Block b starts at word b * short + floor(b * rest): equal blocks but for one word, spread evenly.
    runs = runs.withColumn("short", F.when(has, F.expr("source_size div blocks")))
    runs = runs.withColumn("rest", F.when(has, F.expr("(source_size % blocks) / blocks")))

    def start(block):
        return block * F.col("short") + F.floor(block * F.col("rest"))

    def block_of(word: str):
        near = F.floor(F.col(word) / (F.col("short") + F.col("rest")))
        word = F.col(word)
        return near + (start(near + 1) <= word).cast("long") - (start(near) > word).cast("long")

    runs = runs.withColumn("last", F.col("first") + F.col("size") - 1)
    runs = runs.withColumn("from", F.when(has, block_of("first")))
    runs = runs.withColumn("to", F.when(has, F.least(block_of("last"), F.col("blocks") - 1)))
    pieces = runs.select("*", F.explode_outer(F.when(has, F.sequence("from", "to"))).alias("block"))
    final = F.col("block") + 1 == F.col("blocks")
    end = F.when(final, F.col("source_size")).otherwise(start(F.col("block") + 1))
    begin = start(F.col("block"))
    pieces = pieces.withColumn("words", F.least(end, F.col("last") + 1) - F.greatest(begin, F.col("first")))
    times = times.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    taken = pieces.join(times, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    keys = ["doc_id", "text_hash", "source", "size", "source_size", "target", "first"]
    # Documents without words share their place with the next one, so copies of them are told apart by a count.
    taken = taken.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).cast("long").alias("taken"),
        F.count(F.when(~has, 1)).alias("empty"),
    )
    copies = F.explode(F.array_repeat(F.lit(1), F.greatest(F.lit(1), F.col("empty").cast("int"))))
    return taken.select(*keys, "taken", copies.alias("_")).drop("_")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: a row per time that a document is taken, columns unchanged (``n_chars`` follows the text).

    A document at the end of its source's last pass is taken in part, with as many words from its start.
    """
    # Repeated rows of an id and text take the numbers of one array, so the texts are dealt out once.
    key = F.struct("doc_id", "text_hash").alias("_key")  # structs are equal where their nulls are
    taken = mix(docs, block_words).filter("taken > 0").select(key, "taken", "size")
    taken = taken.groupBy("_key").agg(F.sort_array(F.collect_list("taken")).alias("_takes"), F.first("size").alias("_size"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    df = docs.withColumn("_key", F.struct(F.col("doc_id").alias("doc_id"), text_hash.alias("text_hash"))).join(taken, "_key")
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1))) - 1
    df = df.withColumn("_place", place).withColumn("_taken", F.get("_takes", F.col("_place"))).filter("_taken IS NOT NULL")
    df = df.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    left = F.col("_taken") - (F.col("_pass") - 1) * F.col("_size")
    part = F.array_join(F.slice(words("text"), F.lit(1), F.greatest(F.lit(1), left.cast("int"))), " ")
    df = df.withColumn("_text", F.when(left >= F.col("_size"), F.col("text")).otherwise(part))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return df.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "taken")
