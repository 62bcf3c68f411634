"""Quality rules by distribution divergence.

A document is rejected if it fails a base rule (too few words, or too much of it in five-word windows
that recur inside it), or if one of two histograms lies too far, by Jensen-Shannon distance, from the
reference of its language:

* character classes: ASCII lower case, upper case, digits, white space, other ASCII, beyond ASCII;
* common words: the language's most frequent short words, and the rest in one bin.

References are learned from all documents, one per value of the language column however many there are.
Documents of a null language have no reference and are judged by the base rule alone. A divergence counts
only in documents long enough for their histogram to mean something.

Null texts count as empty: no words, rejected by the base rule. A null or repeated id stays as it is:
rules look at one row at a time. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import SPACE, n_words, words
from kinspark.sources.stage import Stage

CLASSES, SPACE_CLASS = 6, 3


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 16
    #: Function words are short; longer words are in the rest of the histogram.
    common_word_chars: int = 5
    #: Jensen-Shannon distances (square roots of divergences in bits, 0 to 1).
    max_class_distance: float = 0.28
    max_word_distance: float = 0.46
    #: Below these lengths a histogram is noise and its distance is not judged.
    class_min_chars: int = 250
    word_min_words: int = 40


def character_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``classes``: code points per class, and ``symbols``: those of ``[#*$%&|<>]``.

    Each pattern sees only what the earlier ones left; for symbols that is the text without letters, digits and space.
    """
    left = df.withColumn("_0", F.coalesce(F.col(text), F.lit("")))
    patterns = ["[a-z]+", "[A-Z]+", "[0-9]+", SPACE, r"[\x00-\x7F]+"]
    for i, pattern in enumerate(patterns):
        left = left.withColumn(f"_{i + 1}", F.regexp_replace(f"_{i}", pattern, ""))
    lengths = [F.length(f"_{i}") for i in range(CLASSES)]
    counts = [a - b for a, b in zip(lengths, lengths[1:])] + [lengths[-1]]
    symbols = F.length(F.regexp_replace("_4", "[^#*$%&|<>]+", ""))
    return left.select(*df.columns, F.array(*counts).alias("classes"), symbols.alias("symbols"))


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row per language: class shares, common words, shares of these words and of all others.

    Written as a table, so that its join is a broadcast where its size allows and a shuffle beyond.
    """
    df = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text")).filter(F.col("lang").isNotNull())
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)]
    totals = character_classes(df.withColumn("n", n_words()), "text").groupBy("lang").agg(*sums, F.sum("n").alias("total"))
    parts = F.split(F.coalesce("text", F.lit("")), SPACE)
    short = F.filter(parts, lambda w: (w != "") & (F.length(w) <= rules.common_word_chars))
    counted = df.select("lang", F.explode(short).alias("word")).groupBy("lang", "word").count()
    by_count = Window.partitionBy("lang").orderBy(F.desc("count"), F.asc("word"))
    top = counted.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= rules.common_words)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "count"))).alias("listed"))
    df = totals.join(listed, "lang", "left").withColumn("counts", F.array(*[f"c{i}" for i in range(CLASSES)]))
    df = df.withColumn("listed", F.expr("coalesce(listed, slice(array(struct(0 AS place, '' AS word, 0L AS count)), 1, 0))"))
    df = df.withColumn("chars", F.expr("aggregate(counts, 0L, (a, c) -> a + c)"))
    df = df.withColumn("common", F.expr("aggregate(listed, 0L, (a, l) -> a + l.count)"))
    df = df.select(
        F.col("lang").alias("ref_lang"),
        F.struct(
            F.expr("transform(counts, c -> coalesce(try_divide(double(c), chars), 0D))").alias("classes"),
            F.col("listed.word").alias("words"),
            F.expr("array_max(transform(listed.word, w -> octet_length(w)))").alias("longest"),
            F.expr("transform(concat(listed.count, array(total - common)), c -> coalesce(try_divide(double(c), total), 0D))").alias("word_shares"),
        ).alias("ref"),
    )
    return Stage(docs.sparkSession).save("references", df)


def distance(counts: str, reference: str) -> F.Column:
    """Jensen-Shannon distance of a count array and an array of shares; null if either is empty."""
    return F.expr(f"""
        CASE WHEN aggregate({counts}, 0L, (a, c) -> a + c) > 0 AND aggregate({reference}, 0D, (a, c) -> a + c) > 0 THEN
          sqrt(greatest(0D, aggregate(
            zip_with(transform({counts}, c -> c / aggregate({counts}, 0D, (a, x) -> a + x)), {reference}, (p, q) ->
              (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0D END
               + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0D END) / 2),
            0D, (a, x) -> a + x)))
        END""")


def measured(docs: DataFrame, rules: Rules = Rules(), refs: DataFrame | None = None) -> DataFrame:
    """``docs`` with the measures and verdicts added, one row per row.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance,
    base_failed, kept. Columns of these names in the input are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]
    refs = references(docs, rules) if refs is None else refs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(whole.alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("lang"))
    df = df.join(refs, F.col("lang") == F.col("ref_lang"), "left")
    df = df.withColumn("w", words()).withColumn("n", F.size("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    df = df.withColumn("hashes", F.expr("transform(slice(w, 1, greatest(n - 4, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2], w[i + 3], w[i + 4]))"))
    df = df.withColumn("recurs", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    windows = "sort_array(transform(hashes, (h, i) -> struct(concat_ws(' ', slice(w, i + 1, 5)) AS win, i AS i)))"
    df = df.withColumn("sorted", F.expr(f"CASE WHEN recurs THEN {windows} END"))
    df = df.withColumn(
        "places",
        F.expr(
            "CASE WHEN recurs THEN sort_array(array_distinct(flatten(transform(slice(sorted, 2, size(sorted)),"
            " (s, i) -> IF(s.win = sorted[i].win, array(sorted[i].i, s.i), array()))))) END"
        ),
    )
    repeated = "5 + aggregate(transform(slice(places, 2, size(places)), (p, i) -> least(5, p - places[i])), 0, (a, x) -> a + x)"
    df = df.withColumn("repeated", F.expr(f"CASE WHEN recurs AND size(places) > 0 THEN {repeated} ELSE 0 END"))
    df = character_classes(df, "text")
    df = df.withColumn("common", F.expr("filter(w, x -> octet_length(x) <= ref.longest AND array_contains(ref.words, x))"))
    df = df.withColumn("listed", F.expr("transform(ref.words, r -> size(common) - size(array_remove(common, r)))"))
    df = df.withColumn("word_counts", F.expr("concat(listed, array(n - size(common)))"))
    df = df.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        (F.length("text") - F.col("classes")[SPACE_CLASS]).cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
        F.length("text").alias("chars"),
        distance("classes", "ref.classes").alias("class_distance"),
        distance("word_counts", "ref.word_shares").alias("word_distance"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    far = (F.col("chars") >= rules.class_min_chars) & (F.col("class_distance") > rules.max_class_distance)
    far |= (F.col("n_words") >= rules.word_min_words) & (F.col("word_distance") > rules.max_word_distance)
    df = df.withColumn("base_failed", failed)
    df = df.withColumn("kept", ~(F.col("base_failed") | F.coalesce(far, F.lit(False))))
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def query(spark, sf_dir: str) -> DataFrame:
    from kinspark.llm.common import documents

    return measured(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    whole = docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    judged = measured(whole.select("text", "lang", "_whole"), rules)
    # A filter is not pushed below a column that is not deterministic; pushed, it would repeat all measures.
    judged = judged.withColumn("_any", F.rand()).filter("kept AND _any >= 0")
    return judged.select(*[F.col("_whole")[c].alias(c) for c in docs.columns])
