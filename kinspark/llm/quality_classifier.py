"""Quality by hierarchical empirical Bayes.

A classifier fitted on labelled documents gives every document a probability. Documents of one site and of
one path of it share a rate, estimated from all their probabilities: a path's rate is shrunk toward its
site's, a site's toward the global one, each with a prior whose weight follows from how much the rates of
that level really differ (method of moments). The document's own evidence and the rate of its path,
taken without the document itself, are combined as odds.

The classifier (a small forest over character, word and length shares) is fitted on at most ``MAX_LABELS``
labelled documents, those with the smallest hash of their id; everything else covers all rows.

Null texts count as empty. A null site or path is a site or path of its own. Labels that are null or without
a document are left out; if the labels that remain are all of one kind, or none, every document gets the
global rate (1 without labels). Repeated rows are scored alike. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import documents, table, words
from kinspark.llm.quality_rules import CLASSES, character_classes
from kinspark.sources.stage import Stage

MAX_LABELS = 20_000
TREES, DEPTH = 20, 7
#: A document is kept at this posterior probability of good quality.
KEEP = 0.5
EDGE = 1e-3


def features(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and ``features``."""
    df = character_classes(docs.select(*keys, F.coalesce("text", F.lit("")).alias("text")), "text")
    df = df.withColumn("w", words()).withColumn("chars", F.greatest(F.lit(1), F.length("text")))
    n = F.greatest(F.lit(1), F.size("w"))
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")) / F.col("chars")
    shouts = F.length(F.regexp_replace("text", "[^!?]+", "")) / F.col("chars")
    shares = [(F.col("classes")[i] / F.col("chars")).alias(f"f{i}") for i in range(CLASSES)]
    more = {
        "symbols": symbols,
        "shouts": shouts,
        "distinct": F.size(F.array_distinct("w")) / n,
        "length": F.log1p(F.size("w").cast("double")),
        "word": F.col("chars") / n,
    }
    df = df.select(*keys, *shares, *[c.cast("double").alias(name) for name, c in more.items()])
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(CLASSES)] + list(more), outputCol="features")
    return assembler.transform(df).select(*keys, "features")


def fitted(docs: DataFrame, labels: DataFrame, stage: Stage):
    """The classifier, or None if there is nothing to tell apart; and the share of good labels."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = good.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    few = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    train = stage.save("training", features(few, ["label"]))
    kinds = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    rate = kinds.get(1.0, 0) / sum(kinds.values()) if kinds else 1.0
    if len(kinds) < 2:
        return None, rate
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1, minInstancesPerNode=5)
    return forest.fit(train), rate


def weight(rates: DataFrame, level: float | str) -> float:
    """Prior weight of a level from its groups (n, total): the mean within over the variance between."""
    mean = F.col("total") / F.col("n")
    prior = F.lit(level) if isinstance(level, float) else F.col(level)
    row = rates.filter("n > 0").agg(
        F.sum(F.col("n") * (mean - prior) ** 2).alias("between"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("within"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return 100.0
    within = row["within"] / row["n"]
    # E[between] = groups * within + n * variance
    variance = (row["between"] - row["groups"] * within) / row["n"]
    return min(1e6, max(1.0, within / variance)) if variance > 0 else 1e6


def logit(p):
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def scored(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, site_rate, path_rate, quality, kept: a row per row of ``docs``."""
    stage = Stage(docs.sparkSession)
    model, prior = fitted(docs, labels, stage)
    keys = docs.select(F.col("doc_id").alias("doc_id"), F.col(site).alias("site"), F.col(path).alias("path"), F.col("text").alias("text"))
    if model is None:
        rows = keys.select("doc_id", "site", "path", F.lit(prior).alias("p"))
    else:
        probability = vector_to_array("probability")[1]
        rows = model.transform(features(keys, ["doc_id", "site", "path"])).select("doc_id", "site", "path", probability.alias("p"))
    rows = stage.save("evidence", rows)
    mean = rows.agg(F.avg("p")).first()[0]
    mean = prior if mean is None else mean
    paths = rows.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    k_site = weight(sites, mean)
    sites = sites.select(F.col("site").alias("s"), ((F.col("total") + k_site * mean) / (F.col("n") + k_site)).alias("site_rate"))
    paths = paths.join(sites, F.col("site").eqNullSafe(F.col("s"))).drop("s")
    k_path = weight(paths, "site_rate")
    paths = paths.withColumnsRenamed({"site": "s", "path": "q"})
    rows = rows.join(paths, F.col("site").eqNullSafe(F.col("s")) & F.col("path").eqNullSafe(F.col("q")))
    rate = (F.col("total") - F.col("p") + k_path * F.col("site_rate")) / (F.col("n") - 1 + k_path)
    rows = rows.withColumn("path_rate", rate)
    odds = logit(F.col("path_rate")) + logit(F.col("p")) - logit(F.lit(mean))
    quality = 1 / (1 + F.exp(-odds))
    return rows.select("doc_id", F.col("p").alias("evidence"), "site_rate", "path_rate", quality.alias("quality"), (quality >= KEEP).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
