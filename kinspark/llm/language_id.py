"""Language identification by compression.

Per language, a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is
compressed with each dictionary, and the language whose dictionary leaves the fewest bytes is predicted.
Long texts are compressed in blocks (all of them), so that the dictionary and not the text itself is what
matters; the sizes add up. The score is the margin over the second language; below ``min_margin`` the
prediction is marked as rejected.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0. Null ids count as the empty id for the
hold-out rule. Repeated rows are predicted alike. Without any labelled text everything is ``und``. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import documents

UNKNOWN = "und"
FOLDS = 5
#: Bounds of what is fitted: sampled texts, characters of each, and dictionary bytes per language.
SAMPLE_TEXTS = 64
SAMPLE_BYTES = 2_000
DICTIONARY_BYTES = 32_000
#: A language's sample is drawn from so many samples of its parts, so that no task ranks all of them.
PARTS = 256
BLOCK_BYTES = 4_000
LEVEL = 7
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the document is kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def normalised(text: str) -> bytes:
    return (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace")


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Language -> dictionary content, from at most SAMPLE_TEXTS not held-out texts of each language.

    The sample is the texts with the smallest hash of their id; at most SAMPLE_TEXTS times SAMPLE_BYTES
    characters of each language, of which there is no limit, reach the driver.
    """
    df = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # Ranked by ids alone; the texts of the winners are read afterwards.
    ids = df.select("lang", "doc_id", F.xxhash64("doc_id").alias("hash")).distinct()
    ids = ids.withColumn("part", F.pmod("hash", F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("hash", "doc_id"))
        ids = ids.withColumn("place", place).filter(F.col("place") <= SAMPLE_TEXTS)
    chosen = df.join(ids.select("lang", "doc_id"), ["lang", "doc_id"])
    chosen = chosen.select("lang", "doc_id", F.expr(f"left(text, {SAMPLE_BYTES})").alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    rows = chosen.withColumn("place", place).filter(F.col("place") <= SAMPLE_TEXTS).collect()
    content: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        content[r["lang"]] = content.get(r["lang"], b"") + normalised(r["text"])
    return {lang: content[lang][:DICTIONARY_BYTES] for lang in sorted(content)}


class Classifier:
    """Compressors of one worker."""

    def __init__(self, content: dict[str, bytes]):
        self.languages = list(content)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.compressors = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for d in content.values()
        ]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = normalised(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        score = 1.0 if second is None else (second - sizes[best]) / second
        return self.languages[best], min(1.0, max(0.0, score))


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = 0.005) -> DataFrame:
    """``doc_id, text`` of ``docs`` -> doc_id, held_out, lang_pred, score, rejected. Only the text decides."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(content)
        for batch in batches:
            found = [classifier.predict(x.as_py()) for x in batch.column(2)]
            languages = pa.array([x[0] for x in found], type=pa.string())
            scores = pa.array([x[1] for x in found], type=pa.float64())
            rejected = pa.array([x[1] < min_margin for x in found], type=pa.bool_())
            arrays = [batch.column(0), batch.column(1), languages, scores, rejected]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    df = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return df.mapInArrow(predicted, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, dictionaries(docs))
