"""SQL for the check database: the queries of this folder that SQL can express, by plain rules."""

from __future__ import annotations

from kinspark.llm import lexical_search, ngram_jaccard, quality_rules, spelling_variants, top_k_search, warc

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({top_k_search.SCALE} * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % {top_k_search.QUERY_STEP} = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
WHERE rank <= {top_k_search.K}"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {ngram_jaccard.SIZE}
    THEN list_transform(range(1, len(w) - {ngram_jaccard.SIZE} + 2), lambda i: array_to_string(w[i : i + {ngram_jaccard.SIZE} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle AS a JOIN shingle AS b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b
  WHERE 100 * c >= {ngram_jaccard.PERCENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN size USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id"""

_BITS = ", ".join(f"'{i:04b}'" for i in range(16))
_FIVE = " + ".join(f"{16 >> k} * (substr(bits, 5 * i + {k + 1}, 1) = '1')::INT" for k in range(5))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
hashed AS (
  SELECT *, sha1(h) AS hex, CASE WHEN n >= {warc.MIN_PAYLOAD} THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p),
spelt AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: [{_BITS}][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits
  FROM hashed)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM spelt"""


def _rules() -> str:
    r = quality_rules.Rules()
    left, patterns = ["coalesce(text, '')"], ["[a-z]+", "[A-Z]+", "[0-9]+", r"[\x20\x09-\x0D]+", r"[\x00-\x7F]+"]
    for pattern in patterns:
        left.append(f"regexp_replace({left[-1]}, '{pattern}', '', 'g')")
    lengths = [f"length({x})" for x in left]
    classes = ", ".join([f"{a} - {b}" for a, b in zip(lengths, lengths[1:])] + lengths[-1:])
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    jsd = f"sqrt(greatest(0, sum(({term.format('p', 'q')} + {term.format('q', 'p')}) / 2)))"
    return f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("text")} AS w, [{classes}] AS classes FROM documents),
base AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(text) AS chars,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines
  FROM d),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s
  FROM d WHERE len(w) >= 5),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 5) AS t(k) GROUP BY doc_id),
word AS (SELECT doc_id, lang, unnest(w) AS x FROM d),
total AS (SELECT lang, count(*)::DOUBLE AS n FROM word GROUP BY lang),
listed AS (
  SELECT lang, x, count(*) AS n FROM word WHERE length(x) <= {r.common_word_chars} GROUP BY lang, x
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {r.common_words}),
bins AS (
  SELECT lang, x, listed.n / total.n AS q FROM listed JOIN total USING (lang)
  UNION ALL SELECT lang, NULL, 1 - coalesce(sum(listed.n), 0) / any_value(total.n) FROM total LEFT JOIN listed USING (lang) GROUP BY lang),
held AS (SELECT doc_id, lang, listed.x, count(*)::DOUBLE AS n FROM word LEFT JOIN listed USING (lang, x) GROUP BY ALL),
word_jsd AS (
  SELECT doc_id, {jsd} AS distance FROM (
    SELECT b.doc_id, coalesce(h.n, 0) / b.n_words AS p, bins.q FROM base AS b JOIN bins USING (lang)
    LEFT JOIN held AS h ON h.doc_id = b.doc_id AND h.x IS NOT DISTINCT FROM bins.x WHERE b.n_words > 0) GROUP BY doc_id),
class AS (SELECT doc_id, lang, unnest(range(1, 7)) AS k, unnest(classes)::DOUBLE AS n FROM d),
class_q AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM class GROUP BY lang, k),
class_jsd AS (
  SELECT doc_id, {jsd} AS distance FROM (
    SELECT c.doc_id, c.n / sum(c.n) OVER (PARTITION BY c.doc_id) AS p, q FROM class AS c JOIN class_q USING (lang, k)
    QUALIFY sum(c.n) OVER (PARTITION BY c.doc_id) > 0) GROUP BY doc_id),
judged AS (
  SELECT b.*, coalesce(covered.n, 0) AS n_repeat_words, word_jsd.distance AS wd, class_jsd.distance AS cd,
    n_words < {r.min_words} OR 100 * coalesce(covered.n, 0) > {r.max_repeat_percent} * n_words AS base_failed
  FROM base AS b LEFT JOIN covered USING (doc_id) LEFT JOIN word_jsd USING (doc_id) LEFT JOIN class_jsd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(chars >= {r.class_min_chars} AND cd > {r.max_class_distance}, false)
    OR coalesce(n_words >= {r.word_min_words} AND wd > {r.max_word_distance}, false)) AS kept
FROM judged"""


# The checksum byte by byte from its table of 256; near words share the rest after one deletion, at equal places
# if a letter was replaced.
VARIANTS = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
spelt AS (SELECT w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM run GROUP BY w, doc_id),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM spelt, crc),
word AS (
  SELECT CASE WHEN h % {spelling_variants.DELETE_EVERY} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word,
    sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {spelling_variants.MIN_LENGTH} AND sum(hashed.n) >= {spelling_variants.MIN_COUNT}),
rest AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS r
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT a.word, b.word AS v, b.n FROM rest AS a JOIN rest AS b ON a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rest AS a JOIN word AS b ON b.word = a.r
  UNION SELECT b.word, a.word, a.n FROM rest AS a JOIN word AS b ON b.word = a.r),
best AS (
  SELECT word, v, n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, v) = 1),
formed AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {spelling_variants.FACTOR} * w.n THEN v END AS form,
    CASE WHEN b.n >= {spelling_variants.FACTOR} * w.n THEN b.n END AS form_n
  FROM word AS w LEFT JOIN best AS b USING (word)),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT chain.word, form FROM chain JOIN formed ON formed.word = chain.at WHERE form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN chain AS c USING (word) JOIN formed AS e ON e.word = c.at AND e.form IS NULL"""

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH term AS (
  SELECT row, doc_id, term, count(*) AS tf FROM (
    SELECT row, doc_id, unnest({_TERMS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)) GROUP BY ALL),
doc AS (SELECT row, sum(tf)::BIGINT AS n FROM term GROUP BY row),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM doc),
norm AS (SELECT row, {100 - lexical_search.SLOPE} + ({lexical_search.SLOPE} * n * docs) // words AS m FROM doc, size),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM term, size GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS term FROM benchmark),
scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN term USING (term) JOIN norm USING (row) GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored QUALIFY rank <= {lexical_search.K}"""


ORACLE_SQL = {
    "op4_top_k_search": TOP_K,
    "op6_ngram_jaccard": JACCARD,
    "op9_quality_rules": _rules(),
    "op10_warc": WARC,
    "op11_spelling_variants": VARIANTS,
    "op12_lexical_search": SEARCH,
}
