"""The operators' results in DuckDB SQL, where SQL can express them.

Not expressible: trained models (toxicity, language ID, HTML extraction), tokenizers (token attribution, packing),
64-bit row hashes (fingerprints) and the template automata of the licence scan; these are tested
against brute force instead.
"""

from __future__ import annotations

from mailsift.llm import hard_negatives as negatives
from mailsift.llm import lexical_search, mixing, sharding

_WEIGHTS = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
_SCALE = negatives.SCALE
_BLOCK, _MOST = mixing.BLOCK_WORDS, mixing.MOST_COPIES


def _hex(text: str, start: int, length: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, {length}))::BIGINT"


_KEY = f"'{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')"
_START = f"'{mixing.SEED}/' || coalesce(source, '') || '/' || shard::VARCHAR"

MIXING = f"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         {_hex(_KEY, 1, 8)} AS deal, substr(md5({_KEY}), 9, 16) AS place FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         greatest(ceil(sum(size) / {mixing.SHARD_WORDS}.0), ceil(count(*) / {mixing.SHARD_ROWS}.0), 1)::BIGINT AS shards
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, {_WEIGHTS}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS weight,
         {_MOST} * source_size AS room FROM sources),
levelled AS (
  SELECT *, room::DOUBLE / weight AS level,
         ({mixing.SHARE} * sum(source_size) OVER ()
          - coalesce(sum(room) OVER (ORDER BY room::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY room::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reached
  FROM weighted),
aims AS (
  SELECT *, least(room::DOUBLE, coalesce(max(reached) FILTER (reached <= level) OVER () * weight, room::DOUBLE)) AS target FROM levelled),
totals AS (SELECT round(sum(target) / {_BLOCK})::BIGINT AS blocks FROM aims),
source_seats AS (
  SELECT source, count(*) AS source_blocks FROM (
    SELECT source FROM (
      SELECT source, target, unnest(range(0, (target / {_BLOCK} + 40)::BIGINT)) AS k FROM aims WHERE target > 0)
    ORDER BY target / (2 * k + 1) DESC, source NULLS LAST LIMIT (SELECT blocks FROM totals)) GROUP BY source),
shards AS (
  SELECT s.source, deal % shards AS shard, sum(size) AS shard_size, any_value(coalesce(source_blocks, 0)) AS source_blocks
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
  LEFT JOIN source_seats t ON s.source IS NOT DISTINCT FROM t.source GROUP BY s.source, deal % shards),
shard_seats AS (
  SELECT source, shard, count(*) AS seats FROM (
    SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard) AS place, source_blocks
    FROM (SELECT *, unnest(range(0, source_blocks)) AS k FROM shards WHERE shard_size > 0))
  WHERE place <= source_blocks GROUP BY source, shard),
quotas AS (
  SELECT *, CASE WHEN held > 0 THEN least(seats // held, {_MOST}) ELSE 0 END AS copies,
         CASE WHEN held > 0 THEN {_hex(_START, 1, 15)} % held ELSE 0 END AS first
  FROM (SELECT h.source, h.shard, shard_size, ceil(shard_size / {_BLOCK}.0)::BIGINT AS held, coalesce(seats, 0) AS seats
        FROM shards h LEFT JOIN shard_seats t ON h.source IS NOT DISTINCT FROM t.source AND h.shard = t.shard)),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, copies, first, held,
         CASE WHEN copies < {_MOST} THEN seats - copies * held ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY s.source, deal % shards ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
  JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source AND deal % shards = q.shard)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       (copies * size + greatest(least(upto, (first + rest) * {_BLOCK}) - greatest(upto - size, first * {_BLOCK}), 0)
        + greatest(least(upto, greatest(first + rest - held, 0) * {_BLOCK}) - (upto - size), 0))::BIGINT AS taken
FROM placed"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def jaccard(words: int, percent: int) -> str:
    """Documents in one component for links of at least the given similarity of their word n-grams."""
    gram = " || ' ' || ".join(f"w[i{f' + {k}' if k else ''}]" for k in range(words))
    return f"""WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {gram}))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM split),
sizes AS (SELECT doc_id, coalesce(len(grams), 0) AS n FROM sets),
entries AS (SELECT doc_id, unnest(grams) AS gram FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM entries a JOIN entries b USING (gram)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * held >= {percent} * (x.n + y.n - held)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, any_value(n) AS n_shingles, min(b) AS component_id FROM sizes JOIN reached ON doc_id = a GROUP BY doc_id"""


def nearest(k: int, every: int) -> str:
    """The k nearest by inner product of every row whose id ``every`` divides; the search finds them all here."""
    finite = "len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    return f"""WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def search(k: int) -> str:
    """The k documents that score highest for every item."""
    terms = f"regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM docs WHERE len(t) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM docs WHERE len(t) > 0),
postings AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM held GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, big_n),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest({terms}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, r,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""


def hard_negatives(every: int, positives: int, negatives: int, least: int) -> str:
    """Negatives in the window below each positive of every anchor."""
    finite = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    return f"""WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({_SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND {finite}),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id % {every} = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
first AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {positives})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM first JOIN scored USING (anchor_id)
WHERE NOT same AND {least} * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= {negatives}"""


# CRC-32 byte by byte, with the table of the reflected polynomial.
_CRC_TABLE = ("list_transform(range(256), lambda b: list_reduce(range(8), lambda c, s: "
              "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))")
_BYTES = "list_transform(range(1, 2 * octet_length(encode(text)), 2), lambda i: ('0x' || substr(hex(encode(text)), i, 2))::BIGINT)"


def shards(count: int, group_share: int) -> str:
    """Contiguous shards of near equal bytes in the order of the texts' digests."""
    return f"""WITH tab AS (SELECT {_CRC_TABLE} AS t),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
distinct_texts AS (SELECT DISTINCT text FROM texts),
sums AS (
  SELECT text, xor(list_reduce({_BYTES}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)::BIGINT AS crc
  FROM distinct_texts, tab),
placed AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size, crc, md5(text) AS digest,
         sum(octet_length(encode(text)) + 1) OVER (ORDER BY md5(text), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY md5(text), doc_id NULLS FIRST) - 1 AS place,
         sum(octet_length(encode(text)) + 1) OVER () AS total,
         sum(octet_length(encode(text)) + 1) OVER (PARTITION BY md5(text)) AS group_size
  FROM texts JOIN sums USING (text)),
lined AS (
  SELECT *, upto - size AS start, min(upto - size) OVER (PARTITION BY digest) AS group_start,
         group_size * {count} * {group_share} <= total AS whole FROM placed),
units AS (
  SELECT *, CASE WHEN whole THEN group_start ELSE start END AS a,
         CASE WHEN whole THEN group_start + group_size ELSE upto END AS b FROM lined),
cuts AS (
  SELECT k, CASE WHEN k * total - a * {count} <= b * {count} - k * total THEN a ELSE b END AS edge
  FROM units, range(1, {count}) r(k) WHERE start * {count} <= k * total AND k * total < upto * {count}),
dealt AS (
  SELECT doc_id, size, crc, place, coalesce((SELECT max(k) FROM cuts WHERE edge <= start), 0) AS shard FROM lined)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard FROM dealt"""


ORACLE: dict[str, str] = {
    "op5_mixing": MIXING,
    "op7_ngram_join": jaccard(3, 90),
    "op10_neighbours": nearest(20, 20),
    "op11_lexical_search": search(lexical_search.TOP),
    "op12_hard_negatives": hard_negatives(negatives.EVERY, negatives.POSITIVES, negatives.NEGATIVES, negatives.LEAST_PERCENT),
    "op13_sharding": shards(sharding.SHARDS, sharding.GROUP_SHARE),
}
