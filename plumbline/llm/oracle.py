"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from plumbline.llm import mixing

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = r"""
WITH marked AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS sha
  FROM documents
), ranked AS (
  SELECT doc_id, sha, count(*) OVER (PARTITION BY sha) AS group_size,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id
  FROM marked
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM ranked
"""

_LIST = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
ORACLE["op6_mix_sources"] = rf"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, {mixing.MOST} * source_size AS cap,
         ({_LIST})[(nth % {len(mixing.WEIGHTS)} + 1)::INT] AS weight
  FROM sources
), levels AS (
  SELECT *,
    ({mixing.SHARE} * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), water AS (
  SELECT arg_min(level, struct_pack(a := cap / weight, b := nth)) FILTER (cap >= level * weight) AS level
  FROM levels
), plan AS (
  SELECT source, source_size,
         CASE WHEN cap < water.level * weight THEN cap::DOUBLE ELSE water.level * weight END AS target
  FROM weighed, water
), placed AS (
  SELECT s.*, p.source_size, p.target,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS place,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS expected,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(s.source, chr(0))), 1, 12))::BIGINT / 281474976710656.0 AS shift
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       ((floor((place + 1) * expected + shift) - floor(place * expected + shift)) * size)::BIGINT AS taken
FROM placed
"""

_UPPER, _LOWER = (repr("".join(chr(c + at) for c in range(26))) for at in (65, 97))
ORACLE["op11_collocations"] = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS text FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (
  SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, s AS size, array_to_string(w[i : i + s - 1], ' ') AS phrase
  FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i
        FROM worded, (VALUES (1), (2), (3)) AS sizes(s) WHERE len(w) >= s)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), phrases AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1
), cuts AS (
  SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS first_part,
         array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM phrases)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first_part
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a
  FROM phrases WHERE size = 3
), covered AS (
  SELECT DISTINCT i.lang, i.phrase FROM inside i JOIN phrases p ON p.lang = i.lang AND p.phrase = i.phrase
  WHERE 100 * i.a::HUGEINT >= 50 * p.a::HUGEINT
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
