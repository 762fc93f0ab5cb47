"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_mix_sources"] = r"""
WITH docs AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sizes),
weighed AS (SELECT *, (rk - 1) % 3 + 1 AS w FROM ranked),
ratio AS (SELECT *, (3 * s)::DOUBLE / w AS r FROM weighed),
levels AS (
  SELECT *,
    (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lv
  FROM ratio),
opened AS (SELECT *, max(CASE WHEN r > lv THEN lv END) OVER () AS open_lv FROM levels),
targets AS (SELECT source, s, CASE WHEN r <= lv THEN (3 * s)::DOUBLE ELSE open_lv * w END AS target FROM opened),
plan AS (SELECT *, CASE WHEN s > 0 THEN least(3, floor(target / s)) ELSE 0 END::BIGINT AS whole FROM targets),
rest AS (SELECT *, target - (whole * s)::DOUBLE AS rest FROM plan),
placed AS (
  SELECT d.*, p.s, p.target, p.whole, p.rest,
    (d.size >> greatest(0, length(bin(d.size)) - 12)) << greatest(0, length(bin(d.size)) - 12) AS class
  FROM docs d JOIN rest p ON d.source IS NOT DISTINCT FROM p.source),
classes AS (
  SELECT source, class, any_value(rest) AS rest, sum(size) AS w, sum(size * class) AS q FROM placed WHERE size > 0 GROUP BY source, class),
tried AS (
  SELECT *, (rest - coalesce(sum(w) OVER down, 0)::DOUBLE) / (sum(q) OVER (PARTITION BY source) - coalesce(sum(q) OVER down, 0))::DOUBLE AS c
  FROM classes WINDOW down AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
factors AS (
  SELECT source, min(CASE WHEN c * class >= 1 THEN class END) AS sure, greatest(max_by(c, class) FILTER (c * class < 1), 0) AS c,
    coalesce(sum(CASE WHEN c * class >= 1 THEN w END), 0) AS sure_words FROM tried GROUP BY source),
chances AS (
  SELECT p.*, f.sure_words, coalesce(p.size > 0 AND p.class >= f.sure, false) AS surely, f.c * p.class AS p, (h + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM placed p LEFT JOIN factors f ON p.source IS NOT DISTINCT FROM f.source),
odds AS (SELECT *, CASE WHEN size > 0 AND NOT surely AND p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM chances),
keyed AS (SELECT *, floor(q / (1 + q) * 1099511627776.0::DOUBLE)::BIGINT AS k FROM odds),
upto AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k NULLS LAST, h) AS place,
    sum(CASE WHEN k IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k NULLS LAST, h ROWS UNBOUNDED PRECEDING) AS cum FROM keyed),
taken AS (SELECT *, k IS NOT NULL AND cum <= rest - sure_words AS fits FROM upto),
edge AS (
  SELECT source, any_value(rest - sure_words) - coalesce(max(CASE WHEN fits THEN cum END), 0)::DOUBLE AS gap FROM taken GROUP BY source),
fills AS (
  SELECT t.source, min((abs(gap - size), k, h, place))[4] AS place
  FROM taken t JOIN edge e ON t.source IS NOT DISTINCT FROM e.source
  WHERE k IS NOT NULL AND NOT fits AND abs(gap - size) < gap GROUP BY t.source)
SELECT t.doc_id, t.size, t.s AS source_size, t.target,
  (t.size * (t.whole + CASE WHEN t.size > 0 AND (t.surely OR t.fits OR coalesce(t.place = f.place, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM taken t LEFT JOIN fills f ON t.source IS NOT DISTINCT FROM f.source
"""

SQL["op7_exact_dedup"] = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
             sha256(coalesce(text, '')) AS text_sha256
      FROM documents)
"""

SQL["op12_line_dedup"] = r"""
WITH cut AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
held AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT c.*, h.k IS NOT NULL AND c.doc_id < h.top AS gone FROM keyed c LEFT JOIN held h ON c.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SQL["op11_phrases"] = r"""
WITH pieces AS (
  SELECT doc_id, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(t) AS piece, unnest(range(len(t))) AS i
        FROM (SELECT doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS t FROM documents))),
grams AS (SELECT lang, unnest(flatten([[array_to_string(w[j : j + m - 1], ' ') FOR j IN range(1, len(w) - m + 2)] FOR m IN range(1, 6)])) AS g FROM pieces),
f AS (SELECT lang, g, count(*)::BIGINT AS f, string_split(g, ' ') AS w FROM grams GROUP BY lang, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(w) = 1 GROUP BY lang),
cand AS (SELECT lang, g, w, f AS a FROM f WHERE len(w) > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM cand),
scored AS (
  SELECT c.lang, c.g, c.w, c.a, c.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[c.k + 1 :], ' ') JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
subs AS (SELECT lang, a, len(w) AS m, unnest(flatten([[array_to_string(w[j : j + x - 1], ' ') FOR j IN range(1, len(w) - x + 2)] FOR x IN range(2, len(w))])) AS g FROM cand WHERE len(w) > 2),
inside AS (SELECT lang, g, max(a) AS most FROM subs GROUP BY lang, g),
left_over AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g WHERE i.g IS NULL OR 100 * i.most < 100 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM left_over)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
