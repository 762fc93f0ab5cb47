"""DuckDB SQL for the rows of the catalog's queries."""

SQL: dict[str, str] = {}

_CANDIDATES = """
cited AS (SELECT l_orderkey, list_sort(list(DISTINCT 'Art. ' || (l_partkey % 40 + 1) || ' OR')) AS citations FROM lineitem GROUP BY l_orderkey),
cand AS (SELECT o_custkey::VARCHAR AS query_id, o_orderkey::VARCHAR AS doc_ref,
                (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS rank0, o_orderkey, o_custkey, (o_orderkey * 7919) % 101 / 10.0::DOUBLE AS score
         FROM orders),
cands AS (SELECT c.query_id, c.doc_ref, c.rank0 AS rank, c.score, x.citations FROM cand c JOIN cited x ON c.o_orderkey = x.l_orderkey),
ordered AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(citations) DESC, rank, doc_ref))::INTEGER AS position FROM cands)"""
_DECIDED = (
    _CANDIDATES
    + """,
supp AS (SELECT query_id, c AS citation, count(*) AS support FROM (SELECT query_id, unnest(citations) AS c FROM cands WHERE rank <= 5) GROUP BY 1, 2),
votes AS (SELECT query_id, c AS citation, count(*) AS votes, min(position) AS best_position, max(score) AS best_score
          FROM (SELECT query_id, position, score, unnest(citations) AS c FROM ordered WHERE position <= 10) GROUP BY 1, 2),
joined AS (SELECT query_id, citation, coalesce(votes, 0) AS votes, best_position, best_score, coalesce(support, 0) AS support FROM votes FULL JOIN supp USING (query_id, citation)),
decided AS (SELECT *, votes >= 4 AS bv, coalesce(best_position <= 3 AND best_score >= 8.5, false) AS ba, support >= 2 AS bs, votes >= 4 OR coalesce(best_position <= 3 AND best_score >= 8.5, false) OR support >= 2 AS accepted FROM joined)"""
)
_PREDICTED = (
    _DECIDED
    + """,
pred AS (SELECT c_custkey::VARCHAR AS query_id, coalesce(p.predicted, []::VARCHAR[]) AS predicted
         FROM customer LEFT JOIN (SELECT query_id, list_sort(list(citation)) AS predicted FROM decided WHERE accepted GROUP BY 1) p ON c_custkey::VARCHAR = p.query_id),
gold AS (SELECT o_custkey::VARCHAR AS query_id, list_sort(list(DISTINCT 'Art. ' || (l_partkey % 40 + 1) || ' OR')) AS gold FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)"""
)
_PRF = (
    _PREDICTED
    + """,
conf AS (SELECT query_id, len(list_intersect(predicted, gold)) AS tp, len(list_filter(predicted, lambda x: NOT list_contains(gold, x))) AS fp, len(list_filter(gold, lambda x: NOT list_contains(predicted, x))) AS fn
         FROM gold LEFT JOIN pred USING (query_id)),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM conf),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""
)
_TRIPLES = (
    _PREDICTED
    + """,
retr AS (SELECT query_id, list(c ORDER BY length(c), c) AS retrieved FROM (SELECT DISTINCT query_id, unnest(citations) AS c FROM cands WHERE rank <= 3) GROUP BY 1),
triples AS (SELECT * FROM gold JOIN retr USING (query_id) JOIN pred USING (query_id)),
ana AS (SELECT *,
  CASE WHEN len(predicted) = 0 THEN CASE WHEN len(gold) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(predicted, gold))::DOUBLE / len(predicted) END AS pp,
  CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(predicted, gold))::DOUBLE / len(gold) END AS pr,
  CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(retrieved, gold))::DOUBLE / len(gold) END AS rr FROM triples)"""
)
_ATTRIBUTION = (
    _TRIPLES
    + """,
att AS (SELECT query_id,
  list_filter(gold, lambda x: list_contains(predicted, x)) AS correct,
  list_filter(gold, lambda x: NOT list_contains(retrieved, x)) AS retrieval_miss,
  list_filter(gold, lambda x: list_contains(retrieved, x) AND NOT list_contains(predicted, x)) AS gate_miss,
  list_filter(predicted, lambda x: list_contains(retrieved, x) AND NOT list_contains(gold, x)) AS selected_false_positive,
  list_filter(predicted, lambda x: NOT list_contains(retrieved, x) AND NOT list_contains(gold, x)) AS unsupported_false_positive,
  list_filter(predicted, lambda x: NOT list_contains(retrieved, x) AND list_contains(gold, x)) AS unsupported_correct,
  rr AS retrieval_recall, pr AS prediction_recall FROM ana)"""
)
_VIEWS = """
slices(field, a, n, w, o) AS (VALUES ('normal_query', 1, 13, 0.40::DOUBLE, 1), ('meta_searchterm', 14, 13, 1.25::DOUBLE, 2), ('keywords', 27, 13, 0.85::DOUBLE, 3), ('fulltext', 40, 13, 1.35::DOUBLE, 4), ('citations', 53, 12, 0.15::DOUBLE, 5)),
ix AS (SELECT vec_id AS idx, field, w, o, list_slice(embedding, a, a + n - 1)::DOUBLE[] AS v FROM embeddings, slices),
scored AS (SELECT q.idx AS query_id, x.field, x.w, x.o, x.idx, list_inner_product(x.v, q.v) AS score FROM ix x JOIN ix q ON x.field = q.field WHERE q.idx % 100 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, idx DESC) AS position FROM scored) WHERE position <= 50),
pivoted AS (SELECT query_id, idx AS doc_ref,
  min(CASE WHEN o = 1 THEN position END) AS p1, min(CASE WHEN o = 2 THEN position END) AS p2, min(CASE WHEN o = 3 THEN position END) AS p3, min(CASE WHEN o = 4 THEN position END) AS p4, min(CASE WHEN o = 5 THEN position END) AS p5,
  min((CASE field WHEN 'citations' THEN 0 WHEN 'fulltext' THEN 1 WHEN 'keywords' THEN 2 WHEN 'meta_searchterm' THEN 3 ELSE 4 END) * 1000000 + position) AS met
  FROM hits GROUP BY 1, 2),
summed AS (SELECT *, 0.0::DOUBLE + coalesce(0.40::DOUBLE / (60 + p1), 0) + coalesce(1.25::DOUBLE / (60 + p2), 0) + coalesce(0.85::DOUBLE / (60 + p3), 0) + coalesce(1.35::DOUBLE / (60 + p4), 0) + coalesce(0.15::DOUBLE / (60 + p5), 0) AS fusion_score FROM pivoted),
fused AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, met))::INTEGER AS rank FROM summed) WHERE rank <= 100)"""

SQL["dense_topk"] = """
SELECT query_id, position, vec_id, score FROM (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
         (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, x.vec_id DESC))::INTEGER AS position
  FROM embeddings x, embeddings q WHERE q.vec_id % 100 = 0) WHERE position <= 10"""
SQL["five_view_rrf"] = f"WITH {_VIEWS} SELECT query_id, doc_ref, rank, fusion_score FROM fused"
SQL["rrf_hit_details"] = f"""WITH {_VIEWS}
SELECT f.query_id, f.doc_ref, f.rank, (row_number() OVER (PARTITION BY f.query_id, f.doc_ref ORDER BY h.o) - 1)::INTEGER AS hit, h.field, h.position::INTEGER AS view_rank
FROM fused f JOIN hits h ON f.query_id = h.query_id AND f.doc_ref = h.idx"""
SQL["online_rrf_two_source"] = """
WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
dense AS (SELECT * FROM (SELECT query_id, vec_id AS doc_ref, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(x.embedding::DOUBLE[], q.v) DESC, vec_id DESC) AS position FROM embeddings x, q) WHERE position <= 40),
bm25 AS (SELECT * FROM (SELECT query_id, vec_id AS doc_ref, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS position FROM embeddings x JOIN q ON x.label = q.label) WHERE position <= 40),
both_ AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.doc_ref, b.doc_ref) AS doc_ref, d.position AS pd, b.position AS pb FROM dense d FULL JOIN bm25 b ON d.query_id = b.query_id AND d.doc_ref = b.doc_ref),
s AS (SELECT *, 0.0::DOUBLE + coalesce(0.7::DOUBLE / (60 + pd), 0) + coalesce(0.3::DOUBLE / (60 + pb), 0) AS fusion_score FROM both_),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, CASE WHEN pb IS NOT NULL THEN pb ELSE 1000000 + pd END))::INTEGER AS rank FROM s)
SELECT query_id, doc_ref, rank, fusion_score, concat_ws(',', CASE WHEN pb IS NOT NULL THEN 'bm25' END, CASE WHEN pd IS NOT NULL THEN 'dense' END) AS sources FROM r WHERE rank <= 1000"""
SQL["balanced_support"] = """
WITH h AS (SELECT l_orderkey AS query_id, CASE WHEN l_returnflag = 'R' THEN 'law' ELSE 'court' END AS kind, 'Art. ' || (l_partkey % 40 + 1) || ' OR' AS citation, l_linenumber, l_partkey, l_suppkey FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM h),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'law' THEN i ELSE i // 2 END, CASE WHEN kind = 'law' THEN 0 ELSE 1 + i % 2 END) AS hit_pos FROM p)
SELECT query_id, citation, count(DISTINCT hit_pos) AS support FROM t WHERE hit_pos <= 5 GROUP BY 1, 2"""
SQL["balanced_order"] = """
WITH p AS (SELECT conv_id AS query_id, CASE WHEN role = 'user' THEN 'law' ELSE 'court' END AS kind, turn, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) - 1 AS i FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'law' THEN i ELSE i // 2 END, CASE WHEN kind = 'law' THEN 0 ELSE 1 + i % 2 END))::INTEGER AS hit_pos FROM p)
SELECT query_id, kind, turn, hit_pos FROM t WHERE hit_pos <= 10"""
SQL["citation_gate"] = f"""WITH {_DECIDED}
SELECT query_id, citation, 'law' AS kind, accepted, votes, support,
  CASE WHEN accepted THEN concat_ws(' + ', CASE WHEN bv THEN 'dense vote ' || votes || '/10' END, CASE WHEN ba THEN 'top-' || best_position || ' score ' || format('{{:.1f}}', best_score) END, CASE WHEN bs THEN 'BM25 support ' || support || '/5' END)
       ELSE 'dense vote ' || votes || '/10; BM25 support ' || support || '/5' END AS votes_text FROM decided"""
SQL["gate_rejections"] = f"WITH {_DECIDED} SELECT query_id, citation, votes, support FROM decided WHERE NOT accepted"
SQL["verifier_order"] = f"WITH {_CANDIDATES} SELECT query_id, doc_ref, position FROM ordered"
SQL["online_order"] = f"""WITH {_CANDIDATES},
o1 AS (SELECT query_id, doc_ref, score, citations, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_ref))::INTEGER AS rank FROM cands)
SELECT query_id, doc_ref, rank, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(citations) DESC, rank, doc_ref))::INTEGER AS position FROM o1"""
SQL["evidence_documents"] = f"""WITH {_DECIDED},
acc AS (SELECT query_id, list(citation) AS a FROM decided WHERE accepted GROUP BY 1),
m AS (SELECT o.*, coalesce(len(list_intersect(citations, a)) > 0, false) AS good FROM ordered o LEFT JOIN acc USING (query_id)),
f AS (SELECT *, bool_or(good) OVER (PARTITION BY query_id) AS anyg FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS r FROM f WHERE good OR NOT anyg)
SELECT query_id, doc_ref, position FROM n WHERE r <= 3"""
SQL["submission_rows"] = f"WITH {_PREDICTED} SELECT query_id, array_to_string(predicted, ';') AS predicted_citations FROM pred"
SQL["per_query_prf"] = f"WITH {_PRF} SELECT query_id, tp, fp, fn, precision, recall, f1 FROM prf"
SQL["macro_f1"] = f"WITH {_PRF} SELECT count(*) AS queries, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM prf"
SQL["analysis_prf"] = f"WITH {_TRIPLES} SELECT query_id, pp AS precision, pr AS recall FROM ana"
_NAMES = ("correct", "retrieval_miss", "gate_miss", "selected_false_positive", "unsupported_false_positive", "unsupported_correct")
SQL["error_attribution"] = f"WITH {_ATTRIBUTION} SELECT query_id, {', '.join(f"array_to_string({n}, ';') AS {n}" for n in _NAMES)}, retrieval_recall, prediction_recall FROM att"
SQL["macro_attribution"] = f"WITH {_ATTRIBUTION} SELECT {', '.join(f'sum(len({n}))::BIGINT AS {n}' for n in _NAMES)}, round(avg(retrieval_recall), 9) AS retrieval_recall, round(avg(prediction_recall), 9) AS prediction_recall FROM att"
SQL["context_metrics"] = f"""WITH {_TRIPLES},
c AS (SELECT *, list_slice(retrieved, 1, 10) AS ctx FROM ana),
m AS (SELECT query_id, CASE WHEN len(ctx) = 0 THEN CASE WHEN len(gold) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(gold, ctx))::DOUBLE / len(ctx) END AS context_precision,
  CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(gold, ctx))::DOUBLE / len(gold) END AS context_recall,
  CASE WHEN len(predicted) = 0 THEN 1.0 ELSE len(list_intersect(ctx, predicted))::DOUBLE / len(predicted) END AS faithfulness, pp AS answer_precision, pr AS answer_recall FROM c)
SELECT *, CASE WHEN answer_precision + answer_recall > 0 THEN 2 * answer_precision * answer_recall / (answer_precision + answer_recall) ELSE 0.0 END AS answer_f1 FROM m"""
SQL["label_vs_prediction_f1"] = r"""
WITH d AS (SELECT lang, quality = 1 AS g, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 1000 AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM d GROUP BY lang),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr"""
_NAMED = """named AS (SELECT coalesce(p_name, 'unknown ' || (l_partkey * 2)) AS citation FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2),
vocab AS (SELECT DISTINCT p_name AS citation, CASE WHEN p_size % 2 = 0 THEN 'law' ELSE 'court' END AS kind FROM part)"""
SQL["vocab_semi"] = f"WITH {_NAMED} SELECT citation, count(*) AS n FROM named WHERE citation IN (SELECT citation FROM vocab) GROUP BY 1"
SQL["vocab_anti"] = f"WITH {_NAMED} SELECT citation, count(*) AS n FROM named WHERE citation NOT IN (SELECT citation FROM vocab) GROUP BY 1"
SQL["targeted_vocabulary"] = f"WITH {_NAMED} SELECT citation, max(kind) AS kind FROM vocab WHERE citation IN (SELECT citation FROM named) GROUP BY 1"
SQL["vocabulary_overlap"] = f"WITH {_NAMED} SELECT 'one kind' AS rule, citation AS key, 'law and court' AS message FROM vocab GROUP BY citation HAVING count(DISTINCT kind) > 1"
SQL["materialize_rows"] = "SELECT 'documents.parquet:rg0:row' || d.doc_id AS doc_ref, d.doc_id, lang, length(text)::INTEGER AS chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1"
SQL["render_document"] = "SELECT doc_id, sha256('[doc_id] ' || doc_id || ' [lang] ' || lang || ' [source] ' || source || ' [n_chars] ' || n_chars || ' [text] ' || text) AS rendered_sha256 FROM documents"
SQL["fulltext_view"] = r"SELECT doc_id, sha256('lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || 'text: ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fulltext_sha256 FROM documents"
SQL["prepare_batches"] = """
WITH r AS (SELECT o_custkey::VARCHAR AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders)
SELECT query_id, query_id || '::gi' || o_orderkey AS candidate_id, rk::INTEGER AS rank, ((rk - 1) // 5)::INTEGER AS batch, ((rk - 1) % 5)::INTEGER AS slot, 'text of d' || (o_orderkey % 50) AS document_text FROM r WHERE rk <= 10"""
SQL["candidate_ids"] = """
SELECT o_orderkey, 'q' || o_custkey || '::' || CASE o_orderkey % 3 WHEN 0 THEN 'own' || o_orderkey WHEN 1 THEN 'gi' || o_orderkey ELSE o_orderstatus END AS candidate_id,
       'q' || o_custkey || '::rank1::gi' || o_orderkey AS legacy_id FROM orders"""
SQL["document_references"] = """
SELECT doc_id, source || '.parquet:rg' || (doc_id % 7) || ':row' || doc_id AS index_reference,
       CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE source || '.parquet:rg' || (doc_id % 7) || ':row' || doc_id END AS document_reference, doc_id % 7 AS row_group FROM documents"""
SQL["clean_text"] = r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_sha256, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::INTEGER AS chars FROM documents"
SQL["split_citations"] = r"""
WITH w AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ';') || ' ; ' || p_brand || ' ; ' || p_brand, ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS citations FROM w"""
_STOP = "'that','with','from','into','under','when','while','have','been','were','this','does','should','could','would','their','there','where','after','before','alleged','alleges','claimant','defendant','plaintiff','court','legal','risk','claim','claims','order','decision','dated','later','whether','meaning','considering','because','between','against','upon','within','which','those','these'"
_KEYWORDS = rf"""
tok AS (SELECT doc_id, lower(t) AS keyword FROM (SELECT doc_id, unnest(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[A-Za-zÄÖÜäöüÉéÈèÀàÇç]{{4,}}|\d[A-Z]?_[0-9]+/[0-9]{{4}}')) AS t FROM documents)),
cnt AS (SELECT doc_id, keyword, count(*) AS n FROM tok WHERE keyword NOT IN ({_STOP}) AND length(keyword) >= 4 GROUP BY 1, 2),
rk AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword))::INTEGER AS place FROM cnt)"""
SQL["keyword_ranking"] = f"WITH {_KEYWORDS} SELECT doc_id, keyword, n, place FROM rk WHERE place <= 70"
SQL["keyword_view"] = f"""WITH {_KEYWORDS}
SELECT d.doc_id, substr(coalesce(k.s, ''), 1, 1600) AS keywords FROM documents d LEFT JOIN (SELECT doc_id, string_agg(keyword, ' ' ORDER BY place) AS s FROM rk WHERE place <= 70 GROUP BY 1) k USING (doc_id)"""
_FRAGMENT = r"\b(?:Art\.\s*[^,;.()]{1,80}|BGE\s+\d+\s+[IVX]+\s+\d+(?:\s+E\.\s*[\d.a-z]+)?|(?:\d[A-Z]?|[A-Z])_[0-9]+/[0-9]{4}(?:\s+E\.\s*[\d.a-z]+)?)"
_TURNS = "turns AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' Art. 12 Abs. 1 OR; see BGE 145 III 1 E. 2. Die Berufung und der Mietrecht Streit?  Ja.' ELSE '' END AS text FROM conversations)"
_LEGAL = "'vorsorgliche Massnahmen','superprovisorische Massnahmen','Beweissicherung','Zuständigkeit','internationale Zuständigkeit','Urheberrecht','UWG','unlauterer Wettbewerb','Geschäftsgeheimnis','Software','Quellcode','Mietrecht','Leasing','Verjährung','Schuldanerkennung','Kontokorrent','Scheidung','Kindesschutz','Unterhalt','Arbeitsfähigkeit','Invalidenversicherung','Unfall','Haftpflicht','SVG','StPO','Untersuchungshaft','Kollusionsgefahr','Verhältnismässigkeit','Beschwerde','Rechtsöffnung','SchKG','Erwägung','Berufung','Revision','Ausstand','Kündigung','Arbeitsvertrag','einfache Gesellschaft','Liquidation','Erbrecht','Nachlass','Markenschutz','Datenschutz'"
SQL["legal_words"] = f"WITH {_TURNS} SELECT conv_id, turn, array_to_string(list_filter([{_LEGAL}], lambda w: contains(lower(text), lower(w))), ', ') AS legal_words FROM turns"
SQL["citation_view"] = rf"""WITH {_TURNS},
f AS (SELECT *, regexp_extract_all(text, '{_FRAGMENT}') AS l FROM turns),
g AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '), '\s+', ' ', 'g')) AS c FROM f)
SELECT conv_id, turn, CASE WHEN c = '' THEN text ELSE c END AS citations FROM g"""
SQL["meta_view"] = rf"""WITH {_TURNS},
c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM turns),
f AS (SELECT *, regexp_extract_all(t, '{_FRAGMENT}') AS l, string_split(regexp_replace(t, '([?;.])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM c)
SELECT conv_id, turn, substr(concat_ws('; ', nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; '), ''),
  nullif(array_to_string(list_filter([{_LEGAL}], lambda w: contains(lower(t), lower(w))), ', '), ''),
  nullif(substr(array_to_string(parts[1:2], ' '), 1, 700), ''),
  nullif(substr(CASE WHEN len(parts) > 3 THEN array_to_string(parts[-3:], ' ') ELSE t END, 1, 900), '')), 1, 2200) AS meta_searchterm FROM f"""
SQL["truncated_text"] = "SELECT doc_id, sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || ' …[truncated]' ELSE text END) AS truncated_sha256 FROM documents"
SQL["extract_citations"] = "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT 'Art. ' || (l_partkey % 40 + 1) || ' Abs. ' || (l_suppkey % 3 + 1) || ' OR')), ';') AS citations FROM lineitem GROUP BY 1"
SQL["answer_validation"] = """
SELECT l_orderkey AS answer_id, CASE WHEN bool_or(l_partkey % 40 + 1 = 7 AND l_suppkey % 3 = 2) THEN 'outside vocabulary' WHEN bool_or(l_suppkey % 3 = 2) THEN 'not accepted' END AS problem,
       count(DISTINCT (l_partkey % 40) * 3 + l_suppkey % 3)::INTEGER AS mentioned FROM lineitem GROUP BY 1"""
SQL["exact_dup_docs"] = "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1"
SQL["tree_digest"] = """
SELECT source, sha256(string_agg(lang || '/' || (doc_id % 7) || '-' || doc_id || chr(0) || sha256(text), '' ORDER BY lang, (doc_id % 7) || '-' || doc_id)) AS sha256, count(*) AS files, sum(length(text))::BIGINT AS bytes FROM documents GROUP BY 1"""
SQL["verify_artifacts"] = """
SELECT doc_id AS id, 'd' || CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS path,
  CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size differs' WHEN 2 THEN 'digest differs' WHEN 3 THEN 'file count differs' END AS reason FROM documents"""
SQL["credential_scan"] = r"""
SELECT doc_id, regexp_matches(text, '-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----')
  OR len(list_filter(regexp_extract_all(text, '(?i)(?:access[_-]?key|api[_-]?key|auth[_-]?token|password|private[_-]?key|secret(?:[_-]?access[_-]?key)?|token)\s*[:=]\s*[''"]([A-Za-z0-9_./+=:@-]{20,})[''"]', 1), lambda v: NOT regexp_matches(lower(v), 'changeme|example|fixture|placeholder|replace|your-'))) > 0
  OR len(list_filter(regexp_extract_all(text, '(?m)^\s*(?:export\s+)?(?:[A-Z0-9_]*(?:ACCESS_KEY|API_KEY|AUTH_TOKEN|PASSWORD|PRIVATE_KEY|SECRET_ACCESS_KEY|TOKEN))\s*=\s*([A-Za-z0-9_./+=:@-]{20,})\s*(?:#.*)?$', 1), lambda v: NOT regexp_matches(lower(v), 'changeme|example|fixture|placeholder|replace|your-'))) > 0 AS problem FROM documents"""
SQL["html_escape"] = "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM pages"
SQL["chat_validation"] = """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END AS content FROM conversations),
v AS (SELECT conv_id, turn, unnest([CASE WHEN NOT coalesce(role IN ('user', 'assistant', 'system'), false) THEN 'role' END, CASE WHEN coalesce(trim(content), '') = '' THEN 'content' END]) AS rule FROM c)
SELECT rule, conv_id || '::' || turn AS key, 'broken: ' || rule AS message FROM v WHERE rule IS NOT NULL"""
SQL["duplicate_keys"] = "SELECT 'unique' AS rule, l_orderkey || '::' || l_linenumber AS key, count(*) || ' rows' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
SQL["contiguous_turns"] = """
WITH r AS (SELECT conv_id, turn + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS rank FROM conversations)
SELECT 'contiguous ranks' AS rule, conv_id::VARCHAR AS key, 'ranks are not 1..n' AS message FROM r GROUP BY conv_id HAVING NOT (min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*))"""
SQL["incomplete_join"] = """
WITH b AS (SELECT doc_id + 1 AS doc_id FROM labels)
SELECT 'right side is missing' AS rule, doc_id::VARCHAR AS key, 'no partner' AS message FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM b)
UNION ALL SELECT 'left side is missing', doc_id::VARCHAR, 'no partner' FROM (SELECT DISTINCT doc_id FROM b) WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
SQL["resumable_work"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
SQL["strict_json_props"] = "SELECT event_id, coalesce(json_valid(props) AND json_type(props::JSON) = 'OBJECT', false) AS is_object, array_to_string(list_sort(json_keys(props::JSON)), ',') AS keys FROM events"
SQL["think_split"] = r"""
WITH s AS (SELECT conv_id, turn, turn % 5 AS k, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN k IN (0, 1) THEN length(t)::INTEGER END AS answer_chars, CASE WHEN k = 1 THEN 'plan' END AS reasoning,
       CASE k WHEN 2 THEN 'truncated' WHEN 3 THEN 'malformed' WHEN 4 THEN 'nested' END AS problem FROM s"""
SQL["completion_envelopes"] = """
SELECT conv_id, turn, 'asked' AS model, CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) END::BIGINT AS total_tokens,
       CASE turn % 4 WHEN 3 THEN 'invalid envelope' WHEN 2 THEN 'truncated' WHEN 1 THEN 'no content' END AS problem FROM conversations"""
SQL["perturbation_aopc"] = """
WITH e AS (SELECT user_id::VARCHAR AS query_id, floor(value * 4) / 4.0::DOUBLE AS effect, event_type = 'purchase' AS ev FROM events)
SELECT query_id, (count(*) FILTER (ev))::INTEGER AS evidence, (count(*) FILTER (NOT ev))::INTEGER AS controls, round(avg(effect) FILTER (ev), 6) AS targeted_aopc FROM e GROUP BY 1
HAVING count(*) FILTER (ev) > 0 AND count(*) FILTER (NOT ev) >= count(*) FILTER (ev)"""
SQL["run_event_fold"] = """
WITH e AS (SELECT user_id::VARCHAR AS run_key, event_id, event_type AS t, event_id % 6 + 1 AS step FROM events),
s AS (SELECT run_key, count(*) AS events, arg_max(t, event_id) FILTER (t IN ('purchase', 'error')) AS fin FROM e GROUP BY 1),
last AS (SELECT run_key, step, arg_max(t, event_id) AS t FROM e WHERE t IN ('view', 'click', 'error') GROUP BY 1, 2),
done AS (SELECT run_key, count(*) AS n FROM last WHERE t = 'click' GROUP BY 1)
SELECT s.run_key, CASE fin WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END AS status, s.events, coalesce(n, 0)::INTEGER AS completed_steps FROM s LEFT JOIN done USING (run_key)"""
SQL["run_event_plan"] = """
WITH r AS (SELECT c_custkey::VARCHAR AS run_id, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 END AS f FROM customer),
steps AS (SELECT run_id, 2 * s - k AS seq, CASE WHEN k = 1 THEN 'step_start' ELSE 'step_complete' END AS type, s AS step FROM r, range(1, 7) a(s), range(0, 2) b(k) WHERE f IS NULL OR s < f OR (s = f AND k = 1))
SELECT run_id, seq, type, step::INTEGER AS step FROM steps
UNION ALL SELECT run_id, 0, 'run_start', NULL FROM r UNION ALL SELECT run_id, 15, 'stream_end', NULL FROM r
UNION ALL SELECT run_id, 13, CASE WHEN f IS NULL THEN 'final_answer' ELSE 'error' END, f FROM r UNION ALL SELECT run_id, 14, 'run_complete', NULL FROM r WHERE f IS NULL"""
SQL["sse_round_trip"] = """
SELECT user_id::VARCHAR AS run_key, CASE event_type WHEN 'signup' THEN 'run_start' WHEN 'view' THEN 'step_start' WHEN 'click' THEN 'step_complete' WHEN 'purchase' THEN 'run_complete' ELSE 'error' END AS type,
       count(*) AS n, sum(event_id % 6 + 1)::BIGINT AS steps, 0::BIGINT AS problems FROM events GROUP BY 1, 2"""
SQL["request_limits"] = """
WITH t AS (SELECT conv_id, arg_min(text, turn) AS query, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN coalesce(trim(query), '') = '' THEN 'query is empty' WHEN length(query) > 400 THEN 'query is too long' WHEN conv_id % 5 = 0 THEN 'model is not allowed' WHEN n > 4 THEN 'history has too many turns' WHEN chars > 1500 THEN 'history is too long' END AS rejection FROM t"""
SQL["feature_standardise"] = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END, 4) AS scale FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
SQL["vector_checks"] = "SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'shape' WHEN 1 THEN 'not normalised' END AS problem FROM embeddings"
SQL["query_seeds"] = """
WITH h AS (SELECT c_custkey, substr(sha256('17' || chr(0) || c_name), 1, 16) AS x FROM customer)
SELECT c_custkey, (('0x' || substr(x, 1, 8))::UBIGINT::HUGEINT * 4294967296 + ('0x' || substr(x, 9, 8))::UBIGINT)::VARCHAR AS seed FROM h"""
SQL["public_hits"] = "SELECT doc_id, sha256(substr(text, 1, 700)) AS snippet_sha256, length(substr(text, 1, 700))::INTEGER AS chars FROM documents"
SQL["resolve_queries"] = r"""
WITH c AS (SELECT conv_id || '-' || turn AS id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
u AS (SELECT t, count(*) AS n, min(id) AS id FROM c GROUP BY 1)
SELECT c.id AS request_id, CASE WHEN turn % 2 = 0 THEN c.id ELSE u.id END AS query_id FROM c JOIN u USING (t) WHERE turn % 2 = 0 OR u.n = 1"""
SQL["nonempty_views"] = "SELECT doc_id, doc_id % 2 = 1 AND trim(lang) <> '' AS a, trim(source) <> '' AS b FROM documents"
SQL["hit_texts"] = "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || p_brand END || chr(10) || p_type AS text FROM part"
