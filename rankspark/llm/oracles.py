"""SQL with the meaning of the queries, for DuckDB, where SQL can say it on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"""string_split_regex({}, '[ \t\n\x0b\f\r.:;"''?!,~`()/#*%+\-\[\]{{}}@^]+')"""
_RECORDS = "records AS (SELECT docid, arg_max(title, loaded_at) AS title, arg_max(content, loaded_at) AS content FROM docstore WHERE docid IS NOT NULL GROUP BY docid)"

_TERMS = f"""
WITH {_RECORDS}, words AS (
  SELECT docid, unnest({_SPLIT.format(_LOWER.format("coalesce(title, '') || chr(10) || coalesce(content, '')"))}) AS term FROM records
), counts AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT docid) AS records FROM words WHERE term <> '' GROUP BY term
), marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM records) THEN 'common' END AS mark FROM counts
)
"""
ORACLES["p1_found"] = _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL"
ORACLES["p1_terms"] = _TERMS + "SELECT term, occurrences, records, mark FROM marked"

ORACLES["p2_found"] = f"""
WITH {_RECORDS}, words AS (
  SELECT docid, unnest({_SPLIT.format(_LOWER.format("coalesce(content, '')"))}) AS term FROM records
), tf AS (
  SELECT docid, term, count(*) AS n FROM words WHERE term <> '' GROUP BY docid, term
)
SELECT docid, term FROM tf WHERE n >= 4 AND term IN (SELECT term FROM tf GROUP BY term HAVING count(*) BETWEEN 2 AND 6)
"""

_BEST = """
WITH best AS (
  SELECT run_id, query_number, docno, max(score) + 0.0 AS score FROM runs
  WHERE score IS NOT NULL AND NOT isnan(score) AND docno IS NOT NULL GROUP BY run_id, query_number, docno
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, query_number ORDER BY score DESC, docno DESC) AS pos FROM best
)
"""
ORACLES["p4_found"] = _BEST + "SELECT run_id, query_number, docno FROM placed WHERE pos <= 10"
ORACLES["p4_ranked"] = _BEST + "SELECT run_id, query_number, docno, score, pos FROM placed WHERE pos <= 10"

ORACLES["p5_found"] = """
WITH named AS (
  SELECT qid, count(DISTINCT e) AS n FROM (SELECT qid, unnest(map_keys(ranks)) AS e FROM engine_ranks) GROUP BY qid
), docs AS (
  SELECT DISTINCT qid, doc_id FROM engine_ranks WHERE qid IS NOT NULL AND doc_id IS NOT NULL
), long AS (
  SELECT qid, doc_id, e, min(r) AS r FROM (
    SELECT qid, doc_id, unnest(map_keys(ranks)) AS e, unnest(map_values(ranks)) AS r FROM engine_ranks
  ) WHERE r >= 1 GROUP BY qid, doc_id, e
), votes AS (
  SELECT a.qid, a.doc_id, o.doc_id AS other, count(*) AS n
  FROM long a JOIN docs o ON a.qid = o.qid AND a.doc_id <> o.doc_id
  LEFT JOIN long b ON b.qid = o.qid AND b.doc_id = o.doc_id AND b.e = a.e
  WHERE b.r IS NULL OR a.r < b.r GROUP BY a.qid, a.doc_id, o.doc_id
), ahead AS (
  SELECT v.qid, v.doc_id, count(*) AS beaten FROM votes v JOIN named USING (qid) WHERE v.n * 2 > named.n GROUP BY v.qid, v.doc_id
)
SELECT qid, doc_id FROM ahead JOIN (SELECT qid, count(*) AS n_docs FROM docs GROUP BY qid) USING (qid) WHERE n_docs > 1 AND beaten = n_docs - 1
"""

# More words than a container holds tokens, or fewer bytes: any tokenizer decides alike on these tables.
ORACLES["p8_found"] = r"""
SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) > 2048
"""

ORACLES["p6_found"] = r"""
WITH stand AS (SELECT lower(trim(stand_in)) AS s FROM stand_ins WHERE stand_in IS NOT NULL), rows AS (
  SELECT lower(regexp_replace(cord_uid, '^\s+|\s+$', '', 'g')) AS key, lower(regexp_replace(source_x, '^\s+|\s+$', '', 'g')) AS src, * FROM metadata WHERE cord_uid IS NOT NULL
), entries AS (
  SELECT DISTINCT row_id FROM (SELECT row_id, lower(regexp_replace(unnest(string_split_regex(pmc_json_files, '[;,|\x00-\x1f]')), '^[\s\[({<"'']+|[\s\])}>"'']+$', '', 'g')) AS e FROM metadata)
  WHERE e <> '' AND e NOT IN (SELECT s FROM stand)
), claims AS (
  SELECT key, src, updated_at, row_id, 'title' AS field_name, title AS v FROM rows UNION ALL SELECT key, src, updated_at, row_id, 'abstract', abstract FROM rows
  UNION ALL SELECT key, src, updated_at, row_id, 'pmc_json_files', pmc_json_files FROM rows WHERE row_id IN (SELECT row_id FROM entries)
), valued AS (
  SELECT c.*, t.trust FROM claims c LEFT JOIN (SELECT lower(trim(source_x)) AS src, max(trust) AS trust FROM source_trust GROUP BY 1) t ON t.src = c.src
  WHERE v IS NOT NULL AND regexp_replace(v, '\s+', '', 'g') <> '' AND (field_name = 'pmc_json_files' OR lower(regexp_replace(v, '^\s+|\s+$', '', 'g')) NOT IN (SELECT s FROM stand))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key, field_name ORDER BY trust DESC NULLS LAST, updated_at DESC NULLS LAST, row_id) AS k FROM valued
)
SELECT key AS cord_uid, field_name, row_id FROM placed WHERE k = 1 AND key <> '' AND key IN (SELECT key FROM rows GROUP BY key HAVING count(*) > 1)
"""

# Words stand for tokens: which sources fall short does not depend on the tokenizer.
ORACLES["p9_found"] = r"""
WITH d AS (SELECT regexp_replace(lower(source), '[\s_-]+', '', 'g') AS key, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM documents),
have AS (SELECT key, sum(n) AS n FROM d GROUP BY key), t AS (SELECT *, regexp_replace(lower(source), '[\s_-]+', '', 'g') AS key FROM mix_targets)
SELECT t.source FROM t LEFT JOIN have USING (key)
WHERE coalesce(max_repeats, 0) * coalesce(n, 0) < weight / (SELECT sum(weight) FROM mix_targets) * (SELECT sum(n) FROM d)
"""

_PLACED = ORACLES["p6_found"][: ORACLES["p6_found"].index("SELECT key AS cord_uid")]
ORACLES["p6_survivors"] = (
    _PLACED
    + """
SELECT key AS cord_uid, any_value(n) AS n_rows, max(CASE WHEN field_name = 'abstract' THEN v END) AS abstract, max(CASE WHEN field_name = 'pmc_json_files' THEN v END) AS pmc_json_files, max(CASE WHEN field_name = 'title' THEN v END) AS title
FROM placed JOIN (SELECT key, count(*) AS n FROM rows GROUP BY key) USING (key) WHERE k = 1 AND key <> '' GROUP BY key
"""
)

# All windows of 160 characters, and those that stand in several documents.
_WINDOWS = """
WITH windows AS (
  SELECT doc_id, i, substr(text, CAST(i AS INTEGER) + 1, 160) AS w FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 159, 0))) AS i FROM documents WHERE doc_id IS NOT NULL)
), several AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)), held AS (SELECT doc_id, i, w FROM windows WHERE w IN (SELECT w FROM several))
"""
ORACLES["p10_found"] = _WINDOWS + ", d AS (SELECT DISTINCT doc_id, w FROM held) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.w = b.w AND a.doc_id < b.doc_id"
_SPANS = """
, marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 160 THEN 0 ELSE 1 END AS new FROM held),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 160 AS span_end FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k)
"""
ORACLES["p10_spans"] = _WINDOWS + _SPANS + "SELECT doc_id, span_start, span_end FROM spans"
ORACLES["p10_coverage"] = (
    _WINDOWS
    + _SPANS
    + """
SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(n, 0) / length(text) ELSE 0.0 END AS shared_part
FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM spans GROUP BY doc_id) USING (doc_id)
"""
)

# Ranks clipped at 5 % of each engine in each query, distances of the vectors of length 1 to the best and the worst point.
ORACLES["p5_ranking"] = """
WITH docs AS (SELECT DISTINCT qid, doc_id FROM engine_ranks WHERE qid IS NOT NULL AND doc_id IS NOT NULL),
long AS (
  SELECT qid, doc_id, e, min(r) AS r FROM (SELECT qid, doc_id, unnest(map_keys(ranks)) AS e, unnest(map_values(ranks)) AS r FROM engine_ranks WHERE qid IS NOT NULL AND doc_id IS NOT NULL) WHERE r >= 1 GROUP BY qid, doc_id, e
),
cuts AS (SELECT qid, e, quantile_disc(r, 0.05) AS lo, quantile_disc(r, 0.95) AS hi, count(*) AS n FROM long GROUP BY qid, e),
cells AS (
  SELECT d.qid, d.doc_id, c.e, c.lo, CASE WHEN l.r IS NULL THEN c.hi + 1 ELSE greatest(least(l.r, c.hi), c.lo) END AS v, max(CASE WHEN l.r IS NULL THEN c.hi + 1 ELSE c.hi END) OVER (PARTITION BY d.qid, c.e) AS worst
  FROM docs d JOIN cuts c ON c.qid = d.qid LEFT JOIN long l ON l.qid = d.qid AND l.doc_id = d.doc_id AND l.e = c.e
),
scaled AS (SELECT qid, doc_id, (v - lo) / norm AS up, (v - worst) / norm AS down FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY qid, e)) AS norm FROM cells)),
near AS (SELECT qid, doc_id, sqrt(sum(up * up)) AS p, sqrt(sum(down * down)) AS m FROM scaled GROUP BY qid, doc_id),
c AS (SELECT d.qid, d.doc_id, round(CASE WHEN p + m > 0 THEN m / (p + m) ELSE 0.5 END, 9) AS closeness FROM docs d LEFT JOIN near ON near.qid = d.qid AND near.doc_id = d.doc_id)
SELECT qid, doc_id, closeness, row_number() OVER (PARTITION BY qid ORDER BY closeness DESC, doc_id) AS position FROM c
"""
