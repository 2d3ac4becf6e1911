"""SQL with the meaning of the core queries, for DuckDB."""

from __future__ import annotations

from rankspark.functions.text import PUNCTUATION, STOP_WORDS
from rankspark.plans.queries import BPE_MERGES, GAINS, GIVEN_MERGES

ORACLES: dict[str, str] = {}

_TOKENS = r"""string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \n.:;"''?!,~`()/#*%+\-\[\]{{}}@^]+')"""
_INDEX = f"""
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents) WHERE term <> '' GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df, log2(1 + any_value(n.n) * 1.0 / count(*)) AS idf FROM tf, n GROUP BY term),
norms AS (SELECT doc_id, sqrt(sum(idf * tf * idf * tf)) AS norm FROM tf JOIN df USING (term) GROUP BY doc_id)
"""
ORACLES["tokens_tf"] = f"WITH {_INDEX} SELECT doc_id, term, tf FROM tf"
ORACLES["doc_len"] = f"WITH {_INDEX} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS length FROM tf GROUP BY doc_id"
ORACLES["df_idf"] = f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM df"
ORACLES["doc_norms"] = f"WITH {_INDEX} SELECT doc_id, round(norm, 5) AS norm FROM norms"
ORACLES["postings_gaps"] = f"""
WITH {_INDEX}, idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT DISTINCT doc_id FROM documents)),
g AS (SELECT term, i - coalesce(lag(i) OVER (PARTITION BY term ORDER BY i), 0) AS gap FROM tf JOIN idx USING (doc_id))
SELECT term, count(*) AS df, CAST(sum(CASE WHEN gap = 0 THEN 1 ELSE 1 + floor(log2(gap) / 7) END) AS BIGINT) AS gap_bytes FROM g GROUP BY term
"""
_QUERY = f"""
title AS (SELECT query_number AS qid, unnest({_TOKENS.format("title")}) AS term FROM topics),
desc_list AS (SELECT query_number AS qid, list_filter({_TOKENS.format("description")}, lambda t: t <> '') AS l FROM topics),
desc_terms AS (SELECT qid, unnest(l) AS term, unnest(range(len(l))) AS pos FROM desc_list),
picked AS (
  SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN df IS NULL THEN 1 ELSE 0 END, coalesce(df, length(term)), term, pos) AS k, count(*) OVER (PARTITION BY qid) AS m
  FROM desc_terms LEFT JOIN df USING (term)
),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, term FROM title WHERE term <> '' UNION ALL SELECT qid, term FROM picked WHERE k <= greatest(floor(m / 2), 10)) GROUP BY qid, term),
scored AS (
  SELECT qid, tf.doc_id, round(sum((1 + log2(tf)) * (1 + log2(qtf)) * idf * idf) / any_value(norm), 6) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN norms ON norms.doc_id = tf.doc_id, n WHERE NOT (df > 0.25 * n.n AND n.n > 10000) GROUP BY qid, tf.doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM scored)
"""
ORACLES["query_terms"] = f"WITH {_INDEX}, {_QUERY} SELECT qid, term, qtf FROM q"
ORACLES["tfidf_top10"] = f"WITH {_INDEX}, {_QUERY} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"

ORACLES["tfidf_top100"] = ORACLES["stored_index_search"] = ORACLES["tfidf_top10"].replace("rank <= 10", "rank <= 100")
ORACLES["stored_dictionary"] = ORACLES["df_idf"]
ORACLES["encoded_index_lists"] = f"WITH {_INDEX}, {_QUERY} SELECT doc_id, term, tf FROM tf WHERE term IN (SELECT term FROM title)"
ORACLES["vbyte_roundtrip"] = f"""
WITH {_INDEX}, idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT DISTINCT doc_id FROM documents)),
g AS (SELECT term, tf, i - coalesce(lag(i) OVER (PARTITION BY term ORDER BY i), 0) AS gap FROM tf JOIN idx USING (doc_id))
SELECT term, CAST(sum(CASE WHEN gap = 0 THEN 1 ELSE 1 + floor(log2(gap) / 7) END) AS BIGINT) AS gap_bytes, CAST(sum(1 + floor(log2(tf) / 7)) AS BIGINT) AS tf_bytes, 4 * count(*) AS fixed_bytes, true AS same FROM g GROUP BY term
"""


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _prepared(c: str) -> str:
    """A text as the re-ranking models read it: lowered, without stop words and punctuation."""
    kept = rf"array_to_string(list_filter(string_split_regex(lower(coalesce({c}, '')), '\s+'), lambda w: w <> '' AND w NOT IN ({_quoted(STOP_WORDS)})), ' ')"
    return f"list_filter(string_split(translate({kept}, {_quoted([PUNCTUATION])}, ''), ' '), lambda w: w <> '')"


_LM = f"""
res AS (SELECT qid, doc_id, rank FROM ranked WHERE rank <= 100),
ltf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_prepared("text")}) AS term FROM documents WHERE doc_id IN (SELECT doc_id FROM res)) GROUP BY doc_id, term),
asked AS (SELECT query_number AS qid, unnest({_prepared("title")}) AS term FROM topics),
held AS (SELECT qid, doc_id, rank, term, tf FROM res JOIN ltf USING (doc_id)),
lens AS (SELECT qid, doc_id, coalesce(sum(tf), 0) AS len FROM res LEFT JOIN ltf USING (doc_id) GROUP BY qid, doc_id),
cf AS (SELECT qid, term, sum(tf) AS cf FROM held GROUP BY qid, term),
tot AS (SELECT qid, sum(cf) AS total FROM cf GROUP BY qid),
bg AS (SELECT qid, term, cf / total AS b FROM (SELECT qid, term, cf * 1.0 AS cf FROM cf UNION ALL SELECT qid, '<UNK>', floor(0.005 * total) FROM tot) JOIN tot USING (qid)),
qt AS (SELECT t.qid, CASE WHEN bg.b IS NULL THEN '<UNK>' ELSE t.term END AS term, count(*) AS n FROM asked t LEFT JOIN bg ON t.qid = bg.qid AND t.term = bg.term GROUP BY 1, 2),
ll AS (
  SELECT l.qid, l.doc_id, l.len, coalesce(sum(qt.n * ln((coalesce(h.tf, 0) + 250 * bg.b) / (l.len + 250))), 0) AS ll
  FROM lens l LEFT JOIN (qt JOIN bg ON qt.qid = bg.qid AND qt.term = bg.term AND bg.b > 0) ON l.qid = qt.qid
  LEFT JOIN held h ON h.qid = l.qid AND h.doc_id = l.doc_id AND h.term = qt.term GROUP BY l.qid, l.doc_id, l.len
)
"""
ORACLES["query_likelihood"] = f"WITH {_INDEX}, {_QUERY}, {_LM} SELECT qid, doc_id, round(ll, 6) AS score FROM ll"
ORACLES["rm1_rerank"] = f"""
WITH {_INDEX}, {_QUERY}, {_LM},
lam AS (SELECT qid, doc_id, len, exp(ll - max(ll) OVER (PARTITION BY qid)) AS e FROM ll),
lam2 AS (SELECT *, e / sum(e) OVER (PARTITION BY qid) AS lam FROM lam),
dense AS (
  SELECT a.qid, a.doc_id, bg.term, a.lam, (coalesce(h.tf, 0) + 250 * bg.b) / (a.len + 250) AS p
  FROM lam2 a JOIN bg ON a.qid = bg.qid LEFT JOIN held h ON h.qid = a.qid AND h.doc_id = a.doc_id AND h.term = bg.term WHERE bg.b > 0
),
rel AS (SELECT qid, term, sum(lam * p) AS r FROM dense GROUP BY qid, term)
SELECT d.qid, d.doc_id, round(1 - sum(p * log10(p / r)), 6) AS score FROM dense d JOIN rel ON d.qid = rel.qid AND d.term = rel.term GROUP BY d.qid, d.doc_id
"""
ORACLES["expansion_rerank"] = f"""
WITH {_INDEX}, {_QUERY}, {_LM},
norm AS (SELECT qid, term, sqrt(sum(tf * tf)) AS norm FROM held GROUP BY qid, term),
unit AS (SELECT qid, h.term, rank, tf / norm AS x FROM held h JOIN norm USING (qid, term)),
centre AS (SELECT u.qid, rank, sum(n * x) AS c FROM unit u JOIN (SELECT qid, term, count(*) AS n FROM asked GROUP BY qid, term) a ON a.qid = u.qid AND a.term = u.term GROUP BY u.qid, rank),
sims AS (SELECT u.qid, u.term, sum(x * coalesce(c, 0)) AS sim FROM unit u LEFT JOIN centre ON centre.qid = u.qid AND centre.rank = u.rank WHERE u.qid IN (SELECT qid FROM centre) GROUP BY u.qid, u.term),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, term DESC) AS place FROM sims) WHERE place <= 10),
model AS (
  SELECT qid, term, sum(p) AS q FROM (
    SELECT qid, term, 0.5 * sim / sum(sim) OVER (PARTITION BY qid) AS p FROM near UNION ALL SELECT qid, term, 0.5 * n / sum(n) OVER (PARTITION BY qid) FROM qt) GROUP BY qid, term
),
used AS (SELECT m.qid, m.term, q, b FROM model m JOIN bg ON bg.qid = m.qid AND bg.term = m.term WHERE q > 0 AND b > 0)
SELECT l.qid, l.doc_id, round(1 - coalesce(sum(q * log10(q / ((coalesce(h.tf, 0) + 250 * b) / (len + 250)))), 0), 6) AS score
FROM lens l LEFT JOIN used u ON u.qid = l.qid LEFT JOIN held h ON h.qid = l.qid AND h.doc_id = l.doc_id AND h.term = u.term GROUP BY l.qid, l.doc_id
"""
ORACLES["relevance_corpora"] = f"""
WITH {_INDEX}, {_QUERY} SELECT qid, string_agg(array_to_string({_prepared("text")}, ' '), ' ' ORDER BY rank) AS text FROM ranked JOIN documents USING (doc_id) WHERE rank <= 100 GROUP BY qid
"""
# Every vector whose id is divisible by 20 asks in its label; ids divisible by 40 also ask for the label's next id, twice.
_NEAREST = """
WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS following FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
q AS (SELECT vec_id AS qid, label, vec_id AS word, 1 AS n FROM u WHERE vec_id % 20 = 0 UNION ALL SELECT vec_id, label, following, 2 FROM u WHERE vec_id % 40 = 0 AND following IS NOT NULL),
s AS (
  SELECT q.qid, CAST(u.vec_id AS VARCHAR) AS word, sum(q.n * list_dot_product(u.e, c.e) / (u.norm * c.norm)) AS sim
  FROM q JOIN u c ON c.vec_id = q.word JOIN u ON u.label = q.label GROUP BY q.qid, u.vec_id
),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, word DESC) AS place FROM s)
"""
ORACLES["expansion_topk"] = _NEAREST + "SELECT qid, word, round(sim, 6) AS sim, round(sim / sum(sim) OVER (PARTITION BY qid), 6) AS weight FROM k WHERE place <= 10"
ORACLES["expansion_file_lines"] = _NEAREST + "SELECT qid || ': ' || string_agg(word, ' ' ORDER BY place) AS value FROM k WHERE place <= 10 GROUP BY qid"
ORACLES["embeddings_file"] = """
SELECT CAST(vec_id AS VARCHAR) AS word, round(e[1] / norm, 5) AS first, round(e[-1] / norm, 5) AS last FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))
"""
ORACLES["rerank_token_counts"] = r"""SELECT doc_id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[ ,.:;"''/\-%()\[\]]+'), lambda t: t <> '')) AS tokens FROM documents"""
ORACLES["mask_unprintable_text"] = r"SELECT doc_id, regexp_replace(text, '[^\x20-\x7e]', '-', 'g') AS text FROM documents"
ORACLES["title_and_content_tokens"] = f"""SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest({_TOKENS.format("coalesce(title, '') || ' ' || coalesce(content, '')")}) AS term FROM docstore) WHERE term <> '' GROUP BY docid, term"""

# Byte-pair tokens as hexadecimal bytes between angle brackets: <7468><65>. A merge is a replacement.
_BYTES = "regexp_replace(hex(encode({})), '(..)', '<\\1>', 'g')"
_PARTS = "string_split({}[2:-2], '><')"


def _merged(c: str) -> str:
    for a, b in GIVEN_MERGES:
        a, b = a.encode().hex().upper(), b.encode().hex().upper()
        c = f"replace({c}, '<{a}><{b}>', '<{a}{b}>')"
    return c


def _bpe_tokens(table: str, key: str, c: str) -> str:
    return f"SELECT {key}, unnest({_PARTS.format('s')}) AS term FROM (SELECT {key}, {_merged(_BYTES.format('word'))} AS s FROM (SELECT {key}, unnest({_TOKENS.format(c)}) AS word FROM {table}) WHERE word <> '')"


_BPE_INDEX = f"""
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_bpe_tokens("documents", "doc_id", "text")}) GROUP BY doc_id, term),
""" + _INDEX[_INDEX.index("df AS") :]
_BPE_QUERY = f"""
title AS (SELECT query_number AS qid, term FROM ({_bpe_tokens("topics", "query_number", "title")})),
desc_terms AS (SELECT query_number AS qid, term, 0 AS pos FROM ({_bpe_tokens("topics", "query_number", "description")})),
""" + _QUERY[_QUERY.index("picked AS") :].replace("length(term)", "length(term) // 2")
ORACLES["tfidf_bpe_top100"] = f"WITH {_BPE_INDEX}, {_BPE_QUERY} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 100"


def _bpe_training(n: int) -> str:
    out = [f"w0 AS MATERIALIZED (SELECT word, {_BYTES.format('word')} AS s, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS word FROM documents) WHERE word <> '' GROUP BY word)"]
    for k in range(n):
        out.append(
            f"b{k} AS MATERIALIZED (SELECT p[1] AS l, p[2] AS r, sum(n) AS c FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: [t[i], t[i + 1]])) AS p, n FROM (SELECT {_PARTS.format('s')} AS t, n FROM w{k})) GROUP BY l, r ORDER BY c DESC, l, r LIMIT 1)"
        )
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT word, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s, n FROM w{k}, b{k})")
    return ", ".join(out)


def _text_of(c: str) -> str:
    return f"array_to_string(list_transform(range(0, len({c}) // 2), lambda i: chr(CAST('0x' || substr({c}, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER))), '')"


ORACLES["bpe_train"] = ORACLES["bpe_merges_file"] = f"WITH {_bpe_training(BPE_MERGES)} " + " UNION ALL ".join(f"SELECT {k} AS rank, {_text_of('l')} AS \"left\", {_text_of('r')} AS \"right\" FROM b{k}" for k in range(BPE_MERGES))
ORACLES["bpe_encode"] = f"""
WITH {_bpe_training(BPE_MERGES)} SELECT doc_id, CAST(sum(len({_PARTS.format('s')})) AS BIGINT) AS tokens
FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS word FROM documents) JOIN w{BPE_MERGES} USING (word) GROUP BY doc_id
"""
ORACLES["length_histogram"] = """
WITH x AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)
SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 30.0)), 29) AS INTEGER) AS bin, count(*) AS n FROM documents, x WHERE n_chars IS NOT NULL GROUP BY 1
"""
ORACLES["hourly_events"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"

_FUSE = """
rows AS (SELECT qid, doc_id, label, row_id, unnest(map_keys(ranks)) AS e, unnest(map_values(ranks)) AS r0 FROM engine_ranks),
long AS (SELECT qid, doc_id, label, row_id, e, CASE WHEN r0 >= 1 THEN r0 END AS r FROM rows),
docs AS (SELECT qid, doc_id, min(row_id) AS seq FROM engine_ranks GROUP BY qid, doc_id),
top AS (SELECT e, max(r) AS top FROM long GROUP BY e)
"""


def _fused(part: str, source: str = "long") -> str:
    return f"SELECT d.qid, d.doc_id, d.seq, round(coalesce(s.score, 0.0), 6) AS score FROM docs d LEFT JOIN (SELECT qid, doc_id, sum({part}) AS score FROM {source} WHERE r IS NOT NULL GROUP BY qid, doc_id) s ON d.qid = s.qid AND d.doc_id = s.doc_id"


_RRF = _fused("1.0 / (100 + r)")
_BORDA = _fused("CAST(top - r + 1 AS DOUBLE)", "(SELECT * FROM long JOIN top USING (e))")
_WEIGHTS = "w AS (SELECT e, coalesce(sum(label * 1.0 / (100 + r)), 0) AS s FROM long GROUP BY e), w2 AS (SELECT e, s / sum(s) OVER () AS w FROM w)"
ORACLES["rrf"] = f"WITH {_FUSE} SELECT qid, doc_id, score FROM ({_RRF})"
ORACLES["borda"] = f"WITH {_FUSE} SELECT qid, doc_id, score FROM ({_BORDA})"
ORACLES["weighted_borda"] = f"WITH {_FUSE}, {_WEIGHTS} SELECT qid, doc_id, score FROM ({_fused('w * (top - r + 1)', '(SELECT * FROM long JOIN top USING (e) JOIN w2 USING (e))')})"
# Every row of a document votes against every other row of its query.
ORACLES["condorcet"] = f"""
WITH {_FUSE}, b AS ({_BORDA}),
eng AS (SELECT DISTINCT qid, e FROM long),
votes AS (
  SELECT x.qid, x.doc_id AS d1, y.doc_id AS d2,
    sum(CASE WHEN a.r IS NULL AND c.r IS NULL THEN 0 WHEN c.r IS NULL THEN 1 WHEN a.r IS NULL THEN -1 WHEN a.r < c.r THEN 1 ELSE -1 END) AS v
  FROM engine_ranks x JOIN engine_ranks y ON x.qid = y.qid AND x.row_id < y.row_id JOIN eng ON eng.qid = x.qid
  LEFT JOIN long a ON a.row_id = x.row_id AND a.e = eng.e LEFT JOIN long c ON c.row_id = y.row_id AND c.e = eng.e GROUP BY x.qid, x.row_id, y.row_id, x.doc_id, y.doc_id
),
wins AS (SELECT qid, CASE WHEN v > 0 THEN d1 ELSE d2 END AS doc_id, count(*) AS wins FROM votes WHERE v <> 0 GROUP BY 1, 2)
SELECT b.qid, b.doc_id, CAST(coalesce(wins, 0) AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY b.qid ORDER BY coalesce(wins, 0) DESC, b.score DESC, b.seq) AS INTEGER) AS rank
FROM b LEFT JOIN wins ON b.qid = wins.qid AND b.doc_id = wins.doc_id
"""
ORACLES["run_file_lines"] = f"""
WITH {_FUSE}, s AS ({_RRF.replace("0.0), 6)", "0.0), 12)")})
SELECT qid || ' Q0 ' || doc_id || ' ' || row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) || ' ' || printf('%.4f', score) || ' rrf' AS value FROM s
"""
_SMOOTH = """SELECT e, slot, 1e-4 + sum(x) AS x FROM (
  SELECT l.e, s.slot, {w} * exp(-((s.slot - r) * (s.slot - r)) / 2.0) / sqrt(2 * pi()) AS x FROM l JOIN top ON l.e = top.e,
    LATERAL (SELECT unnest(range(greatest(1, r - {reach}), least(r + {reach}, top.top) + 1)) AS slot) s WHERE r IS NOT NULL AND {cond}
  UNION ALL SELECT l.e, top.top + 1, {w} FROM l JOIN top ON l.e = top.e WHERE r IS NULL AND {cond}) GROUP BY e, slot"""
ORACLES["bayes_fuse"] = f"""
WITH {_FUSE}, l AS (SELECT *, coalesce(label, 0) AS lab FROM long),
rel AS ({_SMOOTH.format(w="lab", reach=3, cond="lab > 0")}), irr AS ({_SMOOTH.format(w="1.0", reach=5, cond="lab <= 0")}),
n AS (SELECT sum(CASE WHEN label > 0 THEN label END) AS a, sum(CASE WHEN coalesce(label, 0) <= 0 THEN 1 END) AS b FROM engine_ranks),
first AS (SELECT DISTINCT l.qid, l.e FROM l JOIN (SELECT qid, min(row_id) AS s FROM engine_ranks GROUP BY qid) f ON l.row_id = f.s),
odds AS (
  SELECT l.qid, l.doc_id, l.r, ln(coalesce(rel.x, 1e-4) / n.a) - ln(coalesce(irr.x, 1e-4) / n.b) AS o
  FROM l JOIN first ON l.qid = first.qid AND l.e = first.e LEFT JOIN rel ON rel.e = l.e AND rel.slot = l.r LEFT JOIN irr ON irr.e = l.e AND irr.slot = l.r, n WHERE l.r IS NOT NULL
)
SELECT qid, doc_id, score FROM ({_fused("o", "odds")})
"""

_JUDGED = f"""
{_FUSE}, run AS (SELECT CAST(qid AS VARCHAR) AS qid, doc_id AS docno, CAST(score AS REAL) AS sim FROM ({_RRF})),
qrels AS (SELECT CAST(qid AS VARCHAR) AS qid, doc_id AS docno, coalesce(max(label), -1) AS rel, CAST(min(row_id) % 2 AS VARCHAR) AS jg FROM engine_ranks GROUP BY qid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, docno DESC) AS r0 FROM run),
j AS (SELECT qid, docno, r0, CASE WHEN rel IS NULL THEN -1 WHEN rel < 0 THEN -2 ELSE rel END AS rel FROM ranked LEFT JOIN qrels USING (qid, docno)),
"""
_STEPS = """
k AS (
  SELECT qid, docno, rel, row_number() OVER w AS r, CASE WHEN rel >= {L} THEN 1 ELSE 0 END AS is_rel, CAST(sum(CASE WHEN rel >= {L} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS c,
    CAST(coalesce(sum(CASE WHEN rel >= 0 AND rel < {L} THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS nn,
    CAST(coalesce(sum(CASE WHEN rel <> -1 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pool, count(*) OVER (PARTITION BY qid) AS n
  FROM j WHERE {keep} WINDOW w AS (PARTITION BY qid ORDER BY r0)
),
st AS (SELECT qid, sum(CASE WHEN rel >= {L} THEN 1 ELSE 0 END) AS nrel, sum(CASE WHEN rel >= 0 AND rel < {L} THEN 1 ELSE 0 END) AS nnon FROM qrels GROUP BY qid),
"""
_IDEAL = """
ideal AS (SELECT qid, rel AS g, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM qrels WHERE rel > 0),
tot AS (SELECT qid, count(*) AS npos, sum(g) AS gsum, sum(g / log2(i + 1)) AS idcg, sum(CASE WHEN i > 1 THEN g / log2(i) ELSE g END) AS idcg_p FROM ideal GROUP BY qid),
borders AS (SELECT qid, g, m, sum(d) OVER (PARTITION BY qid ORDER BY g DESC) AS idcg FROM (SELECT qid, g, max(i) AS m, sum(g / log2(i + 1)) AS d FROM ideal GROUP BY qid, g)),
f AS (
  SELECT k.*, st.nrel, st.nnon, coalesce(npos, 0) AS npos, gsum, tot.idcg, idcg_p, greatest(k.rel, 0) AS g, coalesce(ideal.g, 0) AS ig,
    sum(greatest(k.rel, 0) / log2(r + 1)) OVER w AS dcg, sum(coalesce(ideal.g, 0) / log2(r + 1)) OVER w AS idcg_r,
    sum(greatest(k.rel, 0)) OVER w AS gain, sum(greatest(coalesce(ideal.g, 0), 1)) OVER w AS cost
  FROM k JOIN st USING (qid) LEFT JOIN tot USING (qid) LEFT JOIN ideal ON ideal.qid = k.qid AND ideal.i = k.r WINDOW w AS (PARTITION BY k.qid ORDER BY r)
)
"""
_BASE = _JUDGED + _STEPS.format(L=1, keep="TRUE") + _IDEAL
ORACLES["judged_run"] = f"WITH {_BASE} SELECT qid, docno, r, rel, c, nn AS nonrel_above, pool AS pool_above FROM k"

_AP = "coalesce(sum(CASE WHEN is_rel = 1 THEN c * 1.0 / r END), 0)"
_R, _N = "any_value(nrel)", "any_value(n)"
_DCG, _IDCG = "max(dcg)", "any_value(idcg)"
_CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)


def _over(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) * 1.0 / ({b}) ELSE 0 END"


def _hits(k: object) -> str:
    return f"coalesce(max(CASE WHEN r <= {k} THEN c END), 0)"


def _recall_precision(x: float) -> str:
    return f"coalesce(max(CASE WHEN nrel > 0 AND c >= floor(CAST({x} AS DOUBLE) * nrel + CAST(0.9 AS DOUBLE)) THEN c * 1.0 / r END), 0)"


_P, _REC = _over("sum(is_rel)", _N), _over("sum(is_rel)", _R)
_SQL = {
    "num_ret": [("num_ret", "count(*)")], "num_rel": [("num_rel", _R)], "num_rel_ret": [("num_rel_ret", "sum(is_rel)")],
    "map": [("map", _over(_AP, _R))], "Rprec": [("Rprec", _over(_hits("nrel"), _R))],
    "bpref": [("bpref", _over("coalesce(sum(CASE WHEN is_rel = 1 THEN CASE WHEN nn = 0 THEN 1.0 ELSE 1.0 - least(nn, nrel) * 1.0 / least(nnon, nrel) END END), 0)", _R))],
    "recip_rank": [("recip_rank", "coalesce(1.0 / min(CASE WHEN is_rel = 1 THEN r END), 0)")],
    "iprec_at_recall": [(f"iprec_at_recall_{x / 10:3.2f}", _recall_precision(x / 10)) for x in range(11)],
    "11pt_avg": [("11pt_avg", "(" + " + ".join(_recall_precision(x / 10) for x in range(11)) + ") / 11.0")],
    "P": [(f"P_{k}", f"{_hits(k)} / {k}.0") for k in _CUTS], "recall": [(f"recall_{k}", _over(_hits(k), _R)) for k in _CUTS],
    "relative_P": [(f"relative_P_{k}", _over(_hits(k), f"least({k}, {_R})")) for k in _CUTS],
    "success": [(f"success_{k}", f"CASE WHEN {_hits(k)} > 0 THEN 1.0 ELSE 0.0 END") for k in (1, 5, 10)],
    "map_cut": [(f"map_cut_{k}", _over(f"coalesce(sum(CASE WHEN is_rel = 1 AND r <= {k} THEN c * 1.0 / r END), 0)", _R)) for k in _CUTS],
    "Rprec_mult": [(f"Rprec_mult_{x / 5:3.2f}", _over(_hits(f"floor(CAST({x / 5} AS DOUBLE) * nrel + CAST(0.9 AS DOUBLE))"), f"floor(CAST({x / 5} AS DOUBLE) * {_R} + CAST(0.9 AS DOUBLE))")) for x in range(1, 11)],
    "infAP": [("infAP", _over("coalesce(sum(CASE WHEN is_rel = 1 THEN CASE WHEN r = 1 THEN 1.0 ELSE 1.0 / r + ((r - 1.0) / r) * (pool / (r - 1.0)) * ((c - 1 + 0.00001) / (c - 1 + nn + 0.00002)) END END), 0)", _R))],
    "utility": [("utility", f"1.0 * sum(is_rel) - ({_N} - sum(is_rel))")],
    "binG": [("binG", _over("coalesce(sum(CASE WHEN is_rel = 1 THEN 1.0 / log2(2 + r - c) END), 0)", _R))],
    "G": [("G", _over("coalesce(sum(CASE WHEN g <> 0 THEN g / log2(2 + cost - gain) END), 0)", "any_value(gsum)"))],
    "ndcg": [("ndcg", _over(_DCG, _IDCG))], "ndcg_p": [("ndcg_p", _over("sum(CASE WHEN r > 1 THEN g / log2(r) ELSE g END)", "any_value(idcg_p)"))],
    "ndcg_rel": [("ndcg_rel", _over(f"coalesce(sum(CASE WHEN g > 0 THEN dcg / idcg_r END), 0) + (any_value(npos) - sum(CASE WHEN g > 0 THEN 1 ELSE 0 END)) * ({_over(_DCG, _IDCG)})", "any_value(npos)"))],
    "ndcg_cut": [(f"ndcg_cut_{k}", _over(f"coalesce(sum(CASE WHEN r <= {k} THEN g / log2(r + 1) END), 0)", f"any_value((SELECT sum(g / log2(i + 1)) FROM ideal x WHERE x.qid = f.qid AND i <= {k}))")) for k in _CUTS],
    "set_P": [("set_P", _P)], "set_recall": [("set_recall", _REC)], "set_relative_P": [("set_relative_P", _over("sum(is_rel)", f"least({_N}, {_R})"))],
    "set_map": [("set_map", _over("sum(is_rel) * sum(is_rel)", f"{_N} * {_R}"))], "set_F": [("set_F", _over(f"2 * ({_P}) * ({_REC})", f"(({_P}) + ({_REC}))"))],
    "num_nonrel_judged_ret": [("num_nonrel_judged_ret", "sum(CASE WHEN rel >= 0 AND is_rel = 0 THEN 1 ELSE 0 END)")],
    "yaap": [("yaap", f"ln(({_AP} + 1) / ({_R} - {_AP} + 1))")],
}
for _name, _labels in _SQL.items():
    _cols = ", ".join(f"CAST({v} AS DOUBLE) AS \"{label}\"" for label, v in _labels)
    _wide = f"SELECT qid, {_cols} FROM f GROUP BY qid"
    ORACLES[f"m_{_name}"] = f"WITH {_BASE}, wide AS ({_wide}) " + " UNION ALL ".join(f"SELECT '{label}' AS measure, qid, round(\"{label}\", 6) AS value FROM wide" for label, _ in _labels)
ORACLES["m_Rndcg"] = f"""
WITH {_BASE}, b AS (
  SELECT borders.qid, sum(f.dcg / borders.idcg) AS s, count(*) AS m FROM borders JOIN (SELECT DISTINCT qid, n FROM f) x USING (qid) JOIN f ON f.qid = borders.qid AND f.r = least(borders.m, x.n) GROUP BY borders.qid
), t AS (SELECT qid, max(dcg) / any_value(idcg) AS last, CASE WHEN any_value(n) > any_value(npos) + 1 THEN 1 ELSE 0 END AS more FROM f GROUP BY qid)
SELECT 'Rndcg' AS measure, t.qid, round(coalesce((b.s + CASE WHEN more = 1 THEN last ELSE 0 END) / (b.m + more), 0), 6) AS value FROM t LEFT JOIN b USING (qid)
"""
ORACLES["m_relstring"] = f"""
WITH {_BASE} SELECT 'relstring' AS measure, qid, '''' || string_agg(CASE WHEN rel = -1 THEN '-' WHEN rel < 0 THEN '.' WHEN rel > 9 THEN '>' ELSE CAST(rel AS VARCHAR) END, '' ORDER BY r) || '''' AS value
FROM f WHERE r <= 10 GROUP BY qid
"""


def _summary(base: str, counts: list[str], means: list[str], n_q: str = "count(*)") -> str:
    cols = [v for m in counts + means for v in _SQL.get(m, [])]
    cols += [x for m in ("P_5", "P_10") if m in means for x in _SQL["P"] if x[0] == m]
    wide = "SELECT qid, " + ", ".join(f"CAST({v} AS DOUBLE) AS {label}" for label, v in cols) + " FROM f GROUP BY qid"
    parts = [f"SELECT '{m}' AS measure, 'all' AS qid, round({'sum(' + m + ')' if m in counts else f'sum({m}) / {n_q}'}, 6) AS value, CAST(NULL AS VARCHAR) AS text FROM wide" for m in counts + means]
    return f"WITH {base}, wide AS ({wide}) " + " UNION ALL ".join(parts)


_COUNTS = ["num_rel", "num_ret", "num_rel_ret"]
ORACLES["eval_level2_judged_only"] = _summary(_JUDGED + _STEPS.format(L=2, keep="rel >= 0") + _IDEAL.replace("FROM k JOIN st USING (qid)", "FROM k JOIN st USING (qid)"), _COUNTS, ["map", "P_5", "P_10"], "(SELECT count(DISTINCT qid) FROM qrels)")
ORACLES["eval_complete_top20"] = _summary(_JUDGED + _STEPS.format(L=1, keep="r0 <= 20") + _IDEAL, _COUNTS, ["map", "P_5", "P_10", "recip_rank"], "(SELECT count(DISTINCT qid) FROM qrels)")
ORACLES["preference_pair_counts"] = f"WITH {_BASE} SELECT a.qid, a.jg, count(*) AS pairs FROM qrels a JOIN qrels b ON a.qid = b.qid AND a.jg = b.jg AND a.rel > b.rel GROUP BY a.qid, a.jg"
ORACLES["correct_counts"] = f"WITH {_BASE} SELECT q.qid, CAST(sum(CASE WHEN rel > 0 AND run.docno IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM qrels q LEFT JOIN run USING (qid, docno) GROUP BY q.qid"
ORACLES["mean_f1"] = f"""
WITH {_BASE} SELECT qid, round(({" + ".join(f"2.0 * {_hits(k)} / ({k} + {_R})" for k in (10, 20, 50, 100))}) / 4, 6) AS f1 FROM f WHERE nrel > 0 GROUP BY qid
"""

ORACLES["p7_found"] = r"""
WITH f AS (
  SELECT row_id, 'pdf_json_files' AS field_name, pdf_json_files AS s FROM metadata UNION ALL SELECT row_id, 'pmc_json_files', pmc_json_files FROM metadata
), e AS (
  SELECT row_id, field_name, unnest(l) AS e, unnest(range(len(l))) AS i
  FROM (SELECT row_id, field_name, regexp_extract_all(s, '[ \[({<]*"(?:[^"]|"")*"|[ \[({<]*''(?:[^'']|'''')*''|[^;,|\x00-\x1f]+') AS l FROM f WHERE s IS NOT NULL)
), t AS (
  SELECT row_id, field_name, i, regexp_replace(e, '^[\s\[({<]+|[\s\])}>]+$', '', 'g') AS v FROM e
), u AS (
  SELECT row_id, field_name, i, trim(CASE WHEN v LIKE '"%"' AND len(v) > 1 THEN replace(v[2:-2], '""', '"') WHEN v LIKE '''%''' AND len(v) > 1 THEN replace(v[2:-2], '''''', '''') ELSE regexp_replace(v, '^["'']+|["'']+$', '', 'g') END) AS v FROM t
)
SELECT row_id, field_name, CAST(row_number() OVER (PARTITION BY row_id, field_name ORDER BY i) AS INTEGER) AS pos, v AS file_path
FROM u WHERE v <> '' AND lower(v) NOT IN (SELECT lower(trim(stand_in)) FROM stand_ins WHERE stand_in IS NOT NULL)
"""


def _summaries(names: list[str], base: str = _BASE, run_id: str | None = "rrf", digits: int = 6) -> str:
    """Summary rows of measures: sums of counts, means, and geometric means with their floor; Rndcg from its own query."""
    labels = [(m, label, v) for m in names for label, v in _SQL.get(m, [])]
    wide = "SELECT qid, " + ", ".join(f'CAST({v} AS DOUBLE) AS "{label}"' for _, label, v in labels) + " FROM f GROUP BY qid"
    row = f"SELECT '{{}}' AS measure, 'all' AS qid, round({{}}, {digits}) AS value, CAST(NULL AS VARCHAR) AS text FROM {{}}"
    parts = [f"SELECT 'runid' AS measure, 'all' AS qid, CAST(NULL AS DOUBLE) AS value, '{run_id}' AS text"] if run_id else []
    parts += [row.format("num_q", "CAST(count(*) AS DOUBLE)", "wide")] if "num_q" in names else []
    parts += [row.format(label, f'sum("{label}")' if m.startswith("num_") else f'avg("{label}")', "wide") for m, label, _ in labels]
    parts += [row.format(f"gm_{m}", f'exp(avg(ln(greatest("{m}", 0.00001))))', "wide") for m in ("map", "bpref") if f"gm_{m}" in names]
    if "Rndcg" in names:
        parts.append(row.format("Rndcg", "avg(value)", f"({ORACLES['m_Rndcg']})"))
    return f"WITH {base}, wide AS ({wide}) " + " UNION ALL ".join(parts)


_OFFICIAL = "num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P".split()
ORACLES["eval_official"] = _summaries(_OFFICIAL)
ORACLES["eval_all_trec"] = _summaries(
    _OFFICIAL + "recall infAP gm_bpref utility 11pt_avg ndcg relative_P Rprec_mult success map_cut ndcg_cut ndcg_rel Rndcg binG G set_P set_recall set_relative_P set_map set_F num_nonrel_judged_ret yaap".split()
)
_WHOLE = _quoted(["num_q", "num_ret", "num_rel", "num_rel_ret"])
ORACLES["report"] = f"""
SELECT rpad(measure, CAST(greatest(22, length(measure)) AS INTEGER), ' ') || chr(9) || qid || chr(9) || coalesce(text, CASE WHEN measure IN ({_WHOLE}) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%6.4f', value) END) AS value FROM ({_summaries(_OFFICIAL, digits=12)})
"""
_RUNS = f"""
run AS (SELECT run_id || '/' || query_number AS qid, docno, CAST(max(score) AS REAL) AS sim FROM runs WHERE docno IS NOT NULL AND score IS NOT NULL AND run_id IS NOT NULL AND query_number IS NOT NULL AND isfinite(score) GROUP BY 1, 2),
qrels AS (SELECT qid, docno, CASE WHEN (ascii(docno[-1]) + ascii(docno[1])) % 7 = 0 THEN -1 ELSE greatest((ascii(docno[-1]) + ascii(docno[1])) % 5 - 2, 0) END AS rel FROM run),
{_JUDGED[_JUDGED.index("ranked AS") :]}
{_STEPS.format(L=1, keep="TRUE")}
{_IDEAL}"""
ORACLES["eval_runs"] = _summaries([*_OFFICIAL, "ndcg"], _RUNS, None)
_ONE = "(SELECT min(CAST(qid AS VARCHAR)) FROM engine_ranks)"
_ONE_LABELS = [x for m in ("map", "num_rel", "num_ret", "num_rel_ret") for x in _SQL[m]] + _SQL["P"][:2]
ORACLES["eval_single_query"] = f"WITH {_BASE}, wide AS (SELECT qid, {', '.join(f'CAST({v} AS DOUBLE) AS {label}' for label, v in _ONE_LABELS)} FROM f WHERE qid = {_ONE} GROUP BY qid) " + " UNION ALL ".join(
    [f"SELECT '{label}' AS measure, {q} AS qid, round({label}, 6) AS value, CAST(NULL AS VARCHAR) AS text FROM wide" for label, _ in _ONE_LABELS for q in ("qid", "'all'")]
    + ["SELECT 'num_q', 'all', 1.0, CAST(NULL AS VARCHAR)"]
)
_GAIN = "CASE rel " + " ".join(f"WHEN {level} THEN {gain}" for level, gain in GAINS) + " ELSE greatest(rel, 0) END"
ORACLES["eval_gains"] = f"""
WITH {_BASE}, mine AS (SELECT qid, CAST({_GAIN} AS DOUBLE) AS g, r FROM k), best AS (SELECT qid, CAST({_GAIN} AS DOUBLE) AS g, row_number() OVER (PARTITION BY qid ORDER BY {_GAIN} DESC) AS i FROM qrels)
SELECT 'ndcg' AS measure, qid, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 6) AS value FROM (SELECT qid, sum(g / log2(r + 1)) AS a FROM mine GROUP BY qid) JOIN (SELECT qid, sum(g / log2(i + 1)) AS b FROM best GROUP BY qid) USING (qid)
"""
ORACLES["eval_zscores"] = f"""
WITH {_BASE}, w AS (SELECT qid, CAST({_SQL['map'][0][1]} AS DOUBLE) AS v, CAST({_SQL['P'][1][1]} AS DOUBLE) AS m, CAST({_P} AS DOUBLE) AS d FROM f GROUP BY qid)
SELECT 'Zmap' AS measure, qid, round(CASE WHEN CAST(qid AS INTEGER) % 2 <> 1 THEN -1000000 WHEN d = 0 THEN CASE WHEN v = m THEN 0 ELSE -1000000 END ELSE (v - m) / d END, 5) AS value FROM w
"""
_LINEAR = "sum(CASE WHEN r <= {k} THEN greatest(rel, 0) / log2(r + 1) END)"
ORACLES["mean_ndcg"] = f"""
WITH {_BASE}, best AS (
  SELECT qid, {", ".join(f"sum(CASE WHEN i <= {k} THEN rel / log2(i + 1) END) AS i{k}" for k in (5, 10, 50))}
  FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM qrels WHERE rel >= 0) GROUP BY qid
), got AS (SELECT qid, {", ".join(f"{_LINEAR.format(k=k)} AS d{k}" for k in (5, 10, 50))} FROM k GROUP BY qid)
SELECT qid, {", ".join(f"round(CASE WHEN i{k} > 0 THEN coalesce(d{k}, 0) / i{k} ELSE 0 END, 6) AS ndcg_{k}" for k in (5, 10, 50))} FROM got JOIN best USING (qid)
"""

ORACLES["preprocess_text"] = rf"""
WITH a AS (
  SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '' AND w NOT IN ({_quoted(STOP_WORDS)})), ' ') AS t FROM documents
), b AS (SELECT doc_id, array_to_string(list_filter(string_split(translate(t, {_quoted([PUNCTUATION])}, ''), ' '), lambda w: w <> ''), ' ') AS t FROM a)
SELECT doc_id, regexp_replace(t, '\d+(\.\d+)?', '<NUMBER>', 'g') AS text FROM b
"""

_GROUPS = f"""
{_FUSE}, run0 AS (SELECT CAST(qid AS VARCHAR) AS qid, doc_id AS docno, CAST(score AS REAL) AS sim FROM ({_RRF})),
q0 AS (SELECT CAST(qid AS VARCHAR) AS qid, doc_id AS docno, coalesce(max(label), -1) AS rel, CAST(min(row_id) % 2 AS VARCHAR) AS jg FROM engine_ranks GROUP BY qid, doc_id),
"""
_JG_BASE = (
    _GROUPS
    + """
qrels AS (SELECT qid || '|' || jg AS qid, docno, rel FROM q0),
run AS (SELECT g.qid || '|' || g.jg AS qid, docno, sim FROM run0 r JOIN (SELECT DISTINCT qid, jg FROM q0) g ON g.qid = r.qid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, docno DESC) AS r0 FROM run),
j AS (SELECT ranked.qid, ranked.docno, r0, CASE WHEN rel IS NULL THEN -1 WHEN rel < 0 THEN -2 ELSE rel END AS rel FROM ranked LEFT JOIN qrels ON qrels.qid = ranked.qid AND qrels.docno = ranked.docno),
"""
    + _STEPS.format(L=1, keep="TRUE")
    + _IDEAL
)
_JG_LABELS = [(label.replace(m, f"{m}_avgjg", 1), v) for m in ("map", "P", "Rprec_mult") for label, v in _SQL[m]]
ORACLES["eval_judgment_groups"] = (
    f"WITH {_JG_BASE}, wide AS (SELECT qid, " + ", ".join(f'CAST({v} AS DOUBLE) AS "{label}"' for label, v in _JG_LABELS) + " FROM f GROUP BY qid) "
    + " UNION ALL ".join(f"SELECT '{label}' AS measure, split_part(qid, '|', 1) AS qid, round(avg(\"{label}\"), 6) AS value FROM wide GROUP BY split_part(qid, '|', 1)" for label, _ in _JG_LABELS)
)
_RATIO = "CASE WHEN {b} > 0 THEN {a} * 1.0 / {b} ELSE 0 END"
_PREFS = {
    "prefs_num_prefs_poss": "sum(poss)", "prefs_num_prefs_ful": "sum(ful)", "prefs_num_prefs_ful_ret": "sum(ful_ret)",
    "prefs_simp": _RATIO.format(a="sum(ful)", b="sum(poss)"), "prefs_simp_ret": _RATIO.format(a="sum(ful_ret)", b="sum(poss_ret)"), "prefs_simp_imp": _RATIO.format(a="sum(ful)", b="sum(poss_imp)"),
    "prefs_avgjg": f"avg({_RATIO.format(a='ful', b='poss')})", "prefs_avgjg_ret": f"avg({_RATIO.format(a='ful_ret', b='poss_ret')})", "prefs_avgjg_imp": f"avg({_RATIO.format(a='ful', b='poss_imp')})",
}
_PAIRED = {
    "prefs_pair": "sum(CASE WHEN one_ret THEN good ELSE 0 END) / count(*)", "prefs_pair_ret": "coalesce(sum(CASE WHEN two_ret THEN good END) / sum(CASE WHEN two_ret THEN 1 END), 0)",
    "prefs_pair_imp": "coalesce(sum(CASE WHEN one_ret THEN good END) / sum(CASE WHEN one_ret THEN 1 END), 0)",
}
_PLACED = f"""
{_GROUPS} place AS (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, docno) AS r FROM run0),
pos AS (SELECT q0.qid, jg, q0.docno, rel, row_number() OVER (PARTITION BY q0.qid ORDER BY r NULLS LAST, q0.docno) AS p, r IS NOT NULL AS ret FROM q0 LEFT JOIN place ON place.qid = q0.qid AND place.docno = q0.docno)
"""
# Groups with more nonrelevant than relevant documents are counted again with the first of the lowest level only.
ORACLES["eval_preferences_recounted"] = f"""
WITH {_PLACED}, g AS (
  SELECT qid, jg, count(*) FILTER (rel > 0) AS rel, count(*) FILTER (rel <= 0) AS non, count(*) FILTER (rel > 0 AND ret) AS rel_ret, count(*) FILTER (rel <= 0 AND ret) AS non_ret, min(rel) AS lowest FROM pos GROUP BY qid, jg
), pairs AS (SELECT a.qid, a.jg, a.p AS pa, b.p AS pb, a.ret AS ra, b.ret AS rb, b.rel = g.lowest AS low FROM pos a JOIN pos b ON a.qid = b.qid AND a.jg = b.jg AND a.rel > b.rel JOIN g ON g.qid = a.qid AND g.jg = a.jg
), c AS (SELECT qid, jg, count(*) AS poss, count(*) FILTER (pa < pb AND (ra OR rb)) AS ful, count(*) FILTER (ra AND rb) AS poss_ret, count(*) FILTER (ra AND rb AND pa < pb) AS ful_ret FROM pairs GROUP BY qid, jg
), low AS (SELECT pos.qid, pos.jg, p, ret, row_number() OVER (PARTITION BY pos.qid, pos.jg ORDER BY p) AS k FROM pos JOIN g ON g.qid = pos.qid AND g.jg = pos.jg WHERE pos.rel = g.lowest
), again AS (
  SELECT qid, jg, pa, pb, ra, rb, 1 AS first, 1 AS first_ret FROM pairs WHERE NOT low
  UNION ALL SELECT a.qid, a.jg, a.p, l.p, a.ret, l.ret, CASE WHEN k <= g.rel THEN 1 END, CASE WHEN k <= g.rel_ret THEN 1 END FROM pos a JOIN low l ON l.qid = a.qid AND l.jg = a.jg JOIN g ON g.qid = a.qid AND g.jg = a.jg
), r AS (
  SELECT qid, jg, count(first) AS poss, count(first) FILTER (pa < pb AND ra) AS ful, count(first_ret) FILTER (ra AND rb) AS poss_ret, count(first_ret) FILTER (ra AND rb AND pa < pb) AS ful_ret FROM again GROUP BY qid, jg
), v AS (
  SELECT g.qid, CASE WHEN g.rel >= non THEN coalesce((coalesce(c.ful, 0) + rel_ret * (g.rel - non)) * 1.0 / nullif(coalesce(c.poss, 0) + g.rel * (g.rel - non), 0), 0) ELSE coalesce(r.ful * 1.0 / nullif(r.poss, 0), 0) END AS a,
    CASE WHEN rel_ret >= non_ret THEN coalesce((coalesce(c.ful_ret, 0) + rel_ret * (rel_ret - non_ret)) * 1.0 / nullif(coalesce(c.poss_ret, 0) + g.rel * (rel_ret - non_ret), 0), 0) ELSE coalesce(r.ful_ret * 1.0 / nullif(r.poss_ret, 0), 0) END AS b
  FROM g LEFT JOIN c ON c.qid = g.qid AND c.jg = g.jg LEFT JOIN r ON r.qid = g.qid AND r.jg = g.jg
)
SELECT 'prefs_avgjg_Rnonrel' AS measure, qid, round(avg(a), 6) AS value FROM v GROUP BY qid UNION ALL SELECT 'prefs_avgjg_Rnonrel_ret', qid, round(avg(b), 6) FROM v GROUP BY qid
"""
ORACLES["eval_preferences"] = (
    f"""
WITH {_GROUPS} place AS (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, docno) AS r FROM run0),
pos AS (SELECT q0.qid, jg, q0.docno, rel, row_number() OVER (PARTITION BY q0.qid ORDER BY r NULLS LAST, q0.docno) AS p, r IS NOT NULL AS ret FROM q0 LEFT JOIN place ON place.qid = q0.qid AND place.docno = q0.docno),
pairs AS (SELECT a.qid, a.jg, a.p AS pa, b.p AS pb, a.ret AND b.ret AS two_ret, a.ret OR b.ret AS one_ret FROM pos a JOIN pos b ON a.qid = b.qid AND a.jg = b.jg AND a.rel > b.rel),
c AS (
  SELECT qid, jg, count(*) AS poss, sum(CASE WHEN pa < pb AND one_ret THEN 1 ELSE 0 END) AS ful, sum(CASE WHEN two_ret THEN 1 ELSE 0 END) AS poss_ret,
    sum(CASE WHEN two_ret AND pa < pb THEN 1 ELSE 0 END) AS ful_ret, sum(CASE WHEN one_ret THEN 1 ELSE 0 END) AS poss_imp FROM pairs GROUP BY qid, jg
), g AS (SELECT k.qid, coalesce(poss, 0) AS poss, coalesce(ful, 0) AS ful, coalesce(poss_ret, 0) AS poss_ret, coalesce(ful_ret, 0) AS ful_ret, coalesce(poss_imp, 0) AS poss_imp
  FROM (SELECT DISTINCT qid, jg FROM q0) k LEFT JOIN c ON c.qid = k.qid AND c.jg = k.jg),
two AS (SELECT qid, least(pa, pb) AS p1, greatest(pa, pb) AS p2, two_ret, one_ret, avg(CASE WHEN pa < pb THEN 1.0 ELSE 0.0 END) AS good FROM pairs GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT qid, """
    + ", ".join(f"CAST({v} AS DOUBLE) AS {m}" for m, v in _PREFS.items())
    + " FROM g GROUP BY qid), w2 AS (SELECT qid, "
    + ", ".join(f"CAST({v} AS DOUBLE) AS {m}" for m, v in _PAIRED.items())
    + " FROM two GROUP BY qid) "
    + " UNION ALL ".join(f"SELECT '{m}' AS measure, w.qid, round(coalesce({m}, 0), 6) AS value FROM w LEFT JOIN w2 USING (qid)" for m in [*_PREFS, *_PAIRED])
)

_SUBGROUPS = """
q1 AS (SELECT CAST(qid AS VARCHAR) AS qid, 'g' AS jg, doc_id AS docno, coalesce(max(label), -1) AS rel, min(row_id) % 3 AS k FROM engine_ranks GROUP BY qid, doc_id),
q2 AS (SELECT qid, jg, unnest(CASE k WHEN 0 THEN ['0'] WHEN 1 THEN ['1'] ELSE ['0', '1'] END) AS jsg, docno, rel FROM q1)
"""
_CLOSED = f"""
{_SUBGROUPS}, edges AS (SELECT DISTINCT a.qid, a.docno AS a, b.docno AS b FROM q2 a JOIN q2 b ON a.qid = b.qid AND a.jsg = b.jsg AND a.rel > b.rel),
closed AS (SELECT qid, a, b FROM edges UNION SELECT c.qid, c.a, e.b FROM closed c JOIN edges e ON e.qid = c.qid AND e.a = c.b)
"""
ORACLES["preference_closure_counts"] = f"WITH RECURSIVE {_CLOSED} SELECT qid, 'g' AS jg, count(*) AS pairs FROM closed GROUP BY qid"
ORACLES["eval_preference_subgroups"] = (
    ORACLES["eval_preferences"]
    .replace("WITH ", f"WITH RECURSIVE {_CLOSED}, ", 1)
    .replace("CAST(min(row_id) % 2 AS VARCHAR) AS jg", "'g' AS jg")
    .replace("FROM pos a JOIN pos b ON a.qid = b.qid AND a.jg = b.jg AND a.rel > b.rel", "FROM closed x JOIN pos a ON a.qid = x.qid AND a.docno = x.a JOIN pos b ON b.qid = x.qid AND b.docno = x.b")
)
_JG_ROWS = "SELECT CAST(qid AS VARCHAR) AS qid, CAST(min(row_id) % 2 AS VARCHAR) AS jg, doc_id AS docno, coalesce(max(label), -1) AS rel FROM engine_ranks GROUP BY qid, doc_id"
ORACLES["qrels_groups_file"] = _JG_ROWS
ORACLES["qrels_as_preferences_file"] = f"SELECT qid, jg, '0' AS jsg, docno, CAST(rel AS REAL) AS level FROM ({_JG_ROWS})"
ORACLES["preferences_file"] = f"WITH {_SUBGROUPS} SELECT qid, jg, jsg, docno, CAST(rel AS REAL) AS level FROM q2"
ORACLES["qrels_file"] = "SELECT CAST(qid AS VARCHAR) AS qid, doc_id AS docno, label AS rel FROM engine_ranks WHERE label IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL"
ORACLES["run_file"] = """
SELECT CAST(query_number AS VARCHAR) AS qid, docno, rank, round(CAST(CAST(round(score, 4) AS REAL) AS DOUBLE), 2) AS sim, run_id FROM runs
WHERE query_number IS NOT NULL AND docno IS NOT NULL AND rank IS NOT NULL AND score IS NOT NULL AND run_id IS NOT NULL AND isfinite(score)
"""
ORACLES["result4_file"] = f"WITH {_INDEX}, {_QUERY.replace('any_value(norm), 6)', 'any_value(norm), 4)')} SELECT CAST(qid AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS doc_id, score FROM ranked WHERE rank <= 10"
ORACLES["engine_ranks_file"] = """
SELECT label, qid, doc_id, unnest(map_keys(ranks)) AS engine, unnest(map_values(ranks)) AS rank, inc, prob FROM engine_ranks WHERE label IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL
"""
ORACLES["topics_file"] = "SELECT query_number AS qid, trim(coalesce(title, '')) AS title, trim(coalesce(description, '')) AS description FROM topics"
ORACLES["xml_topics_file"] = "SELECT query_number AS qid, trim(title) AS query, trim(description) AS question, trim(narrative) AS narrative FROM topics"
_PLAIN = r"trim(regexp_replace(coalesce({}, ''), '[\s\x00-\x1f\x7f\x85]+', ' ', 'g'))"
ORACLES["xml_documents_file"] = f"SELECT docid AS doc_id, {_PLAIN.format('title')} AS title, {_PLAIN.format('content')} AS content FROM docstore"
_JSON_FILES = "len(list_filter(string_split(coalesce({0}, ''), ';'), lambda x: contains(x, 'json'))) AS {1}"
ORACLES["metadata_file"] = f"SELECT cord_uid, coalesce(title, '') AS title, {_JSON_FILES.format('pdf_json_files', 'pdf_files')}, {_JSON_FILES.format('pmc_json_files', 'pmc_files')} FROM metadata WHERE cord_uid IN (SELECT docid FROM docstore)"
ORACLES["article_files"] = "SELECT query_number, CAST(seg - 1 AS INTEGER) AS seg, [title, description, narrative][seg] AS text FROM topics, (SELECT unnest([1, 2, 3]) AS seg)"
ORACLES["training_rows"] = """
SELECT file, doc_id FROM (SELECT source AS file, doc_id, dense_rank() OVER (ORDER BY source) AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS d FROM documents WHERE source IS NOT NULL) WHERE f % 2 = 1 AND d % 5 = 1
"""
# Objects reached from body_text through body_text and lists, in reading order; a value written as text stands for what it holds.
_HELD = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN CASE WHEN json_type(CAST({0} ->> '$' AS JSON)) IN ('ARRAY', 'OBJECT') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END ELSE {0} END"
ORACLES["p3_found"] = rf"""
WITH RECURSIVE a AS (SELECT article_id, CAST(payload AS JSON) AS p FROM articles WHERE payload IS NOT NULL AND json_valid(payload)),
root AS (SELECT article_id, {_HELD.format("p")} AS p FROM a),
nodes AS (
  SELECT article_id, CAST([] AS BIGINT[]) AS place, {_HELD.format("(p -> 'body_text')")} AS x FROM root WHERE json_type(p) = 'OBJECT'
  UNION ALL
  SELECT article_id, list_append(place, i) AS place, {_HELD.format("y")} AS x FROM (
    SELECT article_id, place, unnest(CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') ELSE [x -> 'body_text'] END) AS y,
      unnest(range(1, CASE json_type(x) WHEN 'ARRAY' THEN CAST(json_array_length(x) AS BIGINT) ELSE 1 END + 1)) AS i
    FROM nodes WHERE json_type(x) IN ('ARRAY', 'OBJECT')
  ) WHERE y IS NOT NULL
),
pieces AS (
  SELECT article_id, place, x -> 'text' AS t FROM nodes WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT article_id, place, unnest(json_extract(t, '$[*]')) FROM pieces WHERE json_type(t) = 'ARRAY'
),
spoken AS (SELECT DISTINCT article_id, place FROM pieces WHERE json_type(t) = 'VARCHAR' AND regexp_replace(t ->> '$', '[\s\x1c-\x1f\x85\p{{Z}}]+', '', 'g') <> ''),
paras AS (SELECT article_id, place, CAST(row_number() OVER (PARTITION BY article_id ORDER BY place) AS INTEGER) AS para_no FROM spoken),
cites AS (
  SELECT article_id, para_no, CAST([] AS BIGINT[]) AS k, {_HELD.format("(x -> 'cite_spans')")} AS s FROM paras JOIN nodes USING (article_id, place)
  UNION ALL SELECT article_id, para_no, list_append(k, i), s FROM (SELECT article_id, para_no, k, unnest(json_extract(s, '$[*]')) AS s, unnest(range(1, CAST(json_array_length(s) AS BIGINT) + 1)) AS i FROM cites WHERE json_type(s) = 'ARRAY')
)
SELECT article_id, para_no, 0 AS span_no FROM paras
UNION ALL SELECT article_id, para_no, CAST(row_number() OVER (PARTITION BY article_id, para_no ORDER BY k) AS INTEGER) FROM cites WHERE json_type(s) = 'OBJECT'
"""
