"""The SQL (DuckDB) against which the named queries are held."""

from __future__ import annotations

# White space as the engine's text functions see it.
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _squash(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sentences(x: str) -> str:
    marked = rf"regexp_replace(coalesce({x}, ''), '([.!?])([ \t]*\n+|[ \t]+)', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _cut(x: str) -> str:
    return f"list_filter(string_split(lower({_squash(f'coalesce({x}, chr(32))')}), ' '), lambda w: w <> '')"


def _last(name: str, source: str, key: str, columns: str) -> str:
    order = ", ".join(f"{c.strip()} DESC NULLS LAST" for c in columns.split(","))
    return f"\n{name} AS (SELECT {key}, {columns} FROM {source} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


_CORPUS = _last("c", "chunks", "chunk_id", "ingested_at, doc_id, collection, text, start_char, token_count, section_path, page_number")
_GOLDEN = _last("g", "golden_set", "qid", "question, relevant_doc_ids, relevant_chunk_texts, answer, category, difficulty")
_BM25 = r"""
tok AS (SELECT chunk_id, CASE WHEN len(t) > 0 THEN t ELSE [''] END AS terms
        FROM (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM c)),
size AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM tok) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, size),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25_SCORES = r"""
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(terms) AS term, len(terms) AS dl FROM tok) GROUP BY chunk_id, term),
qt AS (SELECT qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM g),
lex AS (SELECT qid, chunk_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 9) AS score
        FROM qt JOIN idf USING (term) JOIN post USING (term), size GROUP BY qid, chunk_id)"""


def _hashed(source: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM (
        SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 128 AS bucket, count(*)::DOUBLE AS n
        FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')) AS t FROM {source}) GROUP BY {key}, bucket))"""


_HITS = """
h AS (SELECT *, row_number() OVER (PARTITION BY qid, retriever ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT qid, retriever, chunk_id, max(score) AS score FROM search_hits
      WHERE qid IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
      GROUP BY qid, retriever, chunk_id)),
pair AS (SELECT * FROM h WHERE retriever IN ('dense', 'lexical'))"""
_RRF = """
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS fused_rank FROM (
          SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) FILTER (retriever = 'dense') AS dense_rank,
                 min(rank) FILTER (retriever = 'lexical') AS lexical_rank FROM pair GROUP BY qid, chunk_id))"""
_RERANK = f"""
asked AS (SELECT qid, question FROM g),
rr AS (SELECT *, fused_rank - final_rank AS rank_movement FROM (
       SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, chunk_id) AS final_rank FROM (
       SELECT f.qid, f.chunk_id, fused_rank, c.text,
              round(len(list_intersect(list_distinct({_cut('asked.question')}), list_distinct({_cut('c.text')}))) / 10.0::DOUBLE, 9) AS rerank_score
       FROM fused f JOIN asked USING (qid) JOIN c USING (chunk_id) WHERE fused_rank <= 20)) WHERE final_rank <= 5)"""
_OVERLAP = """(len(hay) > 0 AND len(needle) > 0 AND (contains(hay, needle) OR (length(needle) >= 50 AND
   len(list_filter(range(1, greatest(length(needle) - 48, 2)), lambda i: contains(hay, substr(needle, i::BIGINT, 50)))) > 0)))"""
_FLAGS = f"""
res AS (SELECT qid, chunk_id, fused_rank AS rank, c.text, relevant_chunk_texts FROM fused JOIN g USING (qid) JOIN c USING (chunk_id) WHERE fused_rank <= 5),
rel AS (SELECT DISTINCT qid, chunk_id FROM (
        SELECT qid, chunk_id, {_squash("coalesce(text, '')")} AS hay, {_squash('s')} AS needle FROM (SELECT qid, chunk_id, text, unnest(relevant_chunk_texts) AS s FROM res)) WHERE {_OVERLAP}),
flags AS (SELECT res.qid, res.chunk_id, rank, rel.qid IS NOT NULL AS relevant FROM res LEFT JOIN rel ON rel.qid = res.qid AND rel.chunk_id = res.chunk_id)"""
_METRICS = f"""
named AS (SELECT DISTINCT qid, unnest(relevant_doc_ids) AS doc_id FROM g),
hitc AS (SELECT qid, count(DISTINCT chunk_id) AS total FROM (
         SELECT qid, chunk_id, {_squash("coalesce(text, '')")} AS hay, {_squash('s')} AS needle
         FROM (SELECT named.qid, c.chunk_id, c.text, unnest(g.relevant_chunk_texts) AS s FROM named JOIN c USING (doc_id) JOIN g ON g.qid = named.qid)) WHERE {_OVERLAP} GROUP BY qid),
tot AS (SELECT g.qid, coalesce(total, 0) AS total FROM g LEFT JOIN hitc USING (qid)),
agg AS (SELECT t.qid, any_value(t.total) AS total, coalesce(sum(relevant::INT), 0) AS found, min(CASE WHEN relevant THEN rank END) AS first,
               coalesce(sum(CASE WHEN relevant THEN 1.0::DOUBLE / log2(rank + 1) END), 0) AS dcg FROM tot t LEFT JOIN flags f USING (qid) GROUP BY t.qid),
m AS (SELECT qid, total, CASE WHEN total > 0 THEN round(least(1.0::DOUBLE, found / total::DOUBLE), 9) ELSE 0.0 END AS recall, round(found / 5.0::DOUBLE, 9) AS precision,
             CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit, CASE WHEN first IS NOT NULL THEN round(1.0::DOUBLE / first, 9) ELSE 0.0 END AS rr,
             CASE WHEN greatest(found, total) > 0 THEN round(dcg / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, 6) r(i) WHERE i <= greatest(found, total)), 9) ELSE 0.0 END AS ndcg FROM agg)"""
_REFUSAL = """
per AS (SELECT qid, count(*) AS n, max(r) AS top_rerank, max(s) AS top, count_if(r >= 0.3) AS strong FROM (
        SELECT qid, chunk_id, max(score) AS s, max(CASE WHEN retriever = 'rerank' THEN score END) AS r FROM h GROUP BY qid, chunk_id) GROUP BY qid),
ref AS (SELECT q.qid, CASE WHEN n IS NULL THEN 'no sources were retrieved' WHEN top_rerank IS NULL THEN NULL
                WHEN top_rerank < 0.3 THEN 'top confidence ' || format('{:.3f}', top_rerank) || ' below 0.30' END AS reason,
               round(CASE WHEN n IS NULL THEN 0.0 WHEN top_rerank IS NOT NULL THEN top_rerank ELSE top END, 9) AS confidence,
               CASE WHEN top_rerank IS NOT NULL THEN strong ELSE coalesce(n, 0) END AS usable_sources, top_rerank IS NOT NULL AS threshold_applied
        FROM (SELECT DISTINCT qid FROM retrieval_results) q LEFT JOIN per USING (qid))"""
_SENT_SOURCES = f"""
src AS (SELECT qid, final_rank AS source_no, chunk_id, text FROM rr),
ss AS (SELECT qid, source_no, chunk_id, i - 1 AS position, {_squash('s')} AS sentence FROM (
       SELECT qid, source_no, chunk_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT qid, source_no, chunk_id, {_sentences('text')} AS l FROM src)))"""
_ANSWERS = f"""
ans AS (SELECT qid, list_aggregate(list_transform({_sentences('answer')}, lambda s, i: s || ' [' || i || '] [' || ((i - 1) * 7 + 2) || '] [1]'), 'string_agg', ' ') AS answer FROM g WHERE answer <> '')"""
_MARKER = r"\[(\d{1,3})\]"


def _dots(name: str, left: str, right: str, on: str, columns: str) -> str:
    """Dot products of hashed vectors, joined by bucket."""
    return f"{name} AS (SELECT {columns}, sum(a.w * b.w) AS s FROM {left} a JOIN {right} b ON {on} AND a.bucket = b.bucket GROUP BY ALL)"


_GROUNDED = f"""
sid AS (SELECT qid, i - 1 AS sent_no, s AS sentence, qid || ':' || (i - 1) AS k FROM (SELECT qid, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
        SELECT qid, {_sentences(_squash("regexp_replace(answer, '" + _MARKER + "', ' ', 'g')"))} AS l FROM ans))),
cid AS (SELECT *, qid || ':' || source_no AS k FROM src),
sv AS (SELECT v.*, qid FROM {_hashed('sid', 'k', 'sentence')} v JOIN sid USING (k)),
cv AS (SELECT v.*, qid FROM {_hashed('cid', 'k', 'text')} v JOIN cid USING (k)),
{_dots('dots', 'sv', 'cv', 'a.qid = b.qid', 'a.k AS sk, b.k AS ck')},
sims AS (SELECT sid.qid, sid.sent_no, sid.sentence, cid.source_no, cid.chunk_id, round(coalesce(dots.s, 0.0), 9) AS sim
         FROM sid LEFT JOIN cid ON cid.qid = sid.qid LEFT JOIN dots ON dots.sk = sid.k AND dots.ck = cid.k),
best AS (SELECT qid, sent_no, sentence, sim, chunk_id FROM sims QUALIFY row_number() OVER (PARTITION BY qid, sent_no ORDER BY sim DESC, source_no) = 1),
sg AS (SELECT qid, sent_no, sentence, sim AS max_similarity, CASE WHEN sim >= 0.55 THEN chunk_id END AS supporting_chunk_id, sim >= 0.55 AS grounded FROM best)"""
_CITED = f"""
mk AS (SELECT qid, l, unnest(l) AS marker, generate_subscripts(l, 1) AS i FROM (SELECT qid, list_transform(regexp_extract_all(answer, '{_MARKER}', 1), lambda x: x::INT) AS l FROM ans)),
cit AS (SELECT a.qid, a.appearance, a.marker, src.chunk_id, src.chunk_id IS NOT NULL AS resolved
        FROM (SELECT qid, marker, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS appearance FROM mk WHERE list_position(l, marker) = i) a
        LEFT JOIN src ON src.qid = a.qid AND src.source_no = a.marker)"""
_DECLINED = "I don''t have enough information in the provided sources"
_EXTRACT = f"""
lng AS (SELECT *, qid || ':' || source_no || ':' || position AS k FROM ss WHERE length(sentence) >= 25),
ev AS (SELECT v.*, qid FROM {_hashed('lng', 'k', 'sentence')} v JOIN lng USING (k)), eq AS {_hashed('asked', 'qid', 'question')},
{_dots('ed', 'ev', 'eq', 'a.qid = b.qid', 'a.k AS k')},
sc AS (SELECT lng.*, round(coalesce(s, 0.0), 9) AS sim FROM lng LEFT JOIN ed USING (k)),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, source_no, position) <= 3),
ext AS (SELECT asked.qid, coalesce(string_agg(sentence || ' [' || source_no || ']', ' ' ORDER BY source_no, position), '{_DECLINED}.') AS answer FROM asked LEFT JOIN top USING (qid) GROUP BY asked.qid)"""
# Every query of the log, of the golden set and of the hits, and what they are refused for, of reranked results.
_EVERY = """
asked AS (SELECT qid, coalesce(l.query, g.question, '') AS question FROM (SELECT qid, max(query) AS query FROM retrieval_results WHERE qid IS NOT NULL GROUP BY qid) l
          FULL JOIN (SELECT qid, question FROM g) g USING (qid) FULL JOIN (SELECT DISTINCT qid FROM pair) p USING (qid)),"""
_DECIDED = f"""
dec AS (SELECT qid, n, top, CASE WHEN n IS NULL THEN 'no sources were retrieved' WHEN top < 0.3 THEN 'top confidence ' || format('{{:.3f}}', top) || ' below 0.30' END AS reason
        FROM asked LEFT JOIN (SELECT qid, count(*) AS n, max(rerank_score) AS top FROM rr GROUP BY qid) USING (qid)),
ans AS (SELECT ext.qid, answer FROM ext JOIN dec USING (qid) WHERE reason IS NULL)"""
_CHECKED = f"""
chk AS (SELECT ans.qid, contains(lower(answer), lower('{_DECLINED}')) AS declined, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged, coalesce(loose, 0) AS loose, coalesce(mean, 0.0) AS mean
        FROM ans LEFT JOIN (SELECT qid, count(*) AS n, count_if(NOT grounded) AS flagged, avg(max_similarity) AS mean FROM sg GROUP BY qid) s USING (qid)
        LEFT JOIN (SELECT qid, count(*) AS loose FROM cit WHERE NOT resolved GROUP BY qid) l USING (qid)),
grd AS (SELECT qid, declined OR (n > 0 AND flagged = 0 AND loose = 0) AS grounded, CASE WHEN declined THEN 0.0 ELSE round(mean, 9) END AS mean_similarity FROM chk)"""
_UUID5 = """(SELECT substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', (('0x' || substr(s, 17, 1))::INT % 4) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12)
   FROM (SELECT sha1(unhex('6f9619ff8b86d011b42d00c04fc964ff') || encode({name})) AS s))"""
_CHANGES = """
now AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN collection = 'notes' THEN ' ' ELSE '' END) AS content_hash FROM documents),
chg AS (SELECT now.doc_id, now.content_hash, CASE WHEN k.content_hash IS NULL THEN 'new' WHEN k.content_hash = now.content_hash THEN 'unchanged' ELSE 'changed' END AS status
        FROM now LEFT JOIN (SELECT doc_id, content_hash FROM documents WHERE ingested_at < TIMESTAMP '2026-04-01') k ON k.doc_id = now.doc_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_ALL_RERANKED = (_CORPUS, _GOLDEN, _HITS, _RRF, _RERANK.replace("\nasked AS (SELECT qid, question FROM g),", _EVERY))
_BLOCKS = f"""
blk AS (SELECT qid, string_agg('[' || source_no || '] (' || coalesce(nullif(CASE WHEN len(c.section_path) > 0 THEN array_to_string(c.section_path, ' > ') END, ''),
          nullif(coalesce(nullif({_strip("d.metadata['title']")}, ''), list_last(string_split(d.source_path, '/'))), ''), c.doc_id::VARCHAR) || ') ' || {_strip('src.text')}, chr(10) || chr(10) ORDER BY source_no) AS sources
        FROM src JOIN c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id GROUP BY qid)"""
_SOURCE_FLAGS = _FLAGS.replace("fused_rank AS rank, c.text, relevant_chunk_texts FROM fused JOIN g USING (qid) JOIN c USING (chunk_id) WHERE fused_rank <= 5", "source_no AS rank, src.text, relevant_chunk_texts FROM src JOIN g USING (qid)")
_PRECISION = """
prc AS (SELECT g.qid, round(coalesce(p, 0.0), 9) AS citation_precision FROM g LEFT JOIN (
        SELECT u.qid, avg(relevant::INT) AS p FROM (SELECT DISTINCT qid, chunk_id FROM cit WHERE resolved) u JOIN flags f ON f.qid = u.qid AND f.chunk_id = u.chunk_id GROUP BY u.qid) USING (qid))"""
_CACHE = """WITH cache AS (SELECT substr(sha256(qid), 1, 16) AS query_key, chunk_id, score AS rerank_score, logged_at AS used_at FROM (
        SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY logged_at DESC) AS n FROM (
        SELECT qid, chunk_id, logged_at, max(score) AS score FROM search_hits WHERE retriever = 'rerank' AND score IS NOT NULL AND NOT isnan(score) AND logged_at IS NOT NULL GROUP BY ALL)) WHERE n = 1)
"""
# Tokens with their places, from the lengths of tokens and of what parts them; then the windows over them.
_FIXED = f"""WITH d AS (SELECT doc_id, text, page_spans, coalesce(chunk_size, 512) AS size, coalesce(chunk_overlap, 64) AS overlap, regexp_extract_all(text, '[^{_WS[1:-1]}]+') AS t,
        string_split_regex(text, '[^{_WS[1:-1]}]+') AS gaps FROM documents LEFT JOIN collections ON collection = name WHERE text IS NOT NULL),
tok AS (SELECT doc_id, i, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(tok) AS n FROM (SELECT doc_id, unnest(t) AS tok, unnest(gaps[1:len(t)]) AS gap, generate_subscripts(t, 1) AS i FROM d)),
w AS (SELECT doc_id, text, page_spans, a + 1 AS first, least(a + size, len(t)) AS last FROM (SELECT *, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 ELSE 1 + greatest(0, ceil((len(t) - size) / (size - overlap)::DOUBLE)::BIGINT) END)) * (size - overlap) AS a FROM d)),
p AS (SELECT w.*, f.stop - f.n AS st, l.stop AS en FROM w JOIN tok f ON f.doc_id = w.doc_id AND f.i = w.first JOIN tok l ON l.doc_id = w.doc_id AND l.i = w.last),
z AS (SELECT *, list_filter(page_spans, lambda x: x IS NOT NULL AND x.start_char <= st AND st < x.end_char)[1] AS span FROM p)
SELECT doc_id::VARCHAR AS doc_id, st::INT AS start_char, en::INT AS end_char, substr(text, st::BIGINT + 1, (en - st)::BIGINT) AS text, (last - first + 1)::INT AS token_count, CASE WHEN coalesce(span.label, '') <> '' THEN [span.label] ELSE []::VARCHAR[] END AS section_path,
    span.page_number AS page_number, {_UUID5.format(name="doc_id::VARCHAR || chr(58) || st::BIGINT::VARCHAR")} AS chunk_id FROM z"""


_TO_RERANK = (_CORPUS, _GOLDEN, _HITS, _RRF, _RERANK)
_AVERAGES = "round(avg({f}recall), 9) AS recall, round(avg({f}precision), 9) AS precision, round(avg({f}hit), 9) AS hit, round(avg({f}rr), 9) AS rr, round(avg({f}ndcg), 9) AS ndcg"


def _level(level: str, value: str, where: str, group: str, negatives: bool) -> str:
    keep = "TRUE" if negatives else "category <> 'negative'"
    cols = ", ".join(f"coalesce(round(avg({m}) FILTER ({keep}), 9), 0.0) AS {m}" for m in ("recall", "precision", "hit", "rr", "ndcg"))
    n = "count_if(category <> 'negative')" if level == "difficulty" else "count(*)"
    return f"""SELECT '{level}' AS level, {value} AS value, {n} AS n, {cols},
      coalesce(round(avg(refused::INT) FILTER (category = 'negative'), 9), 0.0) AS refusal_accuracy,
      coalesce(round(avg(refused::INT) FILTER (category <> 'negative'), 9), 0.0) AS false_refusal, round(avg(refused::INT), 9) AS refused_rate
      FROM rows_ {where} {group}"""


def _hybrid(ok: str) -> str:
    """Dense and lexical lists of the golden questions over the chunks ``ok`` (all by default), fused."""
    return _with(_CORPUS, _GOLDEN, _BM25, _BM25_SCORES) + f""",
    {ok or "ok AS (SELECT chunk_id FROM c),"}
    qv AS {_hashed('g', 'qid', 'question')},
    cv AS {_hashed('c', 'chunk_id', 'text')},
    dot AS (SELECT qid, chunk_id, sum(qv.w * cv.w) AS s FROM qv JOIN cv USING (bucket) GROUP BY qid, chunk_id),
    den AS (SELECT q.qid, ok.chunk_id, round(coalesce(s, 0.0), 9) AS score FROM (SELECT DISTINCT qid FROM qv) q CROSS JOIN ok LEFT JOIN dot ON dot.qid = q.qid AND dot.chunk_id = ok.chunk_id),
    pair AS (
      SELECT *, 'dense' AS retriever, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM den QUALIFY rank <= 50
      UNION ALL
      SELECT lex.*, 'lexical' AS retriever, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM lex JOIN ok USING (chunk_id) WHERE score > 0 QUALIFY rank <= 50),
    {_RRF}
    """


SQL: dict[str, str] = {
    "bm25_stats": _with(_CORPUS, _BM25) + "SELECT term, df, round(idf, 9) AS idf FROM idf",
    "bm25_topk": _with(_CORPUS, _GOLDEN, _BM25, _BM25_SCORES)
    + "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM lex WHERE score > 0 QUALIFY rank <= 10",
    "dense_topk": """SELECT a.vec_id::VARCHAR AS qid, b.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id::VARCHAR) AS rank
        FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10""",
    "dense_filtered": """SELECT a.vec_id::VARCHAR AS qid, b.vec_id::VARCHAR AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id::VARCHAR) AS rank
        FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.label = 3 QUALIFY rank <= 10""",
    "metadata_filter": """SELECT DISTINCT c.chunk_id, c.doc_id FROM chunks c LEFT JOIN documents d USING (doc_id)
        WHERE coalesce(c.metadata['title'], d.metadata['title']) = 'Notes on the seasonal passage'""",
    "list_filter": """SELECT DISTINCT c.chunk_id, c.doc_id FROM chunks c LEFT JOIN documents d USING (doc_id)
        WHERE list_contains(string_split(coalesce(c.metadata['authors'], d.metadata['authors']), '; '), 'Vewo')""",
    "document_filter": _with(_CORPUS) + """SELECT doc_id, source_path, coalesce(n, 0) AS chunk_count, count(*) OVER () AS total FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id)
        WHERE list_contains(string_split(metadata['authors'], '; '), 'Vewo') ORDER BY doc_id LIMIT 50""",
    "latency_stages": """SELECT stage, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(mean, 0) AS mean, coalesce(max, 0) AS max, coalesce(n, 0) AS n
        FROM (SELECT unnest(['dense', 'lexical', 'fusion', 'rerank', 'retrieval', 'generation', 'grounding', 'total']) AS stage) LEFT JOIN (
        SELECT 'total' AS stage, l[round_even((len(l) - 1) * 0.5::DOUBLE, 0)::INT + 1] AS p50, l[round_even((len(l) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS p95,
        round(list_sum(l) / len(l), 6) AS mean, l[len(l)] AS max, len(l) AS n FROM (SELECT list(total_ms ORDER BY total_ms) AS l FROM retrieval_results WHERE total_ms IS NOT NULL)) USING (stage)""",
    "hash_embed": _with(_CORPUS) + f"SELECT chunk_id, bucket, round(w, 9) AS weight FROM {_hashed('c', 'chunk_id', 'text')}",
    "rrf": _with(_HITS, _RRF) + "SELECT qid, chunk_id, score, fused_rank, dense_rank, lexical_rank FROM fused",
    "weighted_fusion": _with(_HITS)
    + """SELECT qid, chunk_id, round(round(sum(CASE WHEN retriever = 'dense' THEN 0.7::DOUBLE ELSE 1 - 0.7::DOUBLE END * unit), 9), 6) AS score FROM (
        SELECT *, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END AS unit
        FROM pair WINDOW p AS (PARTITION BY qid, retriever)) GROUP BY qid, chunk_id""",
    "candidate_counts": _with(_HITS, _RRF) + "SELECT qid, retriever AS stage, count(*) AS n FROM pair GROUP BY ALL UNION ALL SELECT qid, 'fused', count(*) FROM fused GROUP BY ALL",
    "hybrid": _hybrid("") + "SELECT qid, chunk_id, score, fused_rank, dense_rank, lexical_rank FROM fused WHERE fused_rank <= 10",
    "hybrid_filtered": _hybrid("""
    cm AS (SELECT chunk_id, arg_max(metadata, ingested_at) AS m FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
    ok AS (SELECT c.chunk_id FROM c JOIN cm USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id
           WHERE coalesce(m['published'], d.metadata['published']) = (SELECT max(metadata['published']) FROM documents)),""") + "SELECT qid, chunk_id, score, fused_rank, dense_rank, lexical_rank FROM fused WHERE fused_rank <= 10",
    "debug_trail": _hybrid("") + ", " + _RERANK + """
    SELECT g.qid, coalesce(nd, 0) AS n_dense, coalesce(nl, 0) AS n_lexical, coalesce(nf, 0) AS n_fused, coalesce(nr, 0) AS n_reranked, results
    FROM g JOIN (SELECT qid, count_if(retriever = 'dense') AS nd, count_if(retriever = 'lexical') AS nl FROM pair GROUP BY qid) p USING (qid) JOIN (SELECT qid, count(*) AS nf FROM fused GROUP BY qid) f USING (qid)
    LEFT JOIN (SELECT qid, count(*) AS nr, list(chunk_id || ':' || rank_movement ORDER BY final_rank) AS results FROM rr GROUP BY qid) r USING (qid)""",
    "multi_query": _with(_CORPUS, _GOLDEN, _BM25)
    + f""", e AS (SELECT qid, max(expanded_queries) AS l FROM retrieval_results GROUP BY qid),
    va AS (SELECT qid, 0 AS v, question FROM g UNION ALL SELECT qid, i AS v, q AS question FROM (SELECT g.qid, g.question AS own, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM g JOIN e USING (qid)) WHERE q IS NOT NULL AND lower(q) <> lower(own) AND i <= 3),
    vk AS (SELECT *, qid || '|' || v AS k FROM va), qv AS {_hashed('vk', 'k', 'question')}, cv AS MATERIALIZED {_hashed('c', 'chunk_id', 'text')},
    dot AS (SELECT k, chunk_id, sum(qv.w * cv.w) AS s FROM qv JOIN cv USING (bucket) GROUP BY k, chunk_id),
    den AS (SELECT q.k, c.chunk_id, round(coalesce(s, 0.0), 9) AS score FROM (SELECT DISTINCT k FROM qv) q CROSS JOIN c LEFT JOIN dot ON dot.k = q.k AND dot.chunk_id = c.chunk_id QUALIFY row_number() OVER (PARTITION BY q.k ORDER BY score DESC, c.chunk_id) <= 50),
    post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(terms) AS term, len(terms) AS dl FROM tok) GROUP BY chunk_id, term),
    qt AS (SELECT k, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM vk),
    lex AS (SELECT k, chunk_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 9) AS score FROM qt JOIN idf USING (term) JOIN post USING (term), size GROUP BY k, chunk_id),
    both_ AS (SELECT k, chunk_id, 'dense' AS kind, row_number() OVER (PARTITION BY k ORDER BY score DESC, chunk_id) AS rank FROM den
      UNION ALL SELECT k, chunk_id, 'lexical', row_number() OVER (PARTITION BY k ORDER BY score DESC, chunk_id) AS rank FROM lex WHERE score > 0 QUALIFY rank <= 50),
    al AS (SELECT vk.qid, vk.v, both_.* FROM both_ JOIN vk USING (k)),
    fu AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(rank, v) FILTER (kind = 'dense') AS dense_rank, arg_min(rank, v) FILTER (kind = 'lexical') AS lexical_rank FROM al GROUP BY qid, chunk_id)
    SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS fused_rank, dense_rank, lexical_rank FROM fu QUALIFY fused_rank <= 10""",
    "rerank_overlap": _with(*_TO_RERANK) + "SELECT qid, chunk_id, fused_rank, rerank_score, final_rank, rank_movement FROM rr",
    "refusal": _with(_HITS, _REFUSAL) + "SELECT qid, reason IS NOT NULL AS refused, reason, confidence, usable_sources, threshold_applied FROM ref",
    "relevance": _with(_CORPUS, _GOLDEN, _HITS, _RRF, _FLAGS) + "SELECT qid, chunk_id, rank, relevant FROM flags",
    "retrieval_metrics": _with(_CORPUS, _GOLDEN, _HITS, _RRF, _FLAGS, _METRICS) + "SELECT * FROM m",
    "breakdowns": _with(_CORPUS, _GOLDEN, _HITS, _RRF, _FLAGS, _METRICS, _REFUSAL)
    + f""", rows_ AS (SELECT m.*, g.category, g.difficulty, coalesce(ref.reason IS NOT NULL, TRUE) AS refused FROM m JOIN g USING (qid)
        LEFT JOIN (SELECT qid AS q2, reason, TRUE AS known FROM ref) ref ON q2 = m.qid WHERE TRUE),
    fixed AS (SELECT * FROM rows_)
    {_level('all', 'NULL', '', '', False)} UNION ALL {_level('category', 'category', '', 'GROUP BY category', True)}
    UNION ALL {_level('difficulty', 'difficulty', '', "GROUP BY difficulty HAVING count_if(category <> 'negative') > 0", False)}""",
    "latency_percentiles": """SELECT run_id, l[round_even((len(l) - 1) * 0.5::DOUBLE, 0)::INT + 1] AS p50, l[round_even((len(l) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS p95,
        round(list_sum(l) / len(l), 6) AS mean, l[len(l)] AS max, len(l) AS n
        FROM (SELECT run_id, list(total_ms ORDER BY total_ms) AS l FROM retrieval_results WHERE total_ms IS NOT NULL GROUP BY run_id)""",
    "golden_counts": _with(_GOLDEN) + "SELECT category, difficulty, count(*) AS n FROM g GROUP BY ALL",
    "golden_validate": _with(_GOLDEN)
    + """, e AS (SELECT qid, relevant_doc_ids, unnest(relevant_chunk_texts) AS span, generate_subscripts(relevant_chunk_texts, 1) AS no FROM g WHERE coalesce(category, '') <> 'negative'),
    o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE list_contains(e.relevant_doc_ids, d.doc_id) AND contains(d.text, e.span))),
    f AS (SELECT qid, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, o.span)) AS found FROM o)
    SELECT qid, 'repeated qid' AS problem, 'failure' AS severity FROM golden_set QUALIFY row_number() OVER (PARTITION BY qid) > 1
    UNION ALL SELECT qid, 'negative with evidence', 'failure' FROM g WHERE category = 'negative' AND (coalesce(len(relevant_chunk_texts), 0) > 0 OR coalesce(len(relevant_doc_ids), 0) > 0)
    UNION ALL SELECT qid, 'answerable without span', 'failure' FROM g WHERE coalesce(category, '') <> 'negative' AND coalesce(len(relevant_chunk_texts), 0) < 1
    UNION ALL SELECT DISTINCT qid, 'unknown document', 'failure' FROM (SELECT qid, unnest(relevant_doc_ids) AS doc_id FROM g) x WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT qid, CASE WHEN bool_and(found) THEN 'span in another document' ELSE 'span not found' END, CASE WHEN bool_and(found) THEN 'warning' ELSE 'failure' END FROM f GROUP BY qid
    UNION ALL SELECT '*', 'too few negatives', 'failure' FROM (SELECT count_if(category = 'negative') AS n FROM g) WHERE n < 8""",
    "sentences": f"SELECT doc_id, i - 1 AS sent_no, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents))",
    "extractive": _with(*_TO_RERANK, _SENT_SOURCES, _EXTRACT) + "SELECT qid, answer FROM ext",
    "extractive_all": _with(*_ALL_RERANKED, _SENT_SOURCES, _EXTRACT) + "SELECT qid, answer FROM ext",
    "citations": _with(*_TO_RERANK, _SENT_SOURCES, _ANSWERS, _CITED) + "SELECT qid, marker, appearance, chunk_id, resolved FROM cit",
    "sentence_grounding": _with(*_TO_RERANK, _SENT_SOURCES, _ANSWERS, _GROUNDED) + "SELECT * FROM sg",
    "grounding": _with(*_TO_RERANK, _SENT_SOURCES, _ANSWERS, _GROUNDED, _CITED)
    + """SELECT ans.qid, coalesce(n, 0) > 0 AND coalesce(flagged, 0) = 0 AND coalesce(loose, 0) = 0 AS grounded, coalesce(n, 0) AS n_sentences, coalesce(flagged, 0) AS n_flagged,
        coalesce(loose, 0) AS n_unresolved, round(coalesce(mean, 0.0), 9) AS mean_similarity
    FROM ans LEFT JOIN (SELECT qid, count(*) AS n, count_if(NOT grounded) AS flagged, avg(max_similarity) AS mean FROM sg GROUP BY qid) s USING (qid)
    LEFT JOIN (SELECT qid, count(*) AS loose FROM cit WHERE NOT resolved GROUP BY qid) l USING (qid)""",
    "prompts": _with(*_TO_RERANK, _SENT_SOURCES, _BLOCKS) + """SELECT asked.qid, coalesce(sources, '(no sources retrieved)') AS sources, TRUE AS rules,
        chr(10) || chr(10) || 'Question: ' || """ + _strip("question") + """ || chr(10) || chr(10) || 'Answer:' AS rest FROM asked LEFT JOIN blk USING (qid)""",
    "prompts_all": _with(*_ALL_RERANKED, _SENT_SOURCES, _BLOCKS) + "SELECT asked.qid, coalesce(sources, '(no sources retrieved)') AS sources FROM asked LEFT JOIN blk USING (qid)",
    "answers": _with(*_ALL_RERANKED, _SENT_SOURCES, _EXTRACT, _DECIDED, _GROUNDED, _CITED, _CHECKED)
    + f"""SELECT dec.qid, reason IS NOT NULL AS refused, CASE WHEN reason IS NOT NULL THEN '{_DECLINED} to answer that (' || reason || ').' ELSE answer END AS answer,
        CASE WHEN reason IS NOT NULL THEN 'refused' ELSE 'extractive' END AS answer_type, coalesce(grounded, TRUE) AS grounded, coalesce(mean_similarity, 0.0) AS mean_similarity,
        round(coalesce(top, 0.0), 9) AS confidence, n IS NOT NULL AS threshold_applied, coalesce(citations, []::VARCHAR[]) AS citations, coalesce(sources, []::VARCHAR[]) AS sources
    FROM dec LEFT JOIN ans USING (qid) LEFT JOIN grd USING (qid)
    LEFT JOIN (SELECT qid, list(marker || ':' || coalesce(chunk_id, '?') ORDER BY appearance) AS citations FROM cit GROUP BY qid) ci USING (qid)
    LEFT JOIN (SELECT qid, list(chunk_id ORDER BY final_rank) AS sources FROM rr GROUP BY qid) so USING (qid)""",
    "citation_precision": _with(*_TO_RERANK, _SENT_SOURCES, _EXTRACT, "\nans AS (SELECT * FROM ext)", _CITED, _SOURCE_FLAGS, _PRECISION) + "SELECT qid, citation_precision FROM prc",
    "evaluation": _with(*_TO_RERANK, _SENT_SOURCES, _EXTRACT, _DECIDED, _GROUNDED, _CITED, _CHECKED, _SOURCE_FLAGS, _METRICS, _PRECISION)
    + f""", gg AS (SELECT qid, answer FROM g WHERE {_strip("coalesce(answer, '')")} <> ''), aa AS (SELECT qid, answer FROM ans WHERE {_strip('answer')} <> ''),
    av AS {_hashed('aa', 'qid', 'answer')}, gv AS {_hashed('gg', 'qid', 'answer')}, {_dots('ad', 'av', 'gv', 'a.qid = b.qid', 'a.qid AS qid')},
    smy AS (SELECT aa.qid, round(coalesce(s, 0.0), 9) AS sim FROM aa JOIN gg USING (qid) LEFT JOIN ad USING (qid)),
    r AS (SELECT m.*, g.category = 'negative' AS neg, reason IS NOT NULL AS refused, coalesce(grounded, TRUE) AS grounded, citation_precision, sim
          FROM m JOIN g USING (qid) JOIN dec USING (qid) LEFT JOIN grd USING (qid) JOIN prc USING (qid) LEFT JOIN smy USING (qid))
    SELECT count(*) AS n, """
    + ", ".join(f"coalesce(round(avg({x}) FILTER (NOT coalesce(neg, FALSE)), 9), 0.0) AS {y}" for x, y in [*((x, x) for x in ("recall", "precision", "hit", "rr", "ndcg", "citation_precision")), ("sim", "answer_similarity"), ("grounded::INT", "grounded_rate"), ("refused::INT", "false_refusal_rate")])
    + ", coalesce(round(avg(refused::INT) FILTER (neg), 9), 0.0) AS refusal_accuracy FROM r",
    "rerank_all": _with(*_ALL_RERANKED) + "SELECT qid, chunk_id, fused_rank, rerank_score, final_rank, rank_movement FROM rr",
    "score_cache": _CACHE + "SELECT * FROM cache ORDER BY used_at DESC, query_key, chunk_id LIMIT 1000",
    "score_cache_default": _CACHE + "SELECT * FROM cache ORDER BY used_at DESC, query_key, chunk_id LIMIT 10000",
    "cache_report": _CACHE + """SELECT count(k.query_key) AS hits, count_if(k.query_key IS NULL) AS misses, round(count(k.query_key) / count(*)::DOUBLE, 9) AS hit_rate
        FROM (SELECT substr(sha256(qid), 1, 16) AS query_key, chunk_id FROM search_hits WHERE retriever = 'rerank') h
        LEFT JOIN (SELECT * FROM cache ORDER BY used_at DESC, query_key, chunk_id LIMIT 1000) k ON k.query_key = h.query_key AND k.chunk_id = h.chunk_id""",
    "fixed_chunks": _FIXED,
    "semantic_groups": f"""WITH sen AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS id, doc_id, i - 1 AS sent_no, s AS sentence FROM (
        SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_sentences('text')} AS l FROM documents))),
    v AS MATERIALIZED {_hashed('sen', 'id', 'sentence')},
    sim AS (SELECT x.id, sum(x.w * y.w) AS s FROM v x JOIN v y ON y.id = x.id - 1 AND y.bucket = x.bucket GROUP BY x.id),
    d AS (SELECT doc_id, sent_no, CASE WHEN sent_no > 0 THEN round(1.0 - coalesce(s, 0.0), 9) + 0.0 END AS distance FROM sen LEFT JOIN sim USING (id)),
    q AS (SELECT doc_id, round(quantile_cont(distance, 0.95), 9) AS limit_ FROM d GROUP BY doc_id)
    SELECT doc_id, sent_no, round(distance, 6) AS distance, sum(CASE WHEN distance > limit_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_no ROWS UNBOUNDED PRECEDING) AS group_no FROM d JOIN q USING (doc_id)""",
    "approximate_tokens": rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WS[1:-1]}]')) AS n_tokens FROM documents",
    "chunk_ids": f"SELECT DISTINCT doc_id, start_char, {_UUID5.format(name='doc_id::VARCHAR || chr(58) || start_char::VARCHAR')} AS chunk_id FROM chunks",
    "fingerprints": "SELECT collection, sha256(string_agg(chunk_id || chr(0), '' ORDER BY chunk_id)) AS fingerprint FROM (SELECT DISTINCT collection, chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY collection",
    "document_titles": f"SELECT doc_id, coalesce(nullif({_strip("metadata['title']")}, ''), list_last(string_split(source_path, '/'))) AS title FROM documents",
    "change_detection": _with(_CHANGES) + "SELECT * FROM chg",
    "upsert_state": _with(_CORPUS) + f"""SELECT chunk_id, doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE collection = 'notes')
        UNION ALL SELECT {_UUID5.format(name="doc_id::VARCHAR || ':0'")} AS chunk_id, doc_id FROM documents WHERE collection = 'notes'""",
    "delete_state": _with(_CORPUS) + "SELECT chunk_id, doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE collection = 'scans')",
    "list_documents": _with(_CORPUS) + "SELECT doc_id, source_path, coalesce(n, 0) AS chunk_count, count(*) OVER () AS total FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id) ORDER BY doc_id LIMIT 50 OFFSET 100",
    "count_chunks": _with(_CORPUS) + "SELECT collection, count(*) AS n_chunks FROM c GROUP BY collection",
    "ingest_summary": _with(_CORPUS, _CHANGES)
    + """, s AS (SELECT chg.doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'failed' ELSE status END AS status, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no text: ' || source_path END AS error
        FROM chg JOIN documents USING (doc_id)), p AS (SELECT doc_id, count(*) AS n, sum(token_count) AS t FROM c GROUP BY doc_id)
    SELECT count(*) AS docs_seen, count_if(status IN ('new', 'changed')) AS docs_changed, count_if(status = 'unchanged') AS docs_unchanged, count_if(status = 'failed') AS docs_failed,
        coalesce(sum(n) FILTER (status IN ('new', 'changed')), 0)::BIGINT AS chunks_created, coalesce(sum(n) FILTER (status = 'unchanged'), 0)::BIGINT AS chunks_skipped,
        coalesce(sum(t) FILTER (status IN ('new', 'changed')), 0)::BIGINT AS tokens_embedded, list(error ORDER BY error) FILTER (error IS NOT NULL) AS errors FROM s LEFT JOIN p USING (doc_id)""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "event_sessions": """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM (
        SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, s""",
}
