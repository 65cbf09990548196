"""DuckDB SQL equal to the catalogue's queries, written independently of their plans."""

from __future__ import annotations

from quern.operators import evaluation
from quern.operators.lexical import STOPWORDS

EFF = "CASE WHEN trust_tier<=0 AND status='active' THEN 'quarantined' ELSE status END"
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

NORMAL = rf"regexp_replace(replace(replace(nfc_normalize(content), chr(13)||chr(10), chr(10)), chr(13), chr(10)), '\A{WS}+|{WS}+\z', '', 'g')"

# The store after all deliveries: two windows over the deliveries of each group.
STATE = """
w AS (SELECT *, concat_ws('|', scope_key, kind, content_hash) AS g FROM memory_records),
a AS (SELECT *, max(trust_tier) OVER (PARTITION BY g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
             first_value(id) OVER (PARTITION BY g, trust_tier ORDER BY seq) AS owner FROM w),
acc AS (SELECT * FROM a WHERE prev IS NULL OR trust_tier > prev OR (trust_tier = prev AND id = owner)),
st AS (SELECT g, max(seq) AS seq, max(proof_count) AS proof FROM acc GROUP BY g),
cur AS (SELECT m.* REPLACE (st.proof AS proof_count) FROM w m JOIN st ON m.seq = st.seq)"""

STOP = "(" + ",".join(f"'{w}'" for w in STOPWORDS) + ")"
# Marks other than accents end a word.
TOK = r"regexp_extract_all(strip_accents(regexp_replace(lower({}), '[^\P{{Mn}}\x{{300}}-\x{{331}}]', ' ', 'g')), '[\p{{L}}\p{{N}}]+')"
ETOK = r"list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN " + STOP + ")"


def _bm25(docs: str, corpus: str, k: int, k1: float = 1.2, tok: str = TOK, idf: str = "greatest(ln((n-df+0.5)/(df+0.5)),1e-6)", qtok: str | None = None, qw: str = "1", where: str = "true") -> str:
    """CTEs from postings to a ranked list ``lex`` (qid, id, score, rank)."""
    qtok = qtok or "list_distinct(" + tok.format("query_text") + ")"
    return f"""
tk AS (SELECT id, {tok.format('content')} AS tw FROM {corpus}),
st2 AS (SELECT count(*) AS n, avg(len(tw)) AS al FROM tk),
po AS (SELECT id, term, count(*) AS tf, max(l) AS l FROM (SELECT id, len(tw) AS l, unnest(tw) AS term FROM tk) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({qtok}) AS term FROM eval_queries) GROUP BY qid, term),
sc AS (SELECT qid, id, round(sum({qw}*{idf}*(tf*{k1 + 1})/(tf+{k1}*(0.25+0.75*l/al))),9) AS score
       FROM po JOIN qt USING (term) JOIN dfs USING (term), st2 WHERE id IN (SELECT id FROM {docs}) GROUP BY qid, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE {where}) WHERE rank <= {k})"""


STUB = r"""
qs AS (SELECT qid, unnest(list_filter(regexp_split_to_array(lower(query_text), '\s+'), lambda x: x<>'')) AS tok FROM eval_queries),
hs AS (SELECT qid, ('0x' || substr(md5(tok),1,8))::BIGINT AS h FROM qs),
raw AS (SELECT qid, h % 64 AS i, sum(CASE WHEN (h >> 8) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM hs GROUP BY qid, h % 64),
nr AS (SELECT qid, sqrt(sum(v*v)) AS nn FROM raw GROUP BY qid),
emb AS (SELECT q.qid, r.i, coalesce(raw.v, 0)/CASE WHEN coalesce(nn,0)=0 THEN 1 ELSE nn END AS x
        FROM eval_queries q CROSS JOIN range(64) r(i) LEFT JOIN raw ON raw.qid=q.qid AND raw.i=r.i LEFT JOIN nr ON nr.qid=q.qid)"""


def _vec(k: int) -> str:
    return f"""
qv AS (SELECT qid, list(x ORDER BY i) AS v FROM emb GROUP BY qid),
rv AS (SELECT id, embedding AS e FROM cur WHERE embedder_name='stub-hash' AND embedding IS NOT NULL AND len(embedding)=64
       AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0),
cs AS (SELECT qid, id, round(coalesce(list_inner_product(e, v)/nullif(sqrt(list_inner_product(e,e))*sqrt(list_inner_product(v,v)),0),0),9)+0.0 AS score FROM qv, rv),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs) WHERE rank <= {k})"""


def _fuse(pool: int, name: str = "fu", v: str = "vec", x: str = "lex") -> str:
    return f"""
{name}0 AS (SELECT coalesce(v.qid,l.qid) AS qid, coalesce(v.id,l.id) AS id, coalesce(1.0::DOUBLE/(60+v.rank),0)+coalesce(1.0::DOUBLE/(60+l.rank),0) AS rrf,
        coalesce(v.rank, 1000000+l.rank) AS o FROM (SELECT * FROM {v} WHERE rank<={pool}) v FULL JOIN (SELECT * FROM {x} WHERE rank<={pool}) l ON v.qid=l.qid AND v.id=l.id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, o) AS rank FROM {name}0) WHERE rank <= {pool})"""


def _surface(k: int, name: str, src: str) -> str:
    return f"""
{name} AS (SELECT qid, id, rank FROM (SELECT qid, f.id, row_number() OVER (PARTITION BY qid ORDER BY f.rank) AS rank
        FROM {src} f JOIN cur c ON c.id=f.id WHERE {EFF}='active' AND trust_tier>0) WHERE rank <= {k})"""


def _metrics(name: str, run: str, k: int = 5) -> str:
    return f"""
{name} AS (
 WITH y AS (SELECT qid, record_id AS id, max(grade) AS grade FROM eval_labels GROUP BY ALL),
 ng AS (SELECT qid, count(*) AS n FROM y WHERE grade>=1 GROUP BY qid),
 idl AS (SELECT qid, sum((pow(2,grade)-1)/log2(r+1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM y WHERE grade>0) WHERE r<={k} GROUP BY qid),
 j AS (SELECT r.qid, r.rank, coalesce(y.grade,0) AS grade, CASE WHEN coalesce(y.grade,0)>=1 THEN 1 ELSE 0 END AS rel FROM {run} r LEFT JOIN y ON y.qid=r.qid AND y.id=r.id),
 jj AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS found FROM j),
 m AS (SELECT qid, sum(CASE WHEN rank<={k} THEN rel ELSE 0 END) AS hits, min(CASE WHEN rel=1 THEN rank END) AS fr,
       sum(CASE WHEN rel=1 THEN found*1.0/rank ELSE 0 END) AS ap, sum(CASE WHEN rank<={k} THEN (pow(2,grade)-1)/log2(rank+1) ELSE 0 END) AS dcg FROM jj GROUP BY qid)
 SELECT q.qid, round(coalesce(hits::DOUBLE/n,0),9) AS recall, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(1.0/fr,0) END,9)::DOUBLE AS reciprocal_rank,
   (CASE WHEN n IS NOT NULL AND hits>0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_rate, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(hits/{k}.0,0) END,9)::DOUBLE AS precision,
   round(coalesce(ap::DOUBLE/n,0),9) AS average_precision, round(CASE WHEN n IS NULL THEN 0 ELSE coalesce(dcg/idcg,0) END,9)::DOUBLE AS ndcg
 FROM eval_queries q LEFT JOIN m USING (qid) LEFT JOIN ng USING (qid) LEFT JOIN idl USING (qid))"""


MEAN = ", ".join(f"round(avg({c}),9) AS {c}" for c in ("recall", "reciprocal_rank", "hit_rate", "precision", "average_precision", "ndcg"))


def _feed(where: str, order: str, n: int, frm: str = "cur") -> str:
    return f"WITH {STATE} SELECT scope_key, rank, id FROM (SELECT scope_key, id, row_number() OVER (PARTITION BY scope_key ORDER BY {order})::INT AS rank FROM {frm} WHERE {where}) WHERE rank <= {n}"


RULES = "kind='directive' AND " + EFF + "='active' AND trust_tier>=2"
MAJORS = EFF + "='active' AND trust_tier>=2 AND id IN (SELECT record_id FROM record_metadata WHERE meta_key='board' AND meta_value='{}')"
RECENT = EFF + "='active' AND trust_tier>=1"
LEGS = f"WITH {STATE}, {STUB}, {_vec(60)}, {_bm25('cur', 'cur', 60)}, {_fuse(60)}"
LEGS200 = f"WITH {STATE}, {STUB}, {_vec(200)}, {_bm25('cur', 'cur', 200)}"
ENTRIES = "(SELECT DISTINCT ts, call_id, substr(query_text,1,200) AS query_text, ids[1:20] AS ids FROM recall_ledger WHERE len(ids)>0)"
TOP1 = f"WITH {STATE}, {_bm25('cur', 'cur', 1)}, t AS (SELECT q.qid, q.control, lex.score FROM lex JOIN eval_queries q USING (qid))"
ACTIVE2 = f"(SELECT * FROM cur WHERE {EFF}='active' AND trust_tier>=2)"
LENGTH = "sqrt(list_sum(list_transform(embedding, lambda x: x*x)))"


def sql() -> dict[str, str]:
    """Query name to SQL."""
    pools = " UNION ALL ".join(f"SELECT {p} AS pool, count(*) AS n, {MEAN} FROM m{p}" for p in (30, 50, 100, 200))
    pool_ctes = ", ".join(f"{_fuse(p, f'fp{p}')}, {_surface(5, f'sp{p}', f'fp{p}')}, {_metrics(f'm{p}', f'sp{p}')}" for p in (30, 50, 100, 200))
    hybrid = f"{LEGS}, {_surface(10, 'su', 'fu')}, {_metrics('mh', 'su')}"
    legs = f"{hybrid}, {_surface(10, 'sv', 'vec')}, {_metrics('mv', 'sv')}, {_surface(10, 'sl', 'lex')}, {_metrics('ml', 'sl')}"
    return {
        "store_state": f"WITH {STATE} SELECT scope_key, kind, content_hash, id, trust_tier, proof_count, seq FROM cur",
        "strict_add_conflicts": """SELECT 'id' AS what, id AS value, count(*) AS n FROM memory_records GROUP BY id HAVING count(*)>1
            UNION ALL SELECT 'key', concat_ws('|', scope_key, kind, content_hash), count(*) FROM memory_records GROUP BY scope_key, kind, content_hash HAVING count(*)>1""",
        "usage_bump": f"""WITH c AS (SELECT id, count(*) AS n FROM (SELECT unnest(list_distinct(ids)) AS id FROM {ENTRIES}) GROUP BY id)
            SELECT seq, m.id, proof_count + CASE WHEN {EFF}<>'quarantined' THEN coalesce(c.n,0) ELSE 0 END AS proof_count FROM memory_records m LEFT JOIN c ON c.id=m.id""",
        "delete_scoped": """WITH big AS (SELECT scope_key FROM memory_records GROUP BY 1 ORDER BY count(*) DESC, scope_key LIMIT 1)
            SELECT scope_key, count(*) AS n FROM memory_records m WHERE NOT (scope_key=(SELECT scope_key FROM big) AND id IN (SELECT id FROM memory_records WHERE status='superseded')) GROUP BY 1""",
        "resolve_pending": f"""WITH o AS (SELECT DISTINCT id FROM memory_records WHERE {MAJORS.format('pending')}),
            x AS (SELECT scope_key, CASE WHEN id IN (SELECT id FROM o) AND {EFF}='active' THEN 'superseded' ELSE status END AS s FROM memory_records)
            SELECT scope_key, s AS status, count(*) AS n FROM x GROUP BY ALL""",
        "carry_forward": """WITH o AS (SELECT id, arg_max(struct_pack(n:=embedder_name), seq).n AS n FROM memory_records WHERE embedding IS NOT NULL GROUP BY id)
            SELECT CASE WHEN m.embedding IS NULL AND o.id IS NOT NULL THEN o.n ELSE m.embedder_name END AS embedder_name, count(*) AS n,
            count(CASE WHEN m.embedding IS NOT NULL OR o.id IS NOT NULL THEN 1 END) AS n_vectors FROM memory_records m LEFT JOIN o ON o.id=m.id GROUP BY 1""",
        "count_by_status": f"SELECT scope_key, {EFF} AS effective_status, count(*) AS n FROM memory_records GROUP BY ALL",
        "count_by_kind": f"SELECT scope_key, kind, count(*) AS n, count(CASE WHEN {EFF}='active' AND trust_tier>0 THEN 1 END) AS n_recallable FROM memory_records GROUP BY ROLLUP (scope_key, kind)",
        "scope_census": f"SELECT scope_key, count(*) AS n FROM memory_records WHERE {EFF}='active' GROUP BY 1",
        "count_by_source": f"SELECT scope_key, prov_source_uri, count(*) AS n FROM memory_records WHERE {EFF}='active' GROUP BY ALL",
        "newest": _feed("true", "created_at DESC, id DESC", 10),
        "recent_feed": _feed(RECENT, "created_at DESC, id DESC", 10),
        "active_directives": _feed(RULES, "created_at, id", 5),
        "board_entries": _feed(MAJORS.format("major"), "created_at, id", 10),
        "pending_open": f"WITH {STATE} SELECT scope_key, count(*) AS n FROM cur WHERE {MAJORS.format('pending')} GROUP BY 1",
        "board_snapshot": f"WITH {STATE} "
        + " UNION ALL ".join(
            f"SELECT '{leg}' AS leg, scope_key, rank, id FROM (SELECT scope_key, id, row_number() OVER (PARTITION BY scope_key ORDER BY {o})::INT AS rank FROM cur WHERE {c}) WHERE rank<={n}"
            for leg, c, o, n in (("rules", RULES, "created_at, id", 5), ("majors", MAJORS.format("major"), "created_at, id", 10), ("recent", RECENT, "created_at DESC, id DESC", 10))
        ),
        "metadata_typed_decode": r"""SELECT record_id, meta_key, vtype, CASE WHEN vtype='str' THEN meta_value END AS str_value,
            CASE WHEN vtype='int' AND regexp_full_match(meta_value,'[+-]?[0-9]{1,18}') THEN try_cast(meta_value AS BIGINT)::VARCHAR END AS int_value,
            CASE WHEN vtype='float' AND regexp_full_match(meta_value,'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?') THEN try_cast(meta_value AS DOUBLE) END AS float_value,
            CASE WHEN vtype='bool' AND lower(meta_value) IN ('1','true') THEN 'true' WHEN vtype='bool' AND lower(meta_value) IN ('0','false') THEN 'false' END AS bool_value
            FROM (SELECT DISTINCT * FROM record_metadata)""",
        "record_ids": """WITH x AS (SELECT seq, id, 'rk_'||substr(sha256(scope_key||chr(0)||prov_source_uri||chr(0)||kind||chr(0)||content_hash),1,24) AS computed_id FROM memory_records)
            SELECT seq, id, computed_id, id IS NOT DISTINCT FROM computed_id AS is_same FROM x""",
        "tamper_check": rf"""WITH x AS (SELECT seq, id, content_hash, sha256(regexp_replace(replace(replace(nfc_normalize(content), chr(13)||chr(10), chr(10)), chr(13), chr(10)), '\A{WS}+|{WS}+\z', '', 'g')) AS computed_hash FROM memory_records)
            SELECT seq, id, computed_hash FROM x WHERE content_hash IS DISTINCT FROM computed_hash""",
        "dedup_by_content": "SELECT scope_key, content_hash, arg_min(id, seq) AS id, count(*) AS n FROM memory_records GROUP BY ALL",
        "largest_scopes": f"SELECT scope_key, count(*) AS n FROM memory_records WHERE {EFF}='active' GROUP BY 1 ORDER BY n DESC, scope_key LIMIT 5",
        "scope_leak_check": f"""WITH {STATE}, {STUB}, u AS (SELECT id, project, embedding AS e FROM cur WHERE embedder_name='stub-hash' AND embedding IS NOT NULL AND len(embedding)=64
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0),
            c AS (SELECT q.qid, count(u.id) AS k FROM eval_queries q JOIN u ON u.project=q.project GROUP BY q.qid)
            SELECT qid, least(k,10)::BIGINT AS n_hits, 0::BIGINT AS n_foreign FROM c""",
        "run_fingerprints": f"WITH {STATE}, {_bm25('cur', 'cur', 10)} SELECT qid, sha256(string_agg(rank::VARCHAR||':'||id||':'||round(score*1000000)::BIGINT::VARCHAR, '|' ORDER BY rank)) AS fingerprint FROM lex GROUP BY qid",
        "first_gold_rank": f"WITH {STATE}, {_bm25('cur', 'cur', 200)} SELECT qid, min(rank)::INT AS first_rank FROM lex JOIN (SELECT DISTINCT qid, record_id AS id FROM eval_labels WHERE grade>=1) USING (qid, id) GROUP BY qid",
        "rerank_overlap": f"""WITH {STATE}, {_bm25('cur', 'cur', 30)},
            s AS (SELECT lex.qid, lex.id, lex.rank AS r, round(len(list_intersect(list_distinct({TOK.format('query_text')}), {TOK.format('content')}))::DOUBLE/len(list_distinct({TOK.format('query_text')})),9) AS rerank_score
              FROM lex JOIN eval_queries USING (qid) JOIN cur ON cur.id=lex.id)
            SELECT qid, id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, r)::INT AS rank FROM s) WHERE rank<=5""",
        "derived_from_edges": "SELECT DISTINCT id, (i-1)::INT AS position, derived_from[i] AS target_id FROM memory_records, unnest(range(1, len(derived_from)+1)) t(i)",
        "dangling_links": "SELECT DISTINCT record_id, target_id, link_type FROM record_links WHERE target_id NOT IN (SELECT id FROM memory_records)",
        "embedder_states": """SELECT m.scope_key, CASE WHEN i.embedder_name IS NULL OR m.embedder_name IS NULL THEN 'unknown'
            WHEN m.embedder_name=i.embedder_name AND m.embedder_dim IS NOT DISTINCT FROM i.embedder_dim THEN 'match' ELSE 'mismatch' END AS state, count(*) AS n
            FROM memory_records m LEFT JOIN embedder_identity i USING (scope_key) GROUP BY ALL""",
        "summary_eligible": f"SELECT scope_key, count(*) AS n, min(trust_tier) AS summary_trust FROM memory_records WHERE {EFF}<>'quarantined' AND trust_tier>=1 GROUP BY 1",
        "vector_topk": """WITH s AS (SELECT q.vec_id::VARCHAR AS qid, r.vec_id::VARCHAR AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]),9)+0.0 AS score
            FROM embeddings q, embeddings r WHERE q.vec_id%50=0)
            SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank<=10""",
        "vector_topk_filtered": f"""WITH {STATE}, u AS (SELECT * FROM cur WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0),
            s AS (SELECT q.id AS qid, r.id, round(coalesce(list_inner_product(q.embedding,r.embedding)/nullif(sqrt(list_inner_product(q.embedding,q.embedding))*sqrt(list_inner_product(r.embedding,r.embedding)),0),0),9)+0.0 AS score
             FROM (SELECT * FROM u WHERE seq%50=0) q JOIN (SELECT * FROM u WHERE {EFF}='active' AND trust_tier>=2) r
             ON concat_ws('|',q.embedder_name,q.kind)=concat_ws('|',r.embedder_name,r.kind) AND len(q.embedding)=len(r.embedding))
            SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank<=10""",
        "vector_topk_kind": f"""WITH {STATE}, u AS (SELECT * FROM cur WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0),
            s AS (SELECT q.id AS qid, r.id, round(coalesce(list_inner_product(q.embedding,r.embedding)/nullif(sqrt(list_inner_product(q.embedding,q.embedding))*sqrt(list_inner_product(r.embedding,r.embedding)),0),0),9)+0.0 AS score
             FROM (SELECT * FROM u WHERE seq%50=0) q JOIN (SELECT * FROM u WHERE kind='observation') r ON coalesce(q.embedder_name,'')=coalesce(r.embedder_name,'') AND len(q.embedding)=len(r.embedding))
            SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank<=10""",
        "vector_zero_and_dim_skip": f"""WITH u AS (SELECT seq::VARCHAR AS id, embedding FROM memory_records WHERE embedding IS NOT NULL AND len(embedding)>0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))=0
              AND ({LENGTH}=0 OR len(embedding)<>embedder_dim OR embedder_dim IS NULL)),
            s AS (SELECT q.id AS qid, r.id, round(coalesce(list_inner_product(q.embedding,r.embedding)/nullif(sqrt(list_inner_product(q.embedding,q.embedding))*sqrt(list_inner_product(r.embedding,r.embedding)),0),0),9)+0.0 AS score
             FROM u q JOIN u r ON len(q.embedding)=len(r.embedding))
            SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank<=10""",
        "links_to_hidden": f"SELECT DISTINCT record_id, target_id, link_type FROM record_links WHERE target_id NOT IN (SELECT id FROM memory_records WHERE {EFF}='active' AND trust_tier>0)",
        "hybrid_verified": f"""{LEGS}, ok AS (SELECT id FROM cur WHERE {EFF}='active' AND trust_tier>0 AND content_hash = sha256({NORMAL}))
            SELECT qid, id, rank FROM (SELECT qid, f.id, row_number() OVER (PARTITION BY qid ORDER BY f.rank)::INT AS rank FROM fu f JOIN ok USING (id)) WHERE rank<=10""",
        "resampling_tests": f"""{legs}, d AS (SELECT qid, metric, round(a.v-b.v,9) AS d FROM (UNPIVOT ml ON recall, reciprocal_rank, hit_rate, precision, average_precision, ndcg INTO NAME metric VALUE v) a
              JOIN (UNPIVOT mv ON recall, reciprocal_rank, hit_rate, precision, average_precision, ndcg INTO NAME metric VALUE v) b USING (qid, metric)),
            h AS (SELECT qid, r, md5(qid||':'||r::VARCHAR) AS h FROM eval_queries, range(1,1001) t(r)),
            dr AS (SELECT qid, r, len(list_filter({list(evaluation.POISSON)}, lambda x: ('0x'||substr(h,1,8))::BIGINT/4294967296.0::DOUBLE >= x)) AS w, CASE WHEN substr(h,9,1)>='8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM h),
            sm AS (SELECT metric, r, sum(w*d)/nullif(sum(w),0) AS m, sum(s*d)/count(*) AS f FROM d JOIN dr USING (qid) GROUP BY metric, r),
            se AS (SELECT metric, count(*) AS n, avg(d) AS seen, count(CASE WHEN d>0 THEN 1 END) AS w, count(CASE WHEN d<0 THEN 1 END) AS l FROM d GROUP BY metric),
            k AS (SELECT metric, n, seen, w, l, quantile_cont(m,0.025) AS lo, quantile_cont(m,0.975) AS hi, count(CASE WHEN abs(f)>=abs(seen)-1e-12 THEN 1 END) AS hits FROM sm JOIN se USING (metric) GROUP BY ALL)
            SELECT metric, n, round(seen,9) AS mean_diff, round(lo,9) AS lo, round(hi,9) AS hi,
              round(CASE WHEN w+l=0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2*list_sum(list_transform(range(0, least(w,l)+1), lambda i: exp(lgamma(w+l+1)-lgamma(i+1)-lgamma(w+l-i+1)-(w+l)*ln(2.0::DOUBLE))))) END,9) AS sign_p,
              round((hits+1)/1001.0::DOUBLE,9) AS permutation_p FROM k""",
        "vector_validity": f"""SELECT embedder_name, CASE WHEN embedding IS NULL THEN 'absent'
            WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))>0 OR len(embedding)>65536 OR isinf({LENGTH}) THEN 'invalid'
            WHEN len(embedding) IS DISTINCT FROM embedder_dim THEN 'other dimension' WHEN coalesce({LENGTH},0)=0 THEN 'no length' ELSE 'usable' END AS state, count(*) AS n
            FROM memory_records GROUP BY ALL""",
        "stub_embedding": f"WITH {STUB} SELECT qid, i::INT AS i, round(x,9) AS x FROM emb",
        "bm25_corpus_stats": f"WITH {STATE}, {_bm25('cur', 'cur', 1)} SELECT term, df FROM dfs",
        "bm25_topk": f"WITH {STATE}, {_bm25('cur', 'cur', 10)} SELECT qid, id, score, rank::INT AS rank FROM lex",
        "bm25_topk_filtered": f"WITH {STATE}, {_bm25(ACTIVE2, 'cur', 10)} SELECT qid, id, score, rank::INT AS rank FROM lex",
        "okapi_hard_negatives": f"WITH {STATE}, {_bm25('cur', 'cur', 20, 1.5, ETOK, 'ln((n-df+0.5)/(df+0.5)+1)', ETOK.format('query_text'), 'qtf', '(qid,id) NOT IN (SELECT (qid,record_id) FROM eval_labels)')} SELECT qid, id, score, rank::INT AS rank FROM lex",
        "lexical_overlap": f"""WITH dd AS (SELECT id, min(content) AS c FROM memory_records GROUP BY id),
            p AS (SELECT DISTINCT l.qid, l.record_id, list_distinct({ETOK.format('q.query_text')}) AS qw, list_distinct({ETOK.format('c')}) AS dw
              FROM eval_labels l JOIN eval_queries q USING (qid) JOIN dd ON dd.id=l.record_id WHERE grade>=1),
            o AS (SELECT qid, round(max(CASE WHEN len(qw)=0 THEN 0 ELSE len(list_intersect(qw,dw))::DOUBLE/len(qw) END),9) AS overlap FROM p GROUP BY qid)
            SELECT qid, overlap, CASE WHEN overlap<0.25 THEN 'low' WHEN overlap<0.5 THEN 'med' ELSE 'high' END AS bucket FROM o""",
        "rrf_hybrid": f"{LEGS} SELECT qid, id, round(rrf,9) AS rrf, rank::INT AS rank FROM fu",
        "hybrid_surfacable": f"{LEGS}, {_surface(10, 'su', 'fu')} SELECT qid, id, rank::INT AS rank FROM su",
        "abstain_gate": f"""WITH {STATE}, {STUB}, {_vec(60)}, t AS (SELECT qid, max(score) AS ts FROM vec JOIN cur c USING (id) WHERE {EFF}='active' AND trust_tier>0 GROUP BY qid)
            SELECT q.qid, round(ts,9) AS top_score, CASE WHEN ts IS NULL THEN 'unavailable: no vector candidates' WHEN ts>=0.45 THEN 'pass' ELSE 'abstain' END AS verdict FROM eval_queries q LEFT JOIN t USING (qid)""",
        "envelope_partition": f"""{LEGS}, {_surface(10, 'su', 'fu')},
            pin AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rank FROM cur WHERE {RULES} ORDER BY created_at, id LIMIT 5),
            u AS (SELECT qid, pin.id, 0 AS part, pin.rank FROM eval_queries, pin UNION ALL
                  SELECT qid, su.id, CASE WHEN kind='directive' AND trust_tier>=2 THEN 1 ELSE 2 END, su.rank FROM su JOIN cur ON cur.id=su.id),
            o AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY part, rank) AS n FROM u),
            c AS (SELECT *, CASE WHEN part<2 THEN 'directive' ELSE 'evidence' END AS channel FROM o WHERE n=1)
            SELECT qid, channel, row_number() OVER (PARTITION BY qid, channel ORDER BY part, rank, id)::INT AS position, id FROM c""",
        "ir_metrics_per_query": f"{hybrid} SELECT * FROM mh",
        "ablation_legs": f"{legs} " + " UNION ALL ".join(f"SELECT '{n}' AS config, count(*) AS n, {MEAN} FROM {t}" for n, t in (("vector", "mv"), ("lexical", "ml"), ("hybrid", "mh"))),
        "pool_depth_sweep": f"{LEGS200}, {pool_ctes} {pools}",
        "paired_wlt": f"{legs}, p AS (SELECT round(ml.recall-mv.recall,9) AS d FROM ml JOIN mv USING (qid)) SELECT count(CASE WHEN d>0 THEN 1 END) AS wins, count(CASE WHEN d<0 THEN 1 END) AS losses, count(CASE WHEN d=0 THEN 1 END) AS ties, round(avg(d),9) AS mean_diff FROM p",
        "rank_auc": f"{TOP1} SELECT count(CASE WHEN NOT control THEN 1 END) AS n_pos, count(CASE WHEN control THEN 1 END) AS n_neg, (SELECT round(avg(CASE WHEN a.score>b.score THEN 1.0::DOUBLE WHEN a.score=b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END),9) FROM t a, t b WHERE NOT a.control AND b.control) AS auc FROM t",
        "threshold_sweep": f"{TOP1} SELECT control, tau, count(*) AS n, round(avg(CASE WHEN score>=tau THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),9) AS accept_rate FROM t, unnest([5.0::DOUBLE,10.0,15.0,20.0,30.0]) u(tau) GROUP BY ALL",
        "latency_percentiles": "SELECT event_type, round(quantile_cont(value,0.5),9) AS p50, round(quantile_cont(value,0.95),9) AS p95, round(avg(value),9) AS mean, round(min(value),9) AS min, round(max(value),9) AS max FROM events GROUP BY 1",
        "ledger_informed_by": f"SELECT call_id, rank, ts, query_text, ids FROM (SELECT call_id, ts, query_text, array_to_string(ids,',') AS ids, row_number() OVER (PARTITION BY call_id ORDER BY ts DESC, query_text, array_to_string(ids,','))::INT AS rank FROM {ENTRIES} WHERE call_id IS NOT NULL) WHERE rank<=5",
        "ledger_kept": f"""WITH m AS (SELECT max(ts) AS now FROM recall_ledger) SELECT rank, call_id, ts, query_text, ids FROM (SELECT call_id, ts, query_text, array_to_string(ids,',') AS ids,
            row_number() OVER (ORDER BY ts DESC, call_id NULLS FIRST, query_text)::INT AS rank FROM {ENTRIES}, m WHERE ts<=now AND ts>=now - INTERVAL 7200 SECOND) WHERE rank<=50""",
        "ledger_credits": f"SELECT id, count(*) AS n FROM (SELECT unnest(list_distinct(ids)) AS id FROM {ENTRIES}) GROUP BY id",
    }
