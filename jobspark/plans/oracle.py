"""The registered queries in DuckDB's SQL, over views of the same tables."""

from __future__ import annotations

from . import bridge, queries

_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _clean(x: str) -> str:
    return _CLEAN.format(x)


def _pid(n: str) -> str:
    return f"('src' || ({n}) % 20 || ':' || ({n}))"


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]::VARCHAR[]"


def _case(value: str, cases: dict) -> str:
    rows = " ".join(f"WHEN {k!r} THEN {v}" for k, v in cases.items())
    return f"CASE {value} {rows} END"


def _iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


RAW = f"""raw AS (SELECT source || ':' || doc_id AS id, source, doc_id::VARCHAR AS external_id,
  split_part(text, chr(10), 1) AS title, upper(source) AS company,
  CASE WHEN lang <> 'es' THEN lang END AS "location",
  CASE lang WHEN 'en' THEN true WHEN 'es' THEN NULL ELSE false END AS remote,
  (n_chars * 5)::DOUBLE AS salary_min,
  CASE WHEN doc_id % 5 <> 0 THEN (n_chars * 10)::DOUBLE END AS salary_max,
  'USD' AS salary_currency,
  CASE WHEN doc_id % 2 = 0 THEN 'full_time' ELSE 'contract' END AS employment_type,
  lang AS category, text AS description_text,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'ftp://files.example.com/' || doc_id
       WHEN doc_id % 17 = 0 THEN 'https:///nohost'
       ELSE 'https://' || source || '.example.com/' || doc_id END AS apply_url,
  CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id) END AS posted_at,
  TIMESTAMP '2024-06-01' + to_hours(doc_id % 24) AS synced_at, doc_id AS ingest_seq
  FROM documents)"""

POSTINGS = RAW + f""", postings AS (SELECT * REPLACE ({_clean('title')} AS title,
  {_clean('description_text')} AS description_text),
  sha256({_clean('description_text')}) AS content_hash FROM raw)"""

CHUNKS = POSTINGS + f""", chunks AS (SELECT vec_id::VARCHAR AS id,
  {_pid('vec_id // 4')} AS job_posting_id, (vec_id % 4)::INTEGER AS chunk_index,
  'chunk ' || vec_id AS chunk_text, embedding,
  CASE WHEN label % 2 = 0 THEN 'model-0' ELSE 'model-1' END AS model_name,
  CASE WHEN label = 9 THEN 'outdated' ELSE p.content_hash END AS content_hash,
  TIMESTAMP '2024-06-02' AS created_at
  FROM embeddings JOIN postings p ON p.id = {_pid('vec_id // 4')})"""

REQUESTS = """requests AS (SELECT label, label::VARCHAR AS request_id,
  list(m ORDER BY i) AS vector,
  CASE WHEN label % 2 = 0 THEN 'model-0' ELSE 'model-1' END AS model_name
  FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v,
          generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
  GROUP BY label)"""

RESENT = RAW + """, resent AS (SELECT *, 0 AS landing FROM raw UNION ALL
  SELECT * REPLACE ('re: ' || title AS title), 1 AS landing FROM raw)"""

_REASON = f"""CASE WHEN id IS NULL THEN 'missing id'
  WHEN length({_clean('title')}) = 0 THEN 'empty title'
  WHEN length({_clean('description_text')}) < 40 THEN 'short description' END"""

PROFILES = f"""profiles AS (SELECT 'p' || c_custkey AS id, c_custkey::VARCHAR AS user_id,
  'default' AS label,
  {_case('c_mktsegment', {k: _list(v) for k, v in bridge.ROLES.items()})} AS target_roles,
  lower(c_mktsegment) AS seniority, c_acctbal AS salary_min, 'USD' AS salary_currency,
  {_case('c_nationkey % 4', {k: repr(v) for k, v in bridge.PREFERENCES.items()})}
    AS remote_preference,
  {_case('c_nationkey % 3', {k: _list(v) for k, v in bridge.PLACES.items()})}
    AS locations_preferred,
  {_case('c_mktsegment', {k: repr(v) for k, v in bridge.RESUMES.items()})} AS resume_text,
  CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_name || '.txt' END AS resume_filename,
  true AS is_default, TIMESTAMP '2023-01-01' + to_hours(c_custkey) AS created_at,
  TIMESTAMP '2023-06-01' AS updated_at FROM customer)"""

USERS = """users AS (SELECT c_custkey::VARCHAR AS id, lower(c_name) || '@example.com' AS email,
  c_name AS display_name, TIMESTAMP '2023-01-01' AS created_at FROM customer)"""

APPS = f"""apps AS (SELECT 'a' || o_orderkey AS id, o_custkey::VARCHAR AS user_id,
  'p' || o_custkey AS profile_id, {_pid('o_orderkey % (SELECT count(*) FROM documents)')} AS job_posting_id,
  {_case('o_orderpriority', {k: repr(v) for k, v in bridge.STAGE_OF.items()})} AS stage,
  o_orderdate AS stage_updated_at,
  CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate END AS applied_at FROM orders)"""

NOTES = """notes AS (SELECT 'a' || l_orderkey AS application_id, l_suppkey::VARCHAR AS user_id,
  l_shipdate::DATE AS follow_up_date FROM lineitem)"""

ACTIONS = f"""actions AS (SELECT user_id::VARCHAR AS user_id,
  {_pid('''regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT''')} AS job_posting_id,
  event_type, value, ts, event_id AS seq FROM events)"""

FEEDBACK = ACTIONS + """, fa AS (SELECT user_id, job_posting_id,
  CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad'
    WHEN 'view' THEN 'skip' END AS feedback,
  CASE WHEN value > 20 THEN value::VARCHAR END AS reason, ts, seq FROM actions
  WHERE event_type IN ('purchase', 'error', 'view')),
feedback AS (SELECT sha256(user_id || '|' || job_posting_id) AS id, user_id, job_posting_id,
  feedback, reason, created_at, updated_at FROM (SELECT *,
    min(ts) OVER w AS created_at, max(ts) OVER w AS updated_at,
    row_number() OVER (PARTITION BY user_id, job_posting_id ORDER BY ts DESC, seq DESC) AS rn
    FROM fa WINDOW w AS (PARTITION BY user_id, job_posting_id)) WHERE rn = 1)"""

STAGES = ACTIONS + """, sa AS (SELECT user_id, job_posting_id,
  CASE event_type WHEN 'click' THEN 'applied' WHEN 'view' THEN 'interviewing'
    WHEN 'error' THEN 'rejected' WHEN 'purchase' THEN 'offer' END AS stage,
  CASE WHEN value > 10 THEN 'p' || user_id END AS profile_id, ts, seq FROM actions)"""

BOOKMARKS = ACTIONS + """, ba AS (SELECT user_id, job_posting_id,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS action,
  CASE WHEN value > 30 THEN 'note ' || seq WHEN value > 20 THEN '' END AS note, ts, seq
  FROM actions),
kept AS (SELECT b.* FROM ba b WHERE action = 'save' AND NOT EXISTS (SELECT 1 FROM ba d
  WHERE d.action = 'delete' AND d.user_id = b.user_id AND d.job_posting_id = b.job_posting_id
    AND (d.ts > b.ts OR (d.ts = b.ts AND d.seq > b.seq)))),
bookmarks AS (SELECT sha256(user_id || '|' || job_posting_id) AS id, user_id, job_posting_id,
  max(CASE WHEN rn = 1 THEN nullif(note, '') END) AS note, min(ts) AS saved_at
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_posting_id
    ORDER BY coalesce(note, '') <> '' DESC, ts DESC, seq DESC) AS rn FROM kept)
  GROUP BY user_id, job_posting_id)"""

SKILLS = f"""pskill AS (SELECT DISTINCT {_pid('l_orderkey % (SELECT count(*) FROM documents)')} AS job_posting_id,
  p_brand AS skill_id FROM lineitem JOIN part ON l_partkey = p_partkey),
oskill AS (SELECT DISTINCT 'p' || o_custkey AS profile_id, p_brand AS skill_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
required AS (SELECT DISTINCT profile_id, skill_id FROM
  (SELECT DISTINCT profile_id, job_posting_id FROM apps) JOIN pskill USING (job_posting_id))"""

RUNS = """runs AS (SELECT event_id::VARCHAR AS id, CASE event_type WHEN 'error' THEN 'failed'
  WHEN 'signup' THEN 'running' ELSE 'completed' END AS status, ts AS started_at,
  CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 5 MINUTE END AS finished_at,
  floor(value)::INTEGER AS fetched_rows,
  CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_message FROM events)"""


def _chunked(source: str, size: int, overlap: int) -> str:
    """Chunks of a relation with job_posting_id and body."""
    step = size - overlap
    return f"""(SELECT job_posting_id, content_hash, i::INTEGER AS chunk_index,
      substr(body, (i * {step} + 1)::BIGINT, {size}) AS chunk_text
      FROM (SELECT *, unnest(generate_series(0,
        greatest(0, ceil((length(body) - {overlap}) / {step}.0) - 1)::BIGINT)) AS i
        FROM ({source}) WHERE length(body) > 0))"""


_BODY = "SELECT id AS job_posting_id, content_hash, description_text AS body, category FROM postings"

_HTML = r"""regexp_replace(regexp_replace(regexp_replace({}, '(?s)<!--.*?-->', ' ', 'g'),
  '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|template\b[^>]*>.*?</template)\s*>',
  ' ', 'g'), '(?s)</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<![^>]*>', ' ', 'g')"""


def _html(x: str) -> str:
    t = _HTML.format(x)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"),
                       ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return _clean(t)


_CREATED = """CASE n % 4 WHEN 0 THEN strftime(DATE '2024-01-01' + (n % 28)::INTEGER,
    '%Y-%m-%dT10:20:30.000000')
  WHEN 1 THEN strftime(DATE '2024-01-01' + (n % 28)::INTEGER, '%Y-%m-%dT05:20:30.000000')
  WHEN 2 THEN strftime(DATE '2024-01-01' + (n % 28)::INTEGER, '%Y-%m-%dT10:20:30.250000') END"""

FEED_A = f"""a AS (SELECT 'adzuna:' || n AS id, 'adzuna' AS source, n::VARCHAR AS external_id,
  title, source AS company, loc AS "location",
  contains(lower(concat_ws(' ', loc, title)), 'remote') AS remote,
  n_chars::DOUBLE AS salary_min, (n_chars * 2)::DOUBLE AS salary_max, 'USD' AS salary_currency,
  CASE WHEN n % 3 = 0 THEN 'full_time' ELSE 'permanent' END AS employment_type,
  lang AS category, sha256({_clean('text')}) AS content_hash, {_clean('text')} AS body,
  'https://a.example.com/' || n AS apply_url, {_CREATED} AS posted_at,
  CASE WHEN coalesce(title, '') = '' THEN 'missing title'
    WHEN {_clean('text')} = '' THEN 'missing description' END AS reject_reason
  FROM (SELECT *, doc_id AS n, CASE WHEN doc_id % 50 <> 49 THEN split_part(text, chr(10), 1)
    END AS title, CASE WHEN doc_id % 3 = 0 THEN 'Remote, DE' ELSE lang END AS loc
    FROM documents))"""

_BODY_B = """concat_ws(' ', CASE WHEN n % 4 <> 0 THEN text END,
  CASE WHEN n % 6 = 0 THEN '  Summary ' || chr(9) || ' of ' || source END,
  CASE WHEN n % 8 <> 0 THEN 'duties' END)"""

FEED_B = f"""b AS (SELECT 'usajobs:' || n AS id, 'usajobs' AS source, n::VARCHAR AS external_id,
  title, CASE WHEN n % 3 = 0 THEN source ELSE 'Department' END AS company,
  lang AS "location", contains(lower(concat_ws(' ', lang, title)), 'remote') AS remote,
  CASE WHEN n % 5 <> 0 AND n % 7 <> 0 THEN n_chars::DOUBLE END AS salary_min,
  CASE WHEN n % 5 <> 0 THEN (n_chars * 3)::DOUBLE + 0.5 END AS salary_max,
  'USD' AS salary_currency, 'Full-time' AS employment_type, lang AS category,
  sha256({_clean(_BODY_B)}) AS content_hash, {_clean(_BODY_B)} AS body,
  CASE WHEN n % 2 = 0 THEN 'https://apply.example.com/' ELSE 'https://b.example.com/' END || n
    AS apply_url, {_CREATED} AS posted_at,
  CASE WHEN coalesce(title, '') = '' THEN 'missing title'
    WHEN {_clean(_BODY_B)} = '' THEN 'missing description' END AS reject_reason
  FROM (SELECT *, doc_id AS n, split_part(text, chr(10), 1) AS title FROM documents))"""

FEED_C = f"""c AS (SELECT 'remoteok:' || n AS id, 'remoteok' AS source, n::VARCHAR AS external_id,
  title, regexp_extract(url, '//([^/]+)/', 1) AS company,
  CASE WHEN n % 2 = 0 THEN 'Remote' ELSE 'Berlin' END AS "location", true AS remote,
  CASE WHEN n % 2 <> 0 THEN 50000.0::DOUBLE END AS salary_min, 90000.0::DOUBLE AS salary_max,
  'USD' AS salary_currency, NULL::VARCHAR AS employment_type,
  regexp_extract(html, 'lang="([a-z]+)"', 1) AS category, sha256(body) AS content_hash, body,
  CASE WHEN n % 5 = 0 THEN url ELSE url || '?apply' END AS apply_url,
  CASE WHEN n % 3 = 0 THEN {_iso("make_timestamp((n * 3600 + 1700000000) * 1000000)")}
    ELSE {_CREATED} END AS posted_at,
  CASE WHEN title = '' THEN 'missing title'
    WHEN body = '' OR len(string_split(body, ' ')) < 12 THEN 'description too short' END
    AS reject_reason
  FROM (SELECT *, page_id AS n, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    {_clean("regexp_replace(" + _html('''CASE WHEN page_id % 4 = 0 THEN replace(html, '</article>',
      '<p>Please mention the word <b>x</b> &amp; tag it.</p></article>') ELSE html END''')
      + ", '(?is)please mention the word.*', '')")} AS body FROM pages))"""

_NORMALIZED = """id, source, external_id, title, company, "location", remote, salary_min,
  salary_max, salary_currency, employment_type, category, content_hash, apply_url, posted_at,
  reject_reason"""

_SHOWN = """id, source, title, company, "location", remote, salary_min, salary_max,
  salary_currency, employment_type, category, left(description_text, 300) AS description_preview,
  apply_url, posted_at, synced_at"""

_DOT = "list_cosine_similarity(e.embedding::DOUBLE[], r.vector::DOUBLE[])"


VECTOR_REQUESTS = """requests AS (SELECT label, 'v' || vec_id AS request_id,
  embedding::DOUBLE[] AS vector, CASE WHEN label % 2 = 0 THEN 'model-0' ELSE 'model-1' END
  AS model_name FROM embeddings WHERE vec_id % 50 = 0)"""

_FILTERED = """(r.label <> 2 OR p.source IN ('src0','src1','src2','src3','src4','src5','src6',
      'src7','src8','src9'))
    AND (r.label % 3 <> 0 OR p.remote) AND (r.label % 4 <> 1 OR p.salary_max >= 10000)
    AND (r.label <> 5 OR p."location" ILIKE '%D%')
    AND (r.label <> 8 OR p."location" ILIKE '%_r%')"""

_PROBED = f"""centres AS (SELECT embedding::DOUBLE[] AS centre,
  row_number() OVER (ORDER BY sha256(vec_id::VARCHAR)) AS list_id FROM embeddings
  QUALIFY list_id <= {queries.LISTS}),
listed AS (SELECT id, list_id FROM chunks, centres QUALIFY row_number() OVER (PARTITION BY id
  ORDER BY list_cosine_similarity(embedding::DOUBLE[], centre) DESC, list_id) = 1),
probed AS (SELECT request_id, list_id FROM requests, centres QUALIFY row_number() OVER (
  PARTITION BY request_id ORDER BY list_cosine_similarity(vector, centre) DESC, list_id)
  <= {queries.PROBES})"""


def _vectors(name: str, source: str, dimension: int) -> str:
    """Hashed word counts of unit length, of a relation with key and body."""
    return f"""{name}_n AS (SELECT key, ('0x' || substr(md5(w), 1, 7))::INTEGER % {dimension} AS d,
  count(*) AS n FROM (SELECT key, unnest(string_split(lower({_clean('body')}), ' ')) AS w
    FROM ({source})) GROUP BY ALL),
{name}_k AS (SELECT key, sqrt(sum(n * n)) AS len FROM {name}_n GROUP BY key),
{name} AS (SELECT k.key, list((coalesce(c.n, 0) / k.len)::FLOAT ORDER BY g.i) AS embedding
  FROM {name}_k k CROSS JOIN (SELECT unnest(range({dimension})) AS i) g
  LEFT JOIN {name}_n c ON c.key = k.key AND c.d = g.i GROUP BY k.key)"""


_PIECES = f"""pieces AS (SELECT job_posting_id || '#' || chunk_index AS id, job_posting_id,
  chunk_index, chunk_text FROM {_chunked(_BODY, 1000, 150)})"""


def _text_search(requests: str, where: str, k: int) -> str:
    """Over vectors of all chunks; ``requests`` has request_id, body and filters."""
    return f"""{POSTINGS}, {_PIECES}, requests AS ({requests}),
{_vectors("cv", "SELECT id AS key, chunk_text AS body FROM pieces", 256)},
{_vectors("rv", "SELECT request_id AS key, body FROM requests", 256)},
near AS (SELECT r.request_id, e.id AS chunk_id, e.job_posting_id,
  round(1 - list_cosine_similarity(c.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) AS distance,
  FROM requests r JOIN rv v ON v.key = r.request_id CROSS JOIN pieces e
  JOIN cv c ON c.key = e.id JOIN postings p ON p.id = e.job_posting_id WHERE {where}),
pool AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, chunk_id)
  AS pool_rank FROM near QUALIFY pool_rank <= 50),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id, job_posting_id
  ORDER BY distance, chunk_id) AS rn FROM pool),
top AS (SELECT request_id, job_posting_id, chunk_id, round(1 - distance, 6) AS similarity,
  row_number() OVER (PARTITION BY request_id ORDER BY 1 - distance DESC, job_posting_id)
    AS base_rank FROM best WHERE rn = 1 QUALIFY base_rank <= {k})"""


def _search(pool: int, k: int, fresh: bool = False, requests: str = REQUESTS,
            where: str = _FILTERED, lists: bool = False) -> str:
    return CHUNKS + ", " + requests + (", " + _PROBED if lists else "") + f""",
near AS (SELECT r.request_id, e.id AS chunk_id,
  e.job_posting_id, 1 - {_DOT} AS distance, row_number() OVER (PARTITION BY r.request_id
    ORDER BY 1 - {_DOT}, e.id) AS pool_rank
  FROM chunks e JOIN postings p ON p.id = e.job_posting_id
    {"AND p.content_hash = e.content_hash" if fresh else ""}
  JOIN requests r ON r.model_name = e.model_name
  {"""JOIN listed l ON l.id = e.id
  JOIN probed b ON b.request_id = r.request_id AND b.list_id = l.list_id""" if lists else ""}
  WHERE {where}),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id, job_posting_id
  ORDER BY distance, chunk_id) AS rn FROM near WHERE pool_rank <= {pool}),
top AS (SELECT request_id, job_posting_id, chunk_id, round(1 - distance, 6) AS similarity,
  row_number() OVER (PARTITION BY request_id ORDER BY 1 - distance DESC, job_posting_id)
    AS base_rank FROM best WHERE rn = 1 QUALIFY base_rank <= {k})"""


def _skill_gap(test: str) -> str:
    terms = ", ".join(f"('{t}')" for t in queries.TERMS)
    return f"""WITH {POSTINGS}, {PROFILES}, {APPS}, terms(skill) AS (VALUES {terms}),
pairs AS (SELECT DISTINCT profile_id, job_posting_id FROM apps),
m AS (SELECT id AS job_posting_id, skill FROM postings, terms
  WHERE {test.format('lower(description_text)')}),
owned AS (SELECT id AS profile_id, skill,
  {test.format("lower(coalesce(resume_text, ''))")} AS present FROM profiles, terms)
SELECT profile_id, skill, count(*) AS jobs_mentioning, any_value(present) AS present_in_resume
FROM pairs JOIN m USING (job_posting_id) JOIN owned USING (profile_id, skill)
GROUP BY profile_id, skill"""


def _risk(checked: bool) -> str:
    flags = [f"CASE WHEN contains(lower(description_text), '{t}') THEN '{label}' END"
             for label, t in queries.RISK_TERMS.items()]
    flags.append("CASE WHEN NOT web THEN 'missing or invalid application URL' END")
    status, live = "NULL::INTEGER", "false"
    join = ""
    if checked:
        join = "LEFT JOIN checks u ON u.url = p.apply_url"
        status = "CASE WHEN web AND NOT coalesce(u.is_private, false) THEN u.http_status END"
        live = f"coalesce(({status}) < 400, false)"
        flags += [
            "CASE WHEN web AND u.is_private THEN "
            "'application URL resolves to a private address' END",
            f"CASE WHEN ({status}) >= 400 THEN "
            f"'application URL returned HTTP ' || ({status}) END",
            "CASE WHEN web AND NOT coalesce(u.is_private, false) AND u.http_status IS NULL "
            "THEN 'application URL could not be verified' END"]
    return f"""WITH {POSTINGS}, checks AS (SELECT apply_url AS url,
  min(CASE ingest_seq % 4 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END)::INTEGER AS http_status,
  bool_or(ingest_seq % 19 = 0) AS is_private FROM raw
  WHERE apply_url IS NOT NULL AND ingest_seq % 9 <> 0 GROUP BY apply_url),
flagged AS (SELECT p.*, {status} AS http_status, {live} AS url_live,
  list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL) AS fl
  FROM (SELECT *, coalesce(regexp_matches(apply_url, '^https?://[^/]'), false) AS web
    FROM postings) p {join})
SELECT id AS job_posting_id, title, company, source, url_live, http_status::VARCHAR AS http_status,
  greatest(0, 100 - 20 * len(fl))::INTEGER AS risk_score,
  CASE WHEN 100 - 20 * len(fl) >= 80 THEN 'low_risk'
    WHEN 100 - 20 * len(fl) >= 50 THEN 'review' ELSE 'high_risk' END AS verdict,
  array_to_string(fl, '; ') AS flags FROM flagged"""


_HASH_OF_TWO = "sha256(user_id || '|' || job_posting_id)"


def _errors(*cases: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL), ' ')"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["prepare_postings"] = f"""WITH {RESENT} SELECT id, source, {_clean('title')} AS title,
  company, "location", remote::VARCHAR AS remote, salary_max, length({_clean('description_text')})::INTEGER AS n_chars,
  sha256({_clean('description_text')}) AS content_hash, posted_at FROM (SELECT *,
    row_number() OVER (PARTITION BY id ORDER BY landing, ingest_seq) AS rn FROM resent
    WHERE {_REASON} IS NULL) WHERE rn = 1"""
    q["prepare_metrics"] = f"""WITH {RESENT} SELECT source, grouping(source)::INTEGER AS is_total,
  count(*) AS input_rows, count(DISTINCT CASE WHEN {_REASON} IS NULL THEN id END) AS output_rows,
  count(*) - count(DISTINCT CASE WHEN {_REASON} IS NULL THEN id END)
    AS rejected_or_duplicate_rows FROM resent GROUP BY ROLLUP (source)"""
    q["reject_reasons"] = f"""WITH {RESENT} SELECT source, {_REASON} AS reject_reason,
  count(*) AS rejected_rows FROM resent WHERE {_REASON} IS NOT NULL GROUP BY 1, 2"""
    q["normalize_source_a"] = f"WITH {FEED_A} SELECT {_NORMALIZED} FROM a"
    q["normalize_source_b"] = f"WITH {FEED_B} SELECT {_NORMALIZED} FROM b"
    q["normalize_source_c"] = f"WITH {FEED_C} SELECT {_NORMALIZED} FROM c"
    q["typed_postings"] = f"""WITH {RAW} SELECT id, source, external_id, title,
  NULL::VARCHAR AS company, "location", remote::VARCHAR AS remote, salary_min, salary_max,
  salary_currency, employment_type, category, sha256(description_text) AS description_text,
  apply_url, {_iso('posted_at')} AS posted_at, '{{"n":' || ingest_seq || ',"at":{{"source":"'
  || source || '"' || coalesce(',"location":"' || "location" || '"', '') || '}}}}' AS payload_json
  FROM raw"""
    q["html_to_text"] = f"""SELECT page_id, body, CASE WHEN body = '' THEN 0
  ELSE len(string_split(body, ' ')) END::INTEGER AS n_words
  FROM (SELECT page_id, {_html('html')} AS body FROM pages)"""
    q["harvest_summary"] = f"""WITH {FEED_A}, {FEED_B}, {FEED_C} SELECT source,
  count(DISTINCT id) AS postings FROM (SELECT {_NORMALIZED} FROM a UNION ALL
  SELECT {_NORMALIZED} FROM b UNION ALL SELECT {_NORMALIZED} FROM c)
  WHERE reject_reason IS NULL GROUP BY source"""
    hay = "lower(concat_ws(' ', title, \"location\"))"
    q["keyword_filter_capped"] = f"""WITH {RAW} SELECT id, source, row_number() OVER
  (PARTITION BY source ORDER BY ingest_seq)::INTEGER AS feed_rank FROM raw
  WHERE contains({hay}, 'the') OR contains({hay}, 'und') OR contains({hay}, 'la')
  QUALIFY feed_rank <= 15"""
    q["source_side_filters"] = f"""WITH {RAW} SELECT id, "location", salary_max, employment_type,
  posted_at FROM raw WHERE contains(lower(title || ' ' || description_text), 'tion')
  AND "location" ILIKE '%e%' AND posted_at >= TIMESTAMP '2024-01-31' - INTERVAL 25 DAY
  AND salary_max >= 5000 AND employment_type = 'full_time' AND remote"""
    q["source_page"] = f"""WITH {RAW} SELECT id, ingest_seq, title FROM raw
  ORDER BY ingest_seq, id LIMIT 100 OFFSET 100"""
    q["query_list_parse"] = """SELECT keyword, 'Berlin' AS "location", count(*) AS entries FROM
  (SELECT trim(unnest([p_brand, '  ', p_type, p_name])) AS keyword FROM part)
  WHERE keyword <> '' GROUP BY keyword"""
    q["browse_filters"] = f"""WITH {POSTINGS} SELECT {_SHOWN} FROM postings
  WHERE source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')
  AND remote AND salary_max >= 2000 AND "location" ILIKE '%E%'
  ORDER BY posted_at DESC NULLS LAST, synced_at DESC, id LIMIT 50"""
    q["browse_preferences"] = f"""WITH {POSTINGS} SELECT id, "location", remote, salary_max,
  left(description_text, 300) AS description_preview FROM postings WHERE NOT remote
  AND (salary_max IS NULL OR salary_max >= 3000)
  AND (lower(title) LIKE '%und%' OR lower(title) LIKE '%la%')
  AND (remote OR "location" IS NULL OR lower("location") LIKE '%de%')"""
    q["relevant_postings_per_profile"] = f"""WITH {POSTINGS}, {PROFILES},
kinds AS (SELECT DISTINCT target_roles, remote_preference, salary_min, locations_preferred
  FROM profiles),
slim AS (SELECT id, lower(title) AS title, "location", remote, salary_max, posted_at, synced_at
  FROM postings),
hits AS (SELECT k.*, s.* EXCLUDE (title), row_number() OVER (PARTITION BY target_roles,
    remote_preference, salary_min, locations_preferred
    ORDER BY posted_at DESC NULLS LAST, synced_at DESC, id) AS rank
  FROM kinds k JOIN slim s ON
    (len(target_roles) = 0 OR len(list_filter(target_roles,
      lambda r: s.title LIKE '%' || lower(r) || '%')) > 0)
    AND CASE remote_preference WHEN 'remote_only' THEN remote WHEN 'onsite' THEN NOT remote
      ELSE true END
    AND (salary_min = 0 OR salary_max IS NULL OR salary_max >= salary_min)
    AND (len(list_filter(locations_preferred, lambda l: trim(l) <> '')) = 0 OR remote
      OR s."location" IS NULL OR len(list_filter(locations_preferred,
        lambda l: trim(l) <> '' AND lower(s."location") LIKE '%' || lower(l) || '%')) > 0)
  QUALIFY rank <= 25)
SELECT p.id AS profile_id, h.rank::INTEGER AS rank, h.id, h."location", h.remote::VARCHAR AS remote,
  h.salary_max, h.posted_at FROM profiles p JOIN hits h ON p.target_roles = h.target_roles
  AND p.remote_preference = h.remote_preference AND p.salary_min = h.salary_min
  AND p.locations_preferred = h.locations_preferred"""
    q["profile_search_context"] = f"""WITH {PROFILES} SELECT id AS request_id,
  'work for ' || user_id || CASE WHEN len(target_roles) > 0
    THEN '. Target roles: ' || array_to_string(target_roles, ', ') ELSE '' END AS search_text,
  salary_min > 5000 OR remote_preference = 'remote_only' AS remote_only,
  CASE WHEN salary_min < 0 THEN 100.0::DOUBLE ELSE salary_min END AS minimum_salary,
  CASE WHEN salary_min > 9000 THEN 'Paris' WHEN len(locations_preferred) = 1
    THEN locations_preferred[1] END AS "location" FROM profiles"""
    q["chunk_documents"] = f"""WITH {POSTINGS} SELECT job_posting_id || '#' || chunk_index AS id,
  job_posting_id, chunk_index, chunk_text FROM {_chunked(_BODY, 1000, 150)}"""
    q["chunk_stats"] = f"""WITH {POSTINGS} SELECT job_posting_id, count(*) AS chunk_count,
  min(length(chunk_text))::INTEGER AS shortest_chunk,
  max(length(chunk_text))::INTEGER AS longest_chunk, 'model-0' AS model_name
  FROM {_chunked(_BODY, 400, 50)} GROUP BY job_posting_id"""
    q["model_coverage"] = f"""WITH {CHUNKS} SELECT model_name, count(*) AS chunks,
  count(DISTINCT job_posting_id) AS postings FROM chunks GROUP BY model_name"""
    pending = """NOT EXISTS (SELECT 1 FROM chunks e WHERE e.job_posting_id = p.id
  AND e.content_hash = p.content_hash AND e.model_name = 'model-0')"""
    q["embedding_status"] = f"""WITH {CHUNKS} SELECT (SELECT count(*) FROM postings)
  AS total_postings, (SELECT count(DISTINCT job_posting_id) FROM chunks) AS embedded_postings,
  (SELECT count(*) FROM chunks) AS total_chunks,
  (SELECT count(*) FROM postings p WHERE {pending}) AS pending_postings"""
    q["pending_postings"] = f"""WITH {CHUNKS} SELECT id, content_hash, synced_at FROM postings p
  WHERE {pending} ORDER BY synced_at DESC, id LIMIT 500"""
    q["unembedded"] = f"""WITH {CHUNKS} SELECT id, source, title FROM postings p WHERE NOT EXISTS
  (SELECT 1 FROM chunks e WHERE e.job_posting_id = p.id AND e.content_hash = p.content_hash)"""
    q["coverage_left_join"] = f"""WITH {CHUNKS} SELECT p.source,
  count(DISTINCT p.id) AS total_postings, count(DISTINCT e.job_posting_id) AS embedded_postings,
  count(e.id) AS total_chunks FROM postings p LEFT JOIN chunks e ON e.job_posting_id = p.id
  GROUP BY p.source"""
    q["vector_checks"] = """SELECT unnest(['dimension is 64', 'dimension is 1024', 'unit length',
  'label is even']) AS rule, unnest([count(*) FILTER (len(embedding) <> 64),
  count(*) FILTER (len(embedding) <> 1024),
  count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)
    >= 1e-4), count(*) FILTER (label % 2 <> 0)]) AS broken_rows FROM embeddings"""
    q["embed_postings"] = f"""WITH {POSTINGS} SELECT job_posting_id, 'hashing-64' AS model_name,
  content_hash, count(*) AS chunks, 64 AS least_dimension, 64 AS most_dimension,
  1.0::DOUBLE AS least_norm, 1.0::DOUBLE AS most_norm
  FROM {_chunked(_BODY, 1000, 150)} GROUP BY job_posting_id, content_hash"""
    todo = f"""SELECT p.id AS job_posting_id, content_hash, description_text AS body
  FROM postings p WHERE {pending}"""
    q["embed_refresh"] = f"""WITH {CHUNKS}, todo AS ({todo}) SELECT job_posting_id, model_name,
  content_hash, count(*) AS chunks, max(created_at) AS created_at FROM (
  SELECT job_posting_id, model_name, content_hash, created_at FROM chunks
  WHERE job_posting_id NOT IN (SELECT job_posting_id FROM todo)
  UNION ALL SELECT job_posting_id, 'model-0', content_hash, TIMESTAMP '2024-06-03'
  FROM {_chunked('SELECT * FROM todo', 1000, 150)}) GROUP BY 1, 2, 3"""
    q["embed_refresh_again"] = f"""WITH {CHUNKS}, todo AS ({todo})
  SELECT job_posting_id AS id, content_hash FROM todo WHERE body = ''"""
    q["resume_invalidate"] = f"""WITH {PROFILES}, o AS (SELECT *,
  remote_preference = 'hybrid' AS hit FROM profiles) SELECT id,
  CASE WHEN hit THEN user_id || '.md' ELSE resume_filename END AS resume_filename,
  CASE WHEN hit THEN 'New resume of ' || user_id ELSE resume_text END AS resume_text,
  CASE WHEN NOT hit THEN '1' END AS dimension,
  CASE WHEN NOT hit THEN sha256(resume_text) END AS resume_content_hash,
  CASE WHEN NOT hit THEN updated_at END AS resume_embedded_at,
  CASE WHEN hit THEN TIMESTAMP '2024-07-01' ELSE updated_at END AS updated_at FROM o"""
    q["semantic_search_topk"] = f"""WITH {_search(100, 10)} SELECT t.request_id,
  t.base_rank::INTEGER AS base_rank, t.job_posting_id, t.chunk_id, 'chunk ' || t.chunk_id
    AS chunk_text, t.similarity, p.source, p.remote::VARCHAR AS remote, p.salary_max,
  p."location", left(p.description_text, 500) AS description_preview
  FROM top t JOIN postings p ON p.id = t.job_posting_id"""
    q["semantic_search_late"] = f"""WITH {_search(100, 10)} SELECT request_id,
  base_rank::INTEGER AS base_rank, job_posting_id, chunk_id, similarity FROM top"""
    q["semantic_search_fresh"] = f"""WITH {_search(200, 20, True)} SELECT request_id,
  base_rank::INTEGER AS base_rank, job_posting_id, chunk_id, similarity FROM top"""
    benchmark = f"SELECT item_id::VARCHAR AS request_id, {_clean('text')} AS body FROM benchmark"
    q["text_search"] = f"""WITH {_text_search(benchmark, 'true', 5)} SELECT request_id,
  base_rank::INTEGER AS base_rank, job_posting_id, chunk_id, similarity FROM top"""
    asked = f"""SELECT 'q' || user_id AS request_id, user_id, f.id AS profile_id,
  'work of the ' || seniority || CASE WHEN len(target_roles) > 0
    THEN '. Target roles: ' || array_to_string(target_roles, ', ') ELSE '' END AS body,
  user_id::BIGINT % 200 = 0 OR remote_preference = 'remote_only' AS only_remote,
  CASE WHEN salary_min > 2000 THEN 2000 ELSE salary_min END::DOUBLE AS least,
  CASE WHEN user_id::BIGINT % 150 = 0 THEN 'e' WHEN len(locations_preferred) = 1
    AND lower(locations_preferred[1]) <> 'remote' THEN locations_preferred[1] END AS place
  FROM profiles f WHERE user_id::BIGINT % 50 = 0 AND user_id::BIGINT % 350 <> 0"""
    fits = """(NOT r.only_remote OR p.remote) AND (r.least IS NULL OR p.salary_max >= r.least)
    AND (coalesce(r.place, '') = '' OR p."location" ILIKE '%' || trim(r.place) || '%')"""
    q["profile_search"] = f"""WITH {PROFILES}, {FEEDBACK}, {_text_search(asked, fits, 5)},
moved AS (SELECT t.*, r.user_id, r.profile_id, f.feedback, round(greatest(0, least(1,
    t.similarity + CASE f.feedback WHEN 'good' THEN 0.05::DOUBLE WHEN 'bad' THEN -0.10::DOUBLE
      WHEN 'skip' THEN -0.04::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS adjusted
  FROM top t JOIN requests r USING (request_id) LEFT JOIN feedback f
    ON f.user_id = r.user_id AND f.job_posting_id = t.job_posting_id)
SELECT request_id, user_id, profile_id, row_number() OVER (PARTITION BY request_id
    ORDER BY adjusted DESC, base_rank)::INTEGER AS rank, job_posting_id, chunk_id,
  similarity AS base_similarity, feedback, adjusted AS similarity FROM moved"""
    q["profile_search_refused"] = """SELECT 'q' || c_custkey AS request_id,
  'unknown user' AS error FROM customer WHERE c_custkey % 350 = 0"""
    q["embed_vectors"] = f"""WITH {POSTINGS}, {_PIECES},
{_vectors("cv", "SELECT id AS key, chunk_text AS body FROM pieces", 64)},
places AS (SELECT key, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM cv)
SELECT p.id, p.chunk_index, md5(p.chunk_text) AS chunk_hash, v.vector FROM pieces p JOIN (
  SELECT key, string_agg(i || ':' || round(x * 1000000)::BIGINT, ' ' ORDER BY i) AS vector
  FROM places WHERE round(x * 1000000) > 0 GROUP BY key) v ON v.key = p.id"""
    q["approximate_topk"] = f"""WITH {_search(100, 10, False, VECTOR_REQUESTS, 'true', True)}
  SELECT request_id, base_rank::INTEGER AS base_rank, job_posting_id, chunk_id, similarity
  FROM top"""
    q["approximate_search"] = f"""WITH exact AS (WITH {_search(100, 10)} SELECT * FROM top),
found AS (WITH {_search(100, 10, lists=True)} SELECT * FROM top)
SELECT request_id, count(*) AS wanted, count(f.chunk_id) AS found,
  round(count(f.chunk_id) / count(*), 4) AS recall
  FROM exact LEFT JOIN found f USING (request_id, job_posting_id) GROUP BY request_id"""
    q["feedback_rerank"] = f"""WITH {_search(100, 10)}, {FEEDBACK}, moved AS (
  SELECT t.request_id, t.base_rank, t.job_posting_id, t.similarity AS base_similarity, f.feedback,
  CASE f.feedback WHEN 'good' THEN 0.05::DOUBLE WHEN 'bad' THEN -0.10::DOUBLE
    WHEN 'skip' THEN -0.04::DOUBLE ELSE 0.0::DOUBLE END AS feedback_adjustment
  FROM top t LEFT JOIN feedback f ON f.user_id = t.request_id
    AND f.job_posting_id = t.job_posting_id),
scored AS (SELECT *, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  base_similarity + feedback_adjustment)), 6) AS similarity FROM moved)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, base_rank)
  ::INTEGER AS rank, base_rank::INTEGER AS base_rank, job_posting_id, base_similarity, feedback,
  feedback_adjustment, similarity FROM scored"""
    q["profile_list"] = f"""WITH {PROFILES} SELECT id, user_id, label,
  array_to_string(target_roles, ',') AS target_roles, seniority, salary_min, salary_currency,
  remote_preference, array_to_string(locations_preferred, ',') AS locations_preferred,
  '' AS deal_breakers, resume_filename, resume_text IS NOT NULL AS has_resume,
  length(resume_text)::VARCHAR AS resume_characters, is_default, created_at, updated_at
  FROM profiles"""
    q["default_profile"] = """SELECT user_id, id, is_default, created_at FROM (SELECT
  o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS id, o_orderpriority = '1-URGENT'
  AS is_default, o_orderdate AS created_at FROM orders) QUALIFY row_number() OVER
  (PARTITION BY user_id ORDER BY is_default DESC, created_at, id) = 1"""
    q["single_default"] = """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS user_id,
  o_orderpriority = '1-URGENT' AND row_number() OVER (PARTITION BY o_custkey,
    o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_default
  FROM orders"""
    context = f"""WITH {POSTINGS}, {PROFILES}, {APPS}, ctx AS (SELECT a.user_id,
  a.job_posting_id, f.id AS profile_id, f.label, f.target_roles, f.remote_preference,
  f.salary_min AS profile_salary_min, f.resume_text, p.title, p.company, p."location", p.remote,
  p.salary_min, p.salary_max, p.description_text, p.apply_url
  FROM (SELECT DISTINCT user_id, job_posting_id FROM apps) a JOIN profiles f USING (user_id)
  JOIN postings p ON p.id = a.job_posting_id)"""
    q["job_match_context"] = context + """ SELECT user_id, job_posting_id, profile_id, label,
  array_to_string(target_roles, ',') AS target_roles, remote_preference, profile_salary_min,
  left(resume_text, 8000) AS resume_text, title, company, "location", remote::VARCHAR AS remote,
  salary_min, salary_max,
  length(description_text)::INTEGER AS n_chars, apply_url FROM ctx"""
    q["grounded_prompts"] = context + """, made AS (SELECT user_id, job_posting_id,
  'FORMAT: resume_bullet' || chr(10) || 'JOB TITLE: ' || title || chr(10) || 'COMPANY: ' || company
  || chr(10) || chr(10) || 'JOB TEXT:' || chr(10) || left(description_text, 6000) || chr(10)
  || 'RESUME:' || chr(10) || coalesce(left(resume_text, 6000), '') AS prompt FROM ctx)
SELECT user_id, job_posting_id, 'resume_bullet' AS format, length(prompt)::INTEGER AS n_chars,
  sha256(prompt) AS prompt_hash FROM made"""
    q["user_lookup"] = """SELECT event_id, CASE WHEN event_type <> 'error'
  THEN c_custkey::VARCHAR END AS user_id FROM events LEFT JOIN customer ON c_custkey = user_id"""
    q["posting_stats"] = f"""WITH {POSTINGS} SELECT source, grouping(source)::INTEGER AS is_total,
  count(*) AS postings, count(*) FILTER (remote) AS remote_postings, min(posted_at) AS oldest,
  max(posted_at) AS newest, max(synced_at) AS last_synced_at FROM postings
  GROUP BY ROLLUP (source)"""
    rank = "list_position(['saved','applied','interviewing','rejected','offer'], stage)::INTEGER"
    q["stage_funnel"] = f"""WITH {APPS} SELECT stage, count(*) AS applications, {rank}
  AS stage_rank FROM apps GROUP BY stage"""
    q["stage_board"] = f"""WITH {POSTINGS}, {APPS}, {NOTES}, n AS (SELECT application_id,
  count(*) AS note_count, min(follow_up_date) FILTER (follow_up_date >= DATE '1998-01-01')
  AS next_follow_up FROM notes GROUP BY application_id)
SELECT a.id, a.user_id, a.job_posting_id, a.stage, {rank} AS stage_rank, a.stage_updated_at,
  p.title, p.company, p."location", p.remote::VARCHAR AS remote, p.apply_url,
  coalesce(n.note_count, 0) AS note_count, n.next_follow_up::VARCHAR AS next_follow_up FROM apps a JOIN postings p ON p.id = a.job_posting_id
  LEFT JOIN n ON n.application_id = a.id"""
    counts = ", ".join(
        f"count(*) FILTER (stage = '{s}') AS {s}_stage" for s in
        ("saved", "applied", "interviewing", "rejected", "offer"))
    q["stage_board_counts"] = f"""WITH {APPS}, {BOOKMARKS}, t AS (SELECT user_id, {counts},
  count(*) AS application_count FROM apps GROUP BY user_id),
s AS (SELECT user_id, count(*) AS saved_count FROM bookmarks GROUP BY user_id)
SELECT user_id, coalesce(saved_stage, 0) AS saved_stage, coalesce(applied_stage, 0)
  AS applied_stage, coalesce(interviewing_stage, 0) AS interviewing_stage,
  coalesce(rejected_stage, 0) AS rejected_stage, coalesce(offer_stage, 0) AS offer_stage,
  coalesce(application_count, 0) AS application_count, coalesce(saved_count, 0) AS saved_count
  FROM t FULL JOIN s USING (user_id)"""
    q["recent_activity"] = f"""WITH {POSTINGS}, {USERS}, {APPS}, {NOTES} SELECT a.id, u.email,
  p.title, p.company, a.stage, a.stage_updated_at, count(n.application_id) AS interview_notes
  FROM apps a JOIN users u ON u.id = a.user_id JOIN postings p ON p.id = a.job_posting_id
  LEFT JOIN notes n ON n.application_id = a.id GROUP BY ALL
  ORDER BY a.stage_updated_at DESC, a.id LIMIT 25"""
    q["stale_applications"] = f"""WITH {POSTINGS}, {USERS}, {APPS} SELECT a.id, u.email,
  a.job_posting_id, p.title, p.company, a.stage_updated_at,
  (DATE '1998-01-01' - a.stage_updated_at::DATE)::INTEGER AS days_without_update
  FROM apps a JOIN users u ON u.id = a.user_id JOIN postings p ON p.id = a.job_posting_id
  WHERE a.stage = 'applied' AND a.stage_updated_at < TIMESTAMP '1998-01-01' - INTERVAL 14 DAY"""
    q["stale_oldest_first"] = f"""SELECT id, email, stage_updated_at, row_number() OVER (
  PARTITION BY email ORDER BY stage_updated_at, id) AS rank FROM ({q["stale_applications"]})
  QUALIFY rank <= 5"""
    q["stale_flag_refresh"] = f"""WITH {APPS}, f AS (SELECT *, stage = 'applied'
  AND stage_updated_at < TIMESTAMP '1998-01-01' - INTERVAL 14 DAY AS is_stale FROM apps)
SELECT id, stage, stage_updated_at, is_stale, CASE WHEN is_stale THEN
  CASE WHEN month(stage_updated_at) % 2 = 0 THEN TIMESTAMP '1997-12-01'
  ELSE TIMESTAMP '1998-01-01' END END AS stale_flagged_at FROM f"""
    q["feedback_distribution"] = f"""WITH {FEEDBACK} SELECT feedback, count(*) AS responses
  FROM feedback GROUP BY feedback"""
    q["recent_feedback"] = f"""WITH {POSTINGS}, {USERS}, {FEEDBACK} SELECT f.id, u.email, p.title,
  p.company, f.feedback, f.reason, f.updated_at FROM feedback f JOIN users u ON u.id = f.user_id
  JOIN postings p ON p.id = f.job_posting_id ORDER BY f.updated_at DESC, f.id LIMIT 30"""
    q["saved_with_posting"] = f"""WITH {POSTINGS}, {BOOKMARKS} SELECT b.user_id, b.job_posting_id,
  b.note, b.saved_at, p.title, p.company, p."location" FROM bookmarks b
  JOIN postings p ON p.id = b.job_posting_id"""
    q["note_ownership"] = f"""WITH {APPS}, {NOTES} SELECT n.application_id, n.user_id,
  a.id IS NOT NULL AS accepted, count(*) AS notes FROM notes n LEFT JOIN apps a
  ON a.id = n.application_id AND a.user_id = n.user_id GROUP BY ALL"""
    q["feedback_fold"] = f"WITH {FEEDBACK} SELECT * FROM feedback"
    q["application_fold"] = f"""WITH {STAGES} SELECT {_HASH_OF_TWO} AS id, user_id, job_posting_id,
  coalesce(arg_max(profile_id, (ts, seq)) FILTER (stage IS NULL AND profile_id IS NOT NULL),
    first(profile_id ORDER BY ts, seq)) AS profile_id,
  coalesce(arg_max(stage, (ts, seq)) FILTER (stage IS NOT NULL), 'saved') AS stage,
  coalesce(max(ts) FILTER (stage IS NOT NULL), min(ts)) AS stage_updated_at,
  min(ts) FILTER (stage = 'applied') AS applied_at, min(ts) AS created_at FROM sa
  GROUP BY user_id, job_posting_id"""
    q["bookmark_fold"] = f"WITH {BOOKMARKS} SELECT * FROM bookmarks"
    moves = ", ".join(f"'{a}>{b}'" for a, b in queries.domains.STAGE_MOVES)
    q["stage_transitions"] = f"""WITH {STAGES}, m AS (SELECT lag(stage) OVER (PARTITION BY user_id,
  job_posting_id ORDER BY ts, seq) AS previous_stage, stage FROM sa WHERE stage IS NOT NULL)
SELECT previous_stage, stage, previous_stage || '>' || stage IN ({moves}) AS allowed,
  count(*) AS moves FROM m WHERE previous_stage IS NOT NULL GROUP BY ALL"""
    q["user_upsert"] = f"""WITH {USERS}, log AS (SELECT 'customer#' || lpad(user_id::VARCHAR, 9, '0')
  || CASE WHEN event_type = 'error' THEN '@new.example.com' ELSE '@example.com' END AS email,
  CASE WHEN event_type = 'signup' THEN 'Name ' || event_id END AS name, ts, event_id AS seq
  FROM events), f AS (SELECT email, arg_max(name, (ts, seq)) FILTER (name IS NOT NULL) AS name,
  min(ts) AS first_ts FROM log GROUP BY email)
SELECT coalesce(u.id, sha256(email)) AS id, email, coalesce(f.name, u.display_name)
  AS display_name, coalesce(u.created_at, f.first_ts) AS created_at
  FROM users u FULL JOIN f USING (email)"""
    q["posting_upsert"] = f"""WITH {RAW}, s AS (SELECT id, category,
  {_clean('description_text')} AS old, {_clean("'updated ' || description_text")} AS new,
  {_clean('title')} AS title FROM raw)
SELECT id, category, sha256(CASE WHEN category IN ('de', 'en') AND length(new) >= 40 THEN new
    ELSE old END) AS content_hash,
  CASE WHEN category IN ('de', 'en') AND length(new) >= 40 THEN TIMESTAMP '2024-06-08'
    ELSE TIMESTAMP '2024-06-01' END AS synced_at FROM s WHERE length(title) > 0
  AND ((category IN ('de', 'en') AND length(new) >= 40)
    OR (category <> 'de' AND length(old) >= 40))"""
    english = _BODY + " WHERE category = 'en'"
    others = _BODY + " WHERE category <> 'en'"
    q["chunk_replace"] = f"""WITH {POSTINGS} SELECT job_posting_id, count(*) AS chunks,
  sum(length(chunk_text))::BIGINT AS n_chars FROM (SELECT * FROM {_chunked(others, 1000, 150)}
  UNION ALL SELECT * FROM {_chunked(english, 500, 100)}) GROUP BY job_posting_id"""
    q["skill_gap_scan"] = _skill_gap("contains({}, skill)")
    q["skill_gap_words"] = _skill_gap(
        r"list_contains(regexp_split_to_array({}, '[^\pL\pN\pM_]+'), skill)")
    q["skill_gap_ranked"] = f"""SELECT *, row_number() OVER (PARTITION BY profile_id
  ORDER BY present_in_resume, jobs_mentioning DESC, skill) AS rank FROM ({q["skill_gap_scan"]})"""
    gap = _skill_gap("contains({}, skill)")
    q["skill_gap_summary"] = f"""WITH g AS ({gap}), {APPS}, looked AS (SELECT profile_id,
  count(DISTINCT job_posting_id) AS n FROM apps GROUP BY profile_id)
SELECT l.profile_id, any_value(n) AS jobs_analyzed,
  count(*) FILTER (NOT present_in_resume) AS missing_skills,
  count(*) FILTER (present_in_resume) AS present_skills
  FROM looked l LEFT JOIN g USING (profile_id) GROUP BY l.profile_id"""
    terms = ", ".join(f"('{t}')" for t in queries.TERMS)
    q["skill_mentions"] = f"""WITH {POSTINGS}, terms(skill) AS (VALUES {terms})
  SELECT skill, count(*) AS jobs_mentioning FROM postings, terms
  WHERE contains(lower(description_text), skill) GROUP BY skill"""
    q["skill_gap_except"] = f"""WITH {APPS}, {SKILLS} SELECT profile_id, skill_id FROM required
  EXCEPT SELECT profile_id, skill_id FROM oskill"""
    q["skill_present_intersect"] = f"""WITH {APPS}, {SKILLS} SELECT profile_id, skill_id
  FROM required INTERSECT SELECT profile_id, skill_id FROM oskill"""
    q["listing_risk"] = _risk(False)
    q["listing_risk_checked"] = _risk(True)
    orphan = lambda child, col, parent, key: (
        f"SELECT '{child}' AS child, '{col}' AS child_column, '{parent}' AS parent, "
        f"count(*) AS orphans FROM {{{child}}} c WHERE {col} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {{{parent}}} p WHERE p.{key} = c.{col})")
    names = {"users": "users", "profiles": "profiles", "job_postings": "postings",
             "applications": "apps", "interview_notes": "notes",
             "job_posting_embeddings": "chunks", "job_feedback": "feedback",
             "saved_jobs": "saved"}
    checks = [orphan(*r) for r in [
        ("profiles", "user_id", "users", "id"), ("applications", "user_id", "users", "id"),
        ("applications", "profile_id", "profiles", "id"),
        ("applications", "job_posting_id", "job_postings", "id"),
        ("saved_jobs", "user_id", "users", "id"),
        ("saved_jobs", "job_posting_id", "job_postings", "id"),
        ("interview_notes", "application_id", "applications", "id"),
        ("job_posting_embeddings", "job_posting_id", "job_postings", "id"),
        ("job_feedback", "user_id", "users", "id"),
        ("job_feedback", "job_posting_id", "job_postings", "id"),
        ("job_postings", "id", "job_posting_embeddings", "job_posting_id"),
        ("users", "id", "applications", "user_id")]]
    saved = BOOKMARKS[len(ACTIONS) + 2:] + ", saved AS (SELECT * FROM bookmarks)"
    q["orphans"] = (
        f"WITH {CHUNKS}, {USERS}, {PROFILES}, {APPS}, {NOTES}, {FEEDBACK}, {saved} "
        + " UNION ALL ".join(checks).format(**names))
    q["duplicate_keys"] = f"""WITH {APPS} SELECT user_id, job_posting_id, count(*) AS copies
  FROM apps GROUP BY user_id, job_posting_id HAVING count(*) > 1"""
    q["domain_violations"] = """SELECT 'stage' AS column_name, lower(string_split(o_orderpriority,
  '-')[-1]) AS bad_value, count(*) AS bad_rows FROM orders WHERE lower(string_split(
  o_orderpriority, '-')[-1]) NOT IN ('saved','applied','interviewing','rejected','offer','low',
  'high') GROUP BY 1, 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders
  WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1, 2"""
    cols = ["id", "title", "location", "remote", "salary_max", "apply_url", "posted_at"]
    q["missing_values"] = f"WITH {POSTINGS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS missing_rows FROM postings"
        for c in cols)
    absent = "(SELECT count(*) FROM apps)"
    kinds = {"match_score": "double", "created_at": "timestamp", "is_stale": "boolean",
             "stale_flagged_at": "timestamp", "stage_updated_at": "timestamp",
             "applied_at": "timestamp"}
    here = ["id", "user_id", "profile_id", "job_posting_id", "stage", "stage_updated_at",
            "applied_at"]
    gone = ["match_score", "match_reasoning", "notes", "created_at", "is_stale",
            "stale_flagged_at"]
    q["schema_conformance"] = f"WITH {APPS} " + " UNION ALL ".join(
        [f"SELECT '{c}' AS column_name, '{kinds.get(c, 'string')}' AS expected_type, "
         f"'{'timestamp_ntz' if c in kinds else 'string'}' AS actual_type, "
         f"count(*) - count({c}) AS missing_rows FROM apps" for c in here]
        + [f"SELECT '{c}', '{kinds.get(c, 'string')}', 'absent', {absent}" for c in gone])
    q["table_inventory"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (
            "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
            "documents", "embeddings", "pages", "benchmark", "labels", "conversations"))
    q["label_mix"] = """SELECT quality::VARCHAR AS quality, toxic::VARCHAR AS toxic, count(*) AS postings,
  count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"""
    mail = """CASE n % 5 WHEN 0 THEN 'A' || n || '@Example.com' WHEN 1 THEN 'not-an-email'
  WHEN 2 THEN '@start' WHEN 3 THEN 'end@' END"""
    errors = _errors(
        "CASE WHEN name IS NULL THEN 'name is required.' END",
        "CASE WHEN length(role) > 200 THEN 'role must be 200 characters or fewer.' END",
        "CASE WHEN length(notes) > 5000 THEN 'notes must be 5,000 characters or fewer.' END",
        """CASE WHEN n % 5 <> 0 THEN 'Enter a valid email address.' END""")
    q["contact_validation"] = f"""SELECT n AS contact_id, name, NULL::VARCHAR AS company,
  {mail} AS email, {errors} AS errors FROM (SELECT c_custkey AS n,
    CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS name,
    repeat(c_mktsegment, c_custkey % 40) AS role, trim(repeat('note ', c_custkey % 1100)) AS notes
    FROM customer)"""
    perrors = _errors(
        "CASE WHEN trim(label) = '' THEN 'label is required.' END",
        "CASE WHEN length(trim(label)) > 100 THEN 'label must be 100 characters or fewer.' END",
        "CASE WHEN pref NOT IN ('remote_only','hybrid','onsite','any') THEN "
        "'remote_preference must be one of: remote_only, hybrid, onsite, any' END",
        "CASE WHEN sal < 0 THEN 'salary_min cannot be negative.' END")
    q["profile_validation"] = f"""SELECT n AS profile_id, pref AS remote_preference,
  nullif(sal, 0) AS salary_min, 'a|b|' || trim(o_orderpriority) AS target_roles,
  array_to_string(list_transform(generate_series(0, least(19, n % 30)), lambda x: x::VARCHAR), '|')
    AS locations_preferred, {perrors} AS errors FROM (SELECT o_orderkey AS n, o_orderpriority,
    CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE repeat('label', o_orderkey % 30) END AS label,
    CASE o_orderkey % 4 WHEN 0 THEN 'hybrid' WHEN 2 THEN 'sometimes' ELSE 'any' END AS pref,
    CASE WHEN o_orderkey % 6 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN -o_totalprice
      ELSE o_totalprice END AS sal FROM orders)"""
    nerrors = _errors(
        "CASE WHEN l_returnflag = 'N' THEN 'note is required.' END",
        "CASE WHEN l_linenumber = 3 THEN 'interview_type must be one of: "
        "phone_screen, technical, onsite, behavioral, other' END",
        "CASE WHEN l_linenumber IN (5, 7) THEN 'follow_up_date must use YYYY-MM-DD.' END")
    q["note_validation"] = f"""SELECT {nerrors} AS errors, count(*) AS notes FROM lineitem
  GROUP BY 1"""
    kerrors = _errors(
        "CASE WHEN l_returnflag = 'N' THEN 'note is required.' END",
        "CASE WHEN l_linenumber = 3 THEN 'interview_type must be one of: "
        "phone_screen, technical, onsite, behavioral, other' END",
        "CASE WHEN l_linenumber = 5 THEN 'follow_up_date must use YYYY-MM-DD.' END")
    q["note_sink"] = f"""SELECT l_orderkey AS application_id, l_linenumber AS seq,
  CASE WHEN l_returnflag = 'N' THEN '  ' ELSE 'a note' END AS note,
  CASE l_linenumber WHEN 1 THEN 'phone_screen' WHEN 3 THEN 'lunch' END AS interview_type,
  CASE WHEN l_linenumber = 5 THEN 'tomorrow' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS follow_up_date,
  {kerrors} AS errors FROM lineitem"""
    rerrors = _errors(
        "CASE WHEN n % 11 = 0 THEN 'filename is required.' END",
        "CASE WHEN n % 11 <> 0 AND 5 * (n % 60 + 1) > 255 "
        "THEN 'filename must be 255 characters or fewer.' END",
        "CASE WHEN n % 13 = 0 OR coalesce(body, '') = '' THEN 'resume_text is required.' END",
        "CASE WHEN n % 13 <> 0 AND length(body) > 250000 "
        "THEN 'resume_text must be 250,000 characters or fewer.' END")
    q["resume_validation"] = f"""SELECT n AS resume_id, {rerrors} AS errors FROM (
  SELECT doc_id AS n, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body
  FROM documents)"""
    berrors = _errors(
        "CASE WHEN event_id % 9 = 0 THEN 'job_posting_id is required.' END",
        "CASE WHEN event_id % 9 <> 0 AND 7 * (event_id % 80 + 1) > 500 "
        "THEN 'job_posting_id must be 500 characters or fewer.' END",
        "CASE WHEN 5 * (event_id % 1100) - 1 > 5000 THEN 'note must be 5,000 characters or fewer.' END")
    q["bookmark_validation"] = f"SELECT event_id AS bookmark_id, {berrors} AS errors FROM events"
    ferrors = _errors(
        "CASE WHEN value > 30 THEN 'job_posting_id is required.' END",
        "CASE WHEN event_type IN ('click', 'signup') THEN "
        "'feedback must be good, bad, or skip.' END",
        "CASE WHEN floor(value) * 60 > 2000 THEN 'reason must be 2,000 characters or fewer.' END")
    q["feedback_validation"] = f"""SELECT {ferrors} AS errors, count(*) AS rows FROM events
  GROUP BY 1"""
    serrors = _errors(
        "CASE WHEN trim(text) = '' THEN 'query is required.' END",
        "CASE WHEN length(trim(regexp_replace(text, '\\s+$', ''))) > 2000 "
        "THEN 'query must be 2,000 characters or fewer.' END")
    q["search_validation"] = f"""SELECT role, {serrors} AS errors, count(*) AS requests
  FROM conversations GROUP BY 1, 2"""
    q["run_history"] = f"WITH {RUNS} SELECT * FROM runs ORDER BY started_at DESC, id LIMIT 20"
    q["latest_run"] = f"WITH {RUNS} SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 1"
    q["run_totals"] = f"""WITH {RUNS} SELECT status, count(*) AS runs,
  sum(fetched_rows)::BIGINT AS fetched_rows, max(started_at) AS last_started_at FROM runs
  GROUP BY status"""
    q["scalar_battery"] = f"""SELECT o_orderkey, lower(o_orderpriority) AS lowered,
  length(o_orderpriority)::INTEGER AS n_chars, left(o_orderpriority, 4) AS preview,
  contains(o_orderpriority, 'HIGH') AS is_high, o_orderpriority LIKE '%_-L%' AS is_like,
  o_orderpriority ILIKE '%low%' AS is_ilike,
  len(string_split(o_orderpriority, ' '))::INTEGER AS n_words,
  lower(o_orderstatus) || ':' || o_orderkey AS key, sha256(o_orderpriority) AS hash,
  (DATE '1998-01-01' - o_orderdate::DATE)::INTEGER AS days_since,
  TIMESTAMP '1998-01-01' - INTERVAL 14 DAY > o_orderdate AS is_old,
  {_iso('o_orderdate')} AS iso, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS number,
  greatest(1, least(25, o_orderkey % 100))::BIGINT AS clamped,
  round(o_totalprice / 7, 6) AS rounded,
  CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS filled,
  string_split(o_orderpriority, '-')[2] AS second, NULL::VARCHAR AS ninth,
  array_to_string(list_filter(regexp_split_to_array(o_orderpriority, '[- ]'),
    lambda x: x <> '')[1:2], '+') AS two, o_orderkey % 4 <> 3 AS flag, o_orderkey % 5 = 0 AS remote,
  CASE WHEN month(o_orderdate) <> 2 THEN strftime(o_orderdate, '%Y-%m-30') END
    AS day FROM orders"""
    q["vector_distances"] = f"""WITH {REQUESTS} SELECT vec_id, round(1 - {_DOT}, 6) AS distance
  FROM embeddings e JOIN requests r USING (label)"""
    q["vector_text"] = """SELECT vec_id, '[' || array_to_string(list_transform(embedding,
  lambda x: printf('%.9g', x::DOUBLE)), ',') || ']' AS vector FROM embeddings"""
    q["refresh_stream"] = f"""WITH {POSTINGS} SELECT id, title, content_hash, coalesce(n, 0)
  AS chunks FROM postings LEFT JOIN (SELECT job_posting_id, count(*) AS n
    FROM {_chunked(_BODY, 1000, 150)} GROUP BY job_posting_id) ON job_posting_id = id
  WHERE length(title) > 0 AND length(description_text) >= 40"""
    q["feedback_stream"] = q["feedback_fold"]
    q["application_stream"], q["bookmark_stream"] = q["application_fold"], q["bookmark_fold"]
    q["user_stream"] = """WITH log AS (SELECT 'customer#' || lpad(user_id::VARCHAR, 9, '0')
  || CASE WHEN event_type = 'error' THEN '@new.example.com' ELSE '@example.com' END AS email,
  CASE WHEN event_type = 'signup' THEN 'Name ' || event_id END AS name, ts, event_id AS seq
  FROM events)
SELECT sha256(email) AS id, email, arg_max(name, (ts, seq)) FILTER (name IS NOT NULL)
  AS display_name, min(ts) AS created_at FROM log GROUP BY email"""
    q["refresh_run"] = f"""WITH {FEED_A}, {FEED_B}, {FEED_C}, every AS (
  SELECT id AS job_posting_id, source, content_hash, title, body, reject_reason FROM a UNION ALL
  SELECT id, source, content_hash, title, body, reject_reason FROM b UNION ALL
  SELECT id, source, content_hash, title, body, reject_reason FROM c),
kept AS (SELECT * FROM every WHERE reject_reason IS NULL AND {_clean('title')} <> ''
  AND length(body) >= 40),
n AS (SELECT job_posting_id, count(*) AS n FROM {_chunked('SELECT * FROM kept', 1000, 150)}
  GROUP BY job_posting_id)
SELECT source, count(*) AS total_postings, count(n) AS embedded_postings,
  sum(n)::BIGINT AS total_chunks, count(*) AS logged_postings
  FROM kept LEFT JOIN n USING (job_posting_id) GROUP BY source"""
    return q
