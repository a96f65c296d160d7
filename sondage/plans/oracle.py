"""DuckDB oracle SQL for the registered queries.

The SQL computes every result straight from the base tables (``events``,
``customer``, ``orders``, ``part``, ``nation``, ``region``), following the
fixture rules of FIXTURES.md, so it never repeats the Spark code path.
Timestamps are compared as UTC text (yyyy-MM-dd HH:MM:SS), doubles rounded to 4 decimals.
"""

from __future__ import annotations

from ..operators.store import FLAT_TABLE_PREFIX, RAW_TABLE_PREFIX

SI_EPOCH = 1704067200
ANCHOR = 1704067200          # Monday 2024-01-01 00:00:00 UTC
MAX_CATALOG = 1706140800     # 2024-01-25 00:00:00 UTC
SPLIT_PUBLISHED = SI_EPOCH + 86400 * 150
MISSING_AFTER = SI_EPOCH + 86400 * 60
TIME_FROM = 1704412800       # 2024-01-05 00:00:00
TIME_TO = 1705795199         # 2024-01-20 23:59:59
TIME_ONLY_FROM = 1705276800  # 2024-01-15 00:00:00
BASE_UNTIL = 1705708800      # first load: responses before 2024-01-20
BATCH_FROM = 1705276800      # next load re-fetches from 2024-01-15


def iso(x: str) -> str:
    """Epoch seconds -> ``YYYY-MM-DD HH:MM:SS`` text (UTC), as the Spark side renders timestamps."""
    return f"strftime(make_timestamp(({x}) * 1000000), '%Y-%m-%d %H:%M:%S')"


E = """e AS (
  SELECT event_id, event_type AS survey, user_id, ts, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sub,
         '24-1-' || CAST(day(ts) // 10 + 1 AS VARCHAR) AS version
  FROM events)"""


def flat_sql(where: str = "TRUE", q2: str = "CAST(k AS VARCHAR)") -> str:
    return f"""SELECT survey, 'r' || event_id AS id, 'p' || user_id AS global_id, version,
  {iso('sub')} AS "timestamp", {iso('sub - event_id % 600')} AS opened,
  CASE WHEN version = '24-1-4' THEN 'x' || k END AS EX_Q2,
  (k % 2 = 0) AS Q1_0,
  CASE WHEN k % 10 <> 0 THEN {q2} END AS Q2,
  CAST(k % 5 AS VARCHAR) AS Q3_lk_1,
  CAST(k % 3 AS VARCHAR) AS Q4_multi_row1_col2,
  CASE k % 4 WHEN 1 THEN '1' WHEN 2 THEN '1,2' WHEN 3 THEN '1,2,3' END AS Q5,
  CASE WHEN k % 11 <> 0 THEN {iso('sub - 86400 * (k % 7)')} END AS Q6
FROM e WHERE {where}"""


FLAT = f"WITH {E}, flat AS ({flat_sql()})"

Q5_JSON = """'{"items":[' || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '{"key":"1"}'
  WHEN 2 THEN '{"key":"1"},{"key":"2"}' ELSE '{"key":"1"},{"key":"2"},{"key":"3"}' END || ']}'"""

PAYLOAD_LONG = f"""kv AS (
  SELECT 'r' || event_id AS id, survey, version, 'ID' AS key, 'r' || event_id AS value FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, 'participantID', 'p' || user_id FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, 'version', version FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, 'submitted', CAST(sub AS VARCHAR) FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, 'opened', CAST(sub - event_id % 600 AS VARCHAR) FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.main.Q1|0',
    CASE WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.main.Q2', CAST(k AS VARCHAR) FROM e WHERE k % 10 <> 0
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.main.Q3|likert_1', CAST(k % 5 AS VARCHAR) FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.main.Q4|mat.row1.col2', CAST(k % 3 AS VARCHAR) FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.main.Q5', {Q5_JSON} FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.main.Q6',
    CASE WHEN k % 11 = 0 THEN '' ELSE CAST(sub - 86400 * (k % 7) AS VARCHAR) END FROM e
  UNION ALL SELECT 'r' || event_id, survey, version, survey || '.EX.Q2', 'x' || k FROM e WHERE version = '24-1-4')"""

KEYS = f"WITH {E}, {PAYLOAD_LONG}, keys AS (SELECT DISTINCT key FROM kv)"

P = """p AS (
  SELECT c_custkey, 'p' || c_custkey AS participantId, c_acctbal, c_mktsegment AS segment,
    CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 'temporary' WHEN c_custkey % 10 = 1 THEN 'inactive' ELSE 'active' END AS studyStatus,
    c_custkey % 13 <> 0 AS has_minor,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 2 AS VARCHAR) END AS minor,
    c_custkey % 17 = 0 AS is_nan,
    c_custkey % 17 <> 0 AND c_custkey % 19 = 0 AS is_invalid
  FROM customer)"""

SI = f"""si AS (
  SELECT p_partkey, p_brand AS survey,
    '24-' || CAST(p_size % 12 + 1 AS VARCHAR) || '-' || CAST(p_partkey % 3 + 1 AS VARCHAR) AS version,
    'Q' || CAST(p_size AS VARCHAR) AS "column",
    CASE p_partkey % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'multiple' WHEN 2 THEN 'date' ELSE 'unknown' END AS questionType,
    CAST({SI_EPOCH} + 86400 * (30 * (p_size % 12) + p_partkey % 3) AS BIGINT) AS published,
    p_size % 12 + 1 AS v2, p_partkey % 3 + 1 AS v3
  FROM part),
st AS (SELECT survey, version, "column", published, v2, v3,
    CASE questionType WHEN 'multiple' THEN 'bool' WHEN 'date' THEN 'date' WHEN 'unknown' THEN 'json' ELSE 'text' END AS type
  FROM si)"""

U = """u AS (
  SELECT c_custkey AS user_key, c_name || '@' || (['a.org','b.org','skip.test'])[c_nationkey % 3 + 1] AS email,
    c_custkey % 11 = 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS empty
  FROM customer)"""


def R4(x: str) -> str:
    return f"CAST(round({x}, 4) AS DOUBLE)"


ORACLE: dict[str, str] = {}

ORACLE["scan_raw"] = f"""WITH {E}
SELECT survey, 'r' || event_id AS id, sub AS submitted, version FROM e
WHERE sub >= {TIME_FROM} AND sub <= {TIME_TO}"""

ORACLE["time_range_filter"] = f"""WITH {E}
SELECT survey, 'r' || event_id AS id, sub AS submitted FROM e WHERE sub >= {TIME_ONLY_FROM}"""

ORACLE["decode_payload"] = f"""WITH {E}, {PAYLOAD_LONG} SELECT id, key, value FROM kv"""

ORACLE["quarantine_rows"] = f"""WITH {E}
SELECT survey, CAST(count(*) AS BIGINT) AS n_bad FROM e WHERE event_id % 97 = 0 GROUP BY survey"""

ORACLE["recode_flags"] = f"""WITH {E}
SELECT 'r' || event_id AS id, 'BOOLEAN' AS q1_type, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS q1,
  CASE WHEN k % 10 <> 0 THEN 'STRING' END AS q2_type, CASE WHEN k % 10 <> 0 THEN '"' || k || '"' END AS q2,
  'OBJECT' AS q5_type, {Q5_JSON} AS q5, 'BIGINT' AS submitted_type, CAST(sub AS VARCHAR) AS submitted FROM e"""

ORACLE["flatten_survey_info"] = f"""WITH {SI}
SELECT survey, version, published, "column" AS question, questionType FROM si"""

ORACLE["participants_by_status"] = f"""WITH {P}
SELECT participantId, studyStatus FROM p WHERE studyStatus = 'active'"""

ORACLE["id_list"] = """SELECT DISTINCT id FROM (
  SELECT 'p' || o_custkey AS id FROM orders UNION ALL SELECT 'p' || (o_custkey % 7) FROM orders
  UNION ALL SELECT unnest(['l' || c_custkey, 'j' || c_custkey, 'j0', 'k' || c_custkey, 'k0', 'v' || c_custkey, 'v0']) FROM customer)"""

PERIOD = f"CAST({ANCHOR} + floor((sub - {ANCHOR}) / 604800) * 604800 AS BIGINT)"
FILE_TIME = lambda x: f"strftime(make_timestamp(({x}) * 1000000), '%Y-%m-%d-%H-%M-%S')"

ORACLE["export_roundtrip"] = f"""{FLAT},
f AS (SELECT flat.*, e.sub, {PERIOD} AS period_start FROM flat JOIN e ON flat.id = 'r' || e.event_id),
n AS (SELECT survey, period_start, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2),
c AS (UNPIVOT (SELECT survey, id, version, sub AS submitted, period_start, Q2, Q3_lk_1 AS Q3_likert_1, Q4_multi_row1_col2, Q5, EX_Q2 FROM f)
  ON Q2, Q3_likert_1, Q4_multi_row1_col2, Q5, EX_Q2 INTO NAME key VALUE value)
SELECT survey, id, version, submitted, key, value, value AS long_value, period_start, n,
  survey || '_responses_' || {FILE_TIME('period_start')} || '_' || {FILE_TIME('period_start + 604800')} || '.csv' AS file
FROM c JOIN n USING (survey, period_start)"""

ORACLE["wide_to_long"] = f"""{FLAT}
SELECT id, key, value FROM (UNPIVOT (SELECT id, Q2, Q3_lk_1, Q4_multi_row1_col2, Q5, EX_Q2 FROM flat)
  ON Q2, Q3_lk_1, Q4_multi_row1_col2, Q5, EX_Q2 INTO NAME key VALUE value)"""

ORACLE["long_to_wide"] = f"""{FLAT}
SELECT id, Q2, Q3_lk_1, Q4_multi_row1_col2, Q5, EX_Q2 FROM flat"""

LONG = """lv AS (
  SELECT p_partkey, array_to_string(list_transform(range(1, CAST(p_partkey % 9 + 2 AS BIGINT)),
    lambda i: CAST((p_partkey * i) % 4 + CASE WHEN (p_partkey + i) % 11 = 0 THEN 20240101120000 ELSE 0 END AS VARCHAR)), '-') AS version FROM part)"""


def PARTS(v: str) -> str:
    """Nine numbers, missing ones 0: their order is the order of versions."""
    return f"list_resize(list_transform(string_split({v}, '-'), lambda x: CAST(x AS BIGINT)), 9, 0)"


ORACLE["version_order"] = f"""WITH {E}, {SI}, {LONG}, v AS (
  SELECT DISTINCT version FROM si UNION SELECT DISTINCT version FROM e UNION SELECT DISTINCT version FROM lv)
SELECT version, CAST(dense_rank() OVER (ORDER BY {PARTS('version')}) AS BIGINT) AS rank FROM v"""

#: Ranges over short and long versions, one open, a single version, exclusions.
VERSION_SELECTOR = [["24-2-1:24-6-3", "24-9-2, !24-4-1:24-4-3"], "1-1:1-1-20240101120000-2", "20240101120000:", "!20240101120001-2"]

ORACLE["version_filter"] = f"""WITH {SI}, {LONG}, v AS (
  SELECT p_partkey, version FROM si UNION ALL SELECT p_partkey, version FROM lv),
p AS (SELECT *, {PARTS('version')} AS p FROM v)
SELECT p_partkey, version FROM p
WHERE (p BETWEEN {PARTS("'24-2-1'")} AND {PARTS("'24-6-3'")} OR p = {PARTS("'24-9-2'")}
    OR p BETWEEN {PARTS("'1-1'")} AND {PARTS("'1-1-20240101120000-2'")} OR p >= {PARTS("'20240101120000'")})
  AND NOT p BETWEEN {PARTS("'24-4-1'")} AND {PARTS("'24-4-3'")} AND p <> {PARTS("'20240101120001-2'")}"""

ORACLE["rename_strip_prefix"] = f"""{KEYS}
SELECT key AS source, regexp_replace(key, '^(?:[^|]*\\.)?([^.|]*)((?:\\|.*)?)$', '\\1\\2') AS target FROM keys"""

ORACLE["rename_regex"] = f"""{KEYS}
SELECT key AS source,
  regexp_replace(regexp_replace(key, '\\|mat\\.row(\\d+)\\.col(\\d+)', '|multi_row\\1_col\\2', 'i'),
                 '\\|likert_(\\d+)', '|lk_\\1', 'i') AS target FROM keys"""

ORACLE["rename_fixed"] = f"""{KEYS}
SELECT key AS source, CASE key WHEN 'ID' THEN 'id' WHEN 'participantID' THEN 'global_id'
  WHEN 'submitted' THEN 'timestamp' ELSE key END AS target FROM keys"""

DEFAULT_TARGET = """CASE WHEN key IN ('submitted','language','participantID','engineVersion','opened','ID')
    THEN CASE key WHEN 'ID' THEN 'id' WHEN 'participantID' THEN 'global_id' WHEN 'submitted' THEN 'timestamp' ELSE key END
  ELSE replace(regexp_replace(regexp_replace(
      regexp_replace(key, '^(?:[^|]*\\.)?([^.|]*)((?:\\|.*)?)$', '\\1\\2'),
      '\\|mat\\.row(\\d+)\\.col(\\d+)', '|multi_row\\1_col\\2', 'i'), '\\|likert_(\\d+)', '|lk_\\1', 'i'), '|', '_')
  END"""

ORACLE["default_rename"] = f"""{KEYS}
SELECT key AS source, {DEFAULT_TARGET} AS target FROM keys"""

ORACLE["rename_plan"] = f"""WITH {E}, {PAYLOAD_LONG},
m AS (SELECT DISTINCT survey, version, key FROM kv),
t AS (SELECT survey, version, key AS source, {DEFAULT_TARGET} AS target FROM m)
SELECT survey, version, source, target,
  CAST(count(*) OVER (PARTITION BY survey, version, lower(target)) AS BIGINT) AS n_sources FROM t"""

ORACLE["rename_collisions"] = f"""WITH {E}, {PAYLOAD_LONG},
m AS (SELECT DISTINCT survey, version, key FROM kv),
t AS (SELECT survey, version, key AS source, {DEFAULT_TARGET} AS target FROM m)
SELECT survey, version, lower(target) AS target, CAST(count(*) AS BIGINT) AS n_sources,
  string_agg(source, ',' ORDER BY source) AS sources
FROM t GROUP BY survey, version, lower(target) HAVING count(*) > 1"""

ORACLE["header_rename"] = f"""{FLAT}
SELECT id, Q1_0 AS q1_0, Q3_lk_1 AS q3_likert_1, Q4_multi_row1_col2 AS q4_multi_row1_col2 FROM flat"""

ORACLE["select_columns"] = f"""{FLAT}
SELECT id, EX_Q2, Q1_0, Q3_lk_1, Q4_multi_row1_col2 FROM flat"""

ORACLE["project_fields"] = f"""WITH {P} SELECT participantId AS pid, studyStatus AS status FROM p"""

ORACLE["cast_bool"] = f"""WITH {P}
SELECT participantId, CASE WHEN has_minor AND minor IS NOT NULL THEN minor = '1' END AS minor FROM p"""

ORACLE["cast_epoch"] = f"""WITH {E}
SELECT 'r' || event_id AS id, CASE WHEN k % 11 <> 0 THEN {iso('sub - 86400 * (k % 7)')} END AS q6 FROM e"""

ORACLE["json_item_keys"] = f"""WITH {E}
SELECT 'r' || event_id AS id, CASE k % 4 WHEN 1 THEN '1' WHEN 2 THEN '1,2' WHEN 3 THEN '1,2,3' END AS q5 FROM e"""

ORACLE["json_flatten"] = """SELECT event_id, json_extract_string(props, '$.k') AS props_k FROM events"""

ORACLE["schema_cast"] = f"""WITH {E}
SELECT 'r' || event_id AS id, k % 2 = 0 AS q1,
  CASE k % 4 WHEN 1 THEN '1' WHEN 2 THEN '1,2' WHEN 3 THEN '1,2,3' END AS q5,
  CASE WHEN k % 11 <> 0 THEN {iso('sub - 86400 * (k % 7)')} END AS q6, {iso('sub')} AS submitted FROM e"""

ORACLE["cast_selected"] = f"""WITH {E}
SELECT 'r' || event_id AS id, version, k % 2 = 0 AS q1, CAST(k % 5 AS VARCHAR) AS q3 FROM e"""

ORACLE["localized_text"] = """SELECT n_nationkey, n_name || ' ' || r_name AS en,
  '[en]  ' || n_name || ' ' || r_name || ';[fr]  ' || lower(n_name) AS all_text
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"""

ORACLE["localize_map"] = """SELECT n_nationkey, CAST(0 AS INTEGER) AS pos, 'en' AS code, n_name AS text FROM nation
UNION ALL SELECT n_nationkey, CAST(1 AS INTEGER), 'fr', lower(n_name) FROM nation"""

ORACLE["published_iso"] = f"""WITH {SI},
t AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '0' WHEN p_partkey % 10 = 0 THEN CAST(published AS VARCHAR)
  ELSE substr(published || '123456789', 1, CAST(p_partkey % 19 AS INTEGER)) END AS s FROM si),
n AS (SELECT p_partkey, TRY_CAST(s AS BIGINT) AS n FROM t)
SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 253402300799 THEN strftime(make_timestamp(n * 1000000), '%Y-%m-%dT%H:%M:%S')
  ELSE 'Unknown' END AS published_iso FROM n"""

ORACLE["midnight_floor"] = f"""WITH {E}
SELECT 'r' || event_id AS id, CAST(epoch_us(date_trunc('day', ts)) // 1000000 AS BIGINT) AS midnight FROM e"""

DISPATCH = """CASE version WHEN '24-1-1' THEN 'to_bool,default_casting,default_renaming,rename'
  WHEN '24-1-2' THEN 'to_bool,default_casting,custom,default_renaming,rename'
  WHEN '24-1-3' THEN 'default_casting,custom,default_renaming,custom,rename'
  ELSE 'default_casting,rename,custom,default_renaming,rename' END"""

#: Q4 is a boolean where some version casts it; the mark is set from 24-1-2 on, in capitals in 24-1-3.
ORDERED = f"""{FLAT}, o AS (SELECT survey, version, id, Q2, EX_Q2, Q1_0, Q3_lk_1 AS likert,
  CASE Q4_multi_row1_col2 WHEN '0' THEN false WHEN '1' THEN true END AS Q4_multi_row1_col2,
  CASE WHEN version = '24-1-3' THEN 'M' || coalesce(Q2, '-') WHEN version <> '24-1-1' THEN 'm' || coalesce(Q2, '-') END AS tag FROM flat)"""

ORACLE["version_dispatch"] = f"""{ORDERED}
SELECT survey, version, {DISPATCH} AS processors, max(likert) AS max_likert, CAST(count(Q4_multi_row1_col2) AS BIGINT) AS n_q4, max(tag) AS max_tag
FROM o GROUP BY survey, version"""

ORACLE["processor_order"] = f"""{ORDERED} SELECT id, Q2, EX_Q2, Q1_0, likert, Q4_multi_row1_col2, tag FROM o"""

ORACLE["build_flat"] = f"""WITH {E}, flat AS ({flat_sql("event_id % 97 <> 0")}) SELECT * FROM flat"""

ORACLE["build_rejects"] = f"""WITH {E}, r AS (
  SELECT survey, event_id, event_id % 97 = 0 AS lost FROM e WHERE event_id % 97 = 0
  UNION ALL SELECT survey, event_id, event_id % 97 = 0 FROM e WHERE event_id % 5 = 0)
SELECT survey, lost, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_id) AS BIGINT) AS n_ids FROM r GROUP BY 1, 2"""

ORACLE["build_plan"] = f"""{FLAT}
SELECT survey, '{FLAT_TABLE_PREFIX}' || survey AS "table", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(Q2) AS BIGINT) AS n_q2,
  CAST(count(EX_Q2) AS BIGINT) AS n_ex_q2, CAST(count(DISTINCT global_id) AS BIGINT) AS n_participants FROM flat GROUP BY survey"""

BASE = flat_sql(f"sub < {BASE_UNTIL}")
BATCH = flat_sql(f"sub >= {BATCH_FROM}", "'b' || CAST(k AS VARCHAR)")

#: A stored load, and a batch with rows dated a day later, without an id, or twice; of a key one row stays.
STORED = f"""WITH {E}, base AS (
  SELECT survey, 'r' || event_id AS id, sub AS submitted, version, CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS q2, 'r' || event_id AS payload_id
  FROM e WHERE sub < {BASE_UNTIL}),
moved AS (
  SELECT survey, CASE WHEN event_id % 101 <> 0 THEN 'r' || event_id END AS id, sub + CASE WHEN event_id % 6 = 0 THEN 86400 ELSE 0 END AS submitted,
    version, CASE WHEN k % 10 <> 0 THEN 'b' || k END AS q2, 'r' || event_id AS payload_id FROM e WHERE sub >= {BATCH_FROM}),
batch AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY survey, id ORDER BY submitted {{0}}, payload_id || '"' {{0}}) = 1)"""
SAME = "base.survey = batch.survey AND base.id IS NOT DISTINCT FROM batch.id"

ORACLE["upsert_ignore"] = f"""{STORED.format('ASC')}
SELECT * FROM base UNION ALL SELECT * FROM batch WHERE NOT EXISTS (SELECT 1 FROM base WHERE {SAME})"""

ORACLE["upsert_replace"] = f"""{STORED.format('DESC')}
SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM batch WHERE {SAME}) UNION ALL SELECT * FROM batch"""

ORACLE["evolve_schema"] = f"""WITH {E}, base AS ({BASE}), batch AS ({BATCH})
SELECT id, Q2, CAST(NULL AS VARCHAR) AS Q6 FROM base
UNION ALL SELECT id, Q2, Q6 FROM batch WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.id = batch.id)"""

ORACLE["registry_upsert"] = f"""WITH {E}, s AS (SELECT DISTINCT survey FROM e)
SELECT survey, '{RAW_TABLE_PREFIX}' || survey AS "table", 'raw' AS type FROM s
UNION ALL SELECT survey, '{FLAT_TABLE_PREFIX}' || survey, 'flat' FROM s"""

ORACLE["participant_dim"] = f"""WITH {E},
g0 AS (SELECT DISTINCT 'p' || user_id AS global_id FROM e WHERE sub < {BASE_UNTIL}),
g AS (SELECT DISTINCT 'p' || user_id AS global_id FROM e),
old AS (SELECT global_id, row_number() OVER (ORDER BY global_id) AS id FROM g0),
new AS (SELECT global_id, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY global_id) AS id
        FROM g WHERE global_id NOT IN (SELECT global_id FROM g0))
SELECT CAST(id AS BIGINT) AS id, global_id FROM old UNION ALL SELECT CAST(id AS BIGINT), global_id FROM new"""

ORACLE["survey_info_upsert"] = f"""WITH {SI}, v AS (SELECT DISTINCT survey, version, published, p_partkey % 5 <> 0 AS in_repo FROM si),
ex AS (SELECT DISTINCT survey, version, published FROM v WHERE in_repo),
bt AS (SELECT DISTINCT survey, version, published FROM v)
SELECT survey, version, published, 'existing' AS source FROM ex
UNION ALL SELECT survey, version, published, 'batch' FROM bt
  WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.survey = bt.survey AND ex.version = bt.version)"""

ORACLE["meta_check"] = f"""WITH {E}, s AS (
  SELECT survey, '|' AS sep FROM e UNION ALL SELECT survey, ';' FROM e WHERE sub >= {BATCH_FROM} AND length(survey) % 2 = 0)
SELECT survey, CAST(count(DISTINCT sep) AS BIGINT) AS n_values, count(DISTINCT sep) <= 1 AS consistent FROM s GROUP BY survey"""

ORACLE["import_log"] = f"""WITH {E}
SELECT survey, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, min(sub) AS start, max(sub) AS "end", CAST(count(*) AS BIGINT) AS n
FROM e GROUP BY survey, CAST(ts AS DATE)"""

WANTED = """w AS (SELECT 'p' || c_custkey AS participantId, CASE WHEN c_custkey % 12 <> 0 THEN '0' END AS want_minor
  FROM customer WHERE c_custkey % 4 = 0)"""
#: A flag without a value is always to be set.
MINOR_DIFFERS = "((CASE WHEN has_minor THEN minor END) IS NULL OR (CASE WHEN has_minor THEN minor END) IS DISTINCT FROM want_minor)"

ORACLE["flag_sync_diff"] = f"""WITH {P}, {WANTED},
j AS (SELECT p.*, want_minor FROM p JOIN w USING (participantId) WHERE studyStatus IS DISTINCT FROM 'temporary')
SELECT participantId, 'segment' AS flag, segment AS current, 'BUILDING' AS wanted FROM j WHERE segment IS DISTINCT FROM 'BUILDING'
UNION ALL
SELECT participantId, 'minor', CASE WHEN has_minor THEN minor END, want_minor FROM j WHERE {MINOR_DIFFERS}"""

ORACLE["flag_sync_summary"] = f"""WITH {P}, {WANTED},
j AS (SELECT p.*, (segment IS DISTINCT FROM 'BUILDING') OR {MINOR_DIFFERS} AS upd
      FROM p JOIN w USING (participantId) WHERE studyStatus IS DISTINCT FROM 'temporary')
SELECT (SELECT CAST(count(*) AS BIGINT) FROM w) AS in_file, CAST(count(*) AS BIGINT) AS found,
  CAST(count(*) FILTER (WHERE NOT upd) AS BIGINT) AS synced, CAST(count(*) FILTER (WHERE upd) AS BIGINT) AS to_update FROM j"""

PENDING = """pend AS (SELECT 'p' || c_custkey AS id FROM customer
  WHERE 'p' || c_custkey NOT IN (SELECT DISTINCT 'p' || user_id FROM events))"""

ORACLE["pending_ids"] = f"WITH {PENDING} SELECT id FROM pend"

ORACLE["work_batches"] = f"""WITH {PENDING}, top AS (SELECT id FROM pend ORDER BY id LIMIT 500)
SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS batch FROM top"""

ORACLE["missing_versions"] = f"""WITH {SI}, pub AS (SELECT DISTINCT survey, version, published FROM si),
repo AS (SELECT DISTINCT survey, version FROM si WHERE p_partkey % 5 <> 0)
SELECT survey, version, published FROM pub
WHERE published >= {MISSING_AFTER}
  AND NOT EXISTS (SELECT 1 FROM repo WHERE repo.survey = pub.survey AND repo.version = pub.version)"""

ORACLE["survey_name_map"] = """WITH s AS (SELECT DISTINCT p_brand AS survey FROM part),
m(survey, name) AS (VALUES ('Brand#1', 'intake'), ('Brand#2', 'weekly'), ('Brand#3', 'vaccination'))
SELECT s.survey, coalesce(m.name, s.survey) AS name FROM s LEFT JOIN m ON s.survey = m.survey"""

LATEST = """SELECT survey, "column", type FROM (
  SELECT survey, "column", type, row_number() OVER (PARTITION BY survey, "column"
    ORDER BY v2 DESC, v3 DESC, type DESC) AS rn FROM st WHERE {w}) WHERE rn = 1"""

ORACLE["schema_merge"] = f"""WITH {SI}, prev AS ({LATEST.format(w=f'published < {SPLIT_PUBLISHED}')}),
nw AS ({LATEST.format(w=f'published >= {SPLIT_PUBLISHED}')})
SELECT coalesce(prev.survey, nw.survey) AS survey, coalesce(prev."column", nw."column") AS "column",
  coalesce(prev.type, nw.type) AS type, nw.type AS new_type,
  CASE WHEN prev.type IS NULL THEN 'new' WHEN nw.type IS NULL OR prev.type = nw.type THEN 'kept' ELSE 'conflict' END AS status
FROM prev FULL OUTER JOIN nw ON prev.survey = nw.survey AND prev."column" = nw."column\""""

ORACLE["infer_schema"] = f"""WITH {SI} {LATEST.format(w='TRUE')}"""

ORACLE["type_conflicts"] = f"""WITH {SI}
SELECT survey, "column", CAST(count(DISTINCT type) AS BIGINT) AS n_types,
  string_agg(DISTINCT type, ',' ORDER BY type) AS types
FROM st GROUP BY survey, "column" HAVING count(DISTINCT type) > 1"""

ORACLE["flag_counts"] = f"""WITH {P}
SELECT 'segment' AS key, CAST(count(*) AS BIGINT) AS n FROM p
UNION ALL SELECT 'counter', CAST(count(*) AS BIGINT) FROM p
UNION ALL SELECT 'minor', CAST(count(*) AS BIGINT) FROM p WHERE has_minor"""

ORACLE["flag_category"] = f"""WITH {P}
SELECT coalesce(minor, '_NA_') AS value, CAST(count(*) AS BIGINT) AS n FROM p WHERE has_minor GROUP BY 1"""

VALID = "NOT is_nan AND NOT is_invalid"

ORACLE["flag_summary"] = f"""WITH {P}
SELECT CAST(count(*) FILTER (WHERE {VALID}) AS BIGINT) AS n,
  {R4(f'avg(c_acctbal) FILTER (WHERE {VALID})')} AS mean,
  {R4(f'var_pop(c_acctbal) FILTER (WHERE {VALID})')} AS var,
  {R4(f'min(c_acctbal) FILTER (WHERE {VALID})')} AS min,
  {R4(f'max(c_acctbal) FILTER (WHERE {VALID})')} AS max,
  CAST(count(*) FILTER (WHERE is_nan) AS BIGINT) AS nan,
  CAST(count(*) FILTER (WHERE is_invalid) AS BIGINT) AS invalid FROM p"""

ORACLE["multi_stats"] = f"""WITH {P}
SELECT 'counts' AS name, 'frequency' AS type, 'Field occurence frequency' AS label, key, CAST(n AS DOUBLE) AS value FROM (
  SELECT 'segment' AS key, count(*) AS n FROM p UNION ALL SELECT 'counter', count(*) FROM p
  UNION ALL SELECT 'minor', count(*) FROM p WHERE has_minor)
UNION ALL SELECT 'category_segment', 'frequency', 'Values frequency of field segment', segment, CAST(count(*) AS DOUBLE)
  FROM p GROUP BY segment
UNION ALL SELECT 'category_minor', 'frequency', 'Values frequency of field minor', coalesce(minor, '_NA_'),
  CAST(count(*) AS DOUBLE) FROM p WHERE has_minor GROUP BY coalesce(minor, '_NA_')
UNION ALL SELECT 'summary_counter', 'summary', 'Summary of field ''counter''', key, value FROM (
  SELECT unnest(['n','mean','var','min','max','nan','invalid']) AS key,
         unnest([CAST(count(*) FILTER (WHERE {VALID}) AS DOUBLE),
                 {R4(f'avg(c_acctbal) FILTER (WHERE {VALID})')}, {R4(f'var_pop(c_acctbal) FILTER (WHERE {VALID})')},
                 {R4(f'min(c_acctbal) FILTER (WHERE {VALID})')}, {R4(f'max(c_acctbal) FILTER (WHERE {VALID})')},
                 CAST(count(*) FILTER (WHERE is_nan) AS DOUBLE), CAST(count(*) FILTER (WHERE is_invalid) AS DOUBLE)]) AS value
  FROM p)"""

ORACLE["assigned_counts"] = """SELECT o_orderstatus AS surveyKey, o_orderpriority AS category, CAST(count(*) AS BIGINT) AS n
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 NOT IN (0, 1) AND c_custkey % 23 <> 0
GROUP BY o_orderstatus, o_orderpriority"""

ORACLE["response_counts"] = """SELECT event_type AS survey, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type"""

ORACLE["daily_counts"] = """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type AS survey, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2"""

ORACLE["time_bounds"] = f"""WITH {E} SELECT survey, min(sub) AS min_time, max(sub) AS max_time FROM e GROUP BY survey"""

ORACLE["version_counts"] = f"""WITH {E}, c AS (SELECT survey, version, count(*) AS n FROM e GROUP BY survey, version)
SELECT survey, version, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY survey) AS BIGINT) AS total,
  {R4('n * 100.0 / sum(n) OVER (PARTITION BY survey)')} AS percent FROM c"""

ORACLE["distinct_versions"] = f"""WITH {E} SELECT DISTINCT survey, version FROM e"""

ORACLE["describe_tables"] = f"""WITH {E}
SELECT 'raw' AS "table", CAST(count(*) AS BIGINT) AS rows, min(sub) AS min_time, max(sub) AS max_time FROM e
UNION ALL SELECT 'flat', CAST(count(*) AS BIGINT), min(sub), max(sub) FROM e"""

ORACLE["latest_version"] = f"""WITH {SI}
SELECT survey, version, published FROM si
QUALIFY row_number() OVER (PARTITION BY survey ORDER BY published DESC, v2 DESC, v3 DESC) = 1"""

ORACLE["counter_snapshot"] = """WITH c AS (
  SELECT event_type AS name, value, epoch_us(ts) AS time FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0)
SELECT name, value, time FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY time DESC, value DESC) AS rn FROM c) WHERE rn = 1"""

ORACLE["email_suffix_filter"] = f"""WITH {U} SELECT user_key, email FROM u WHERE NOT email LIKE '%skip.test'"""

ORACLE["skip_empty_profiles"] = f"""WITH {U} SELECT user_key FROM u WHERE NOT empty"""

ORACLE["main_profile_first"] = """SELECT c_custkey AS user_key,
  CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus <> 'O', o_orderkey) - 1 AS INTEGER) AS pos,
  CAST(o_orderkey AS VARCHAR) AS gid, o_orderstatus = 'O' AS main
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 11 <> 0"""

ORACLE["migration_report"] = f"""WITH {U}
SELECT CASE WHEN email LIKE '%skip.test' OR empty THEN 'skipped' ELSE 'created' END AS status,
  CASE WHEN email LIKE '%skip.test' THEN 'email_filter' WHEN empty THEN 'empty_profile' END AS reason,
  CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1, 2"""

ORACLE["migration_records"] = f"""WITH {U}, o AS (
  SELECT o_custkey, count(*) AS n, arg_min(CAST(o_orderkey AS VARCHAR), (o_orderstatus <> 'O', o_orderkey)) AS first_gid
  FROM orders GROUP BY o_custkey)
SELECT u.email AS accountId, CAST(CASE WHEN u.user_key % 11 = 0 THEN 0 ELSE coalesce(o.n, 0) END AS INTEGER) AS n_profiles,
  CASE WHEN u.user_key % 11 = 0 THEN NULL ELSE o.first_gid END AS first_gid, 'en' AS preferredLanguage,
  CASE WHEN email LIKE '%skip.test' OR empty THEN 'skipped' ELSE 'created' END AS status
FROM u LEFT JOIN o ON o.o_custkey = u.user_key"""

ORACLE["period_grid"] = f"""WITH {E}, b AS (SELECT survey, min(sub) // 86400 * 86400 AS start, max(sub) AS mx FROM e GROUP BY survey)
SELECT survey, CAST(ps AS BIGINT) AS period_start, CAST(ps + 604800 AS BIGINT) AS period_end
FROM b, unnest(range(start, mx, 604800)) AS t(ps)"""

ORACLE["period_catalog"] = f"""WITH {E}, c AS (
  SELECT survey, CAST({ANCHOR} + floor((sub - {ANCHOR}) / 604800) * 604800 AS BIGINT) AS start, count(*) AS n
  FROM e GROUP BY 1, 2)
SELECT survey, start, start + 604800 AS "end", CAST(n AS BIGINT) AS n,
  survey || '_responses_' || strftime(make_timestamp(start * 1000000), '%Y-%m-%d-%H-%M-%S') || '_'
    || strftime(make_timestamp((start + 604800) * 1000000), '%Y-%m-%d-%H-%M-%S') || '.csv' AS file
FROM c"""

ORACLE["catalog_violations"] = f"""WITH {E}, c AS (SELECT survey, version, min(sub) AS start, max(sub) AS "end" FROM e GROUP BY 1, 2),
l AS (SELECT *, lag("end") OVER (PARTITION BY survey ORDER BY start, "end") AS prev_end FROM c),
v AS (
  SELECT survey, start, "end", 'start_before_min' AS violation FROM l WHERE start < {ANCHOR}
  UNION ALL SELECT survey, start, "end", 'start_after_max' FROM l WHERE start > {MAX_CATALOG}
  UNION ALL SELECT survey, start, "end", 'end_before_min' FROM l WHERE "end" < {ANCHOR}
  UNION ALL SELECT survey, start, "end", 'end_after_max' FROM l WHERE "end" > {MAX_CATALOG}
  UNION ALL SELECT survey, start, "end", 'overlaps_previous' FROM l WHERE start < prev_end)
SELECT * FROM v"""

ORACLE["restart_point"] = f"""WITH {E} SELECT survey, CAST(max(sub) // 86400 * 86400 AS BIGINT) AS restart FROM e GROUP BY survey"""

ORACLE["ordered_page"] = f"""WITH {E}
SELECT survey, 'r' || event_id AS id, version, sub AS submitted FROM e ORDER BY version, sub, 'r' || event_id
LIMIT 100 OFFSET 200"""

ORACLE["stream_ingest"] = f"""WITH {E}, {PAYLOAD_LONG}
SELECT kv.survey, kv.id, kv.version, e.sub AS submitted, key,
  CASE WHEN key LIKE '%.main.Q1|0' THEN lower(kv.value) ELSE kv.value END AS value FROM kv JOIN e ON kv.id = 'r' || e.event_id"""

ORACLE["stream_build"] = f"""{FLAT} SELECT * FROM flat"""

ORACLE["stream_daily"] = ORACLE["daily_counts"]

ODD = "event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0"
ORACLE["strict_payloads"] = f"""WITH {E}
SELECT survey, CAST(count(*) FILTER (NOT ({ODD})) AS BIGINT) AS n_flat, CAST(count(*) FILTER ({ODD}) AS BIGINT) AS n_bad,
  CAST(count(*) FILTER ({ODD}) AS BIGINT) AS n_lost FROM e GROUP BY survey"""

ORACLE["typed_loads"] = """SELECT o_orderstatus AS survey, CAST(o_orderkey AS VARCHAR) AS id,
  CASE o_custkey % 4 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS a,
  CASE o_custkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN o_orderpriority WHEN 3 THEN CAST(o_custkey AS VARCHAR) END AS b,
  CASE WHEN o_custkey % 4 IN (1, 2) THEN CAST(o_orderkey AS BIGINT) END AS c FROM orders"""

ORACLE["stream_typed"] = ORACLE["typed_loads"]

ORACLE["landed_scan"] = ORACLE["scan_raw"]

ORACLE["stream_landed"] = ORACLE["stream_ingest"]

ORACLE["export_commit"] = f"""WITH {E}, p AS (
  SELECT survey, event_id, CAST(floor((sub - {ANCHOR}) / 604800.0) * 604800 + {ANCHOR} AS BIGINT) AS start FROM e)
SELECT survey, start, start + 604800 AS "end", CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_read,
  CAST(count(DISTINCT event_id) AS BIGINT) AS n_ids FROM p GROUP BY survey, start"""

ORACLE["keyed_ignore"] = ORACLE["upsert_ignore"]

ORACLE["keyed_replace"] = ORACLE["upsert_replace"]

ORACLE["keyed_daily"] = f"""SELECT {iso('submitted')}[1:10] AS day, survey, CAST(count(*) AS BIGINT) AS n
FROM ({ORACLE["upsert_replace"]}) GROUP BY ALL"""

ORACLE["watched_import"] = f"""WITH {E}
SELECT survey, min(sub) AS start, max(sub) AS "end", CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (event_id % 97 = 0) AS BIGINT) AS rejects, string_agg(DISTINCT version, ',' ORDER BY version) AS versions
FROM e GROUP BY survey"""

ORACLE["stream_state_daily"] = f"""SELECT *, CAST(0 AS BIGINT) AS late FROM ({ORACLE["daily_counts"]})"""
