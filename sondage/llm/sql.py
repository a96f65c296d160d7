"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text: stretches without ASCII white space.
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def similar_sql(k: int = 5, percent: int = 75) -> str:
    """Distinct shingles, pairs by shared shingles, and components by reachability."""
    words = WORDS.format(LOWER.format("coalesce(text, '')"))
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g
      FROM w),
    n AS (SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (
      SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
    SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""


CHAT = r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    f AS (
      SELECT *, length('<turn>') + length(replace(regexp_replace(role, '\\|</?turn>', '\\\0', 'g'), chr(10), '\' || chr(10))) + 1
        + length(regexp_replace(text, '\\|</?turn>', '\\\0', 'g')) + length('</turn>') + 1 AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars
    FROM f GROUP BY conv_id"""


def measures_sql(table: str = "documents") -> str:
    """The measures of ``quality.measure``, one row per document; needs distinct ids."""
    return f"""
    SELECT d.doc_id, d.source AS host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS n_symbols,
      coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
    FROM (SELECT *, {WORDS.format("coalesce(text, '')")} AS w FROM {table}) d
    LEFT JOIN (
      SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
        SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {table})
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1) dl USING (doc_id)
    LEFT JOIN (
      SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
            SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (
              SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM {table}))))
        WHERE c > 1) GROUP BY 1) rw USING (doc_id)"""


def quality_sql(table: str = "documents", rate: float = 0.5, columns: str = (
        "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_broken")) -> str:
    """``quality.judge``: measures, host rates shrunk by a beta prior, verdicts."""
    rules = {"symbols": "10 * n_symbols > n_words", "repeats": "100 * n_repeat_words > 20 * n_words",
             "lines": "10 * n_dup_lines > n_words", "length": "word_chars > 12 * n_words OR word_chars < 2 * n_words"}
    fails = ", ".join(f"({r}) AS {n}" for n, r in rules.items())
    sums = ", ".join(f"sum({n}::INT) AS {n}_f" for n in rules)
    means = ", ".join(f"sum({n}_f) / sum(docs) AS {n}_m" for n in rules)
    moments = ", ".join(f"sum(docs * power({n}_f / docs - {n}_m, 2)) / sum(docs) AS {n}_s, count(*) * any_value({n}_m * (1 - {n}_m)) / sum(docs) AS {n}_c" for n in rules)
    size = {n: f"least(greatest(CASE WHEN {n}_s > {n}_c THEN {n}_m * (1 - {n}_m) / ({n}_s - {n}_c) - 1 ELSE 1e6 END, 2), 1e6)" for n in rules}
    alpha = {n: f"CASE WHEN {n}_m > 0 AND {n}_m < 1 THEN {n}_m * {size[n]} ELSE 1 + {n}_m END" for n in rules}
    beta = {n: f"CASE WHEN {n}_m > 0 AND {n}_m < 1 THEN (1 - {n}_m) * {size[n]} ELSE 2 - {n}_m END" for n in rules}
    broken = ", ".join(f"(({n}_f + {alpha[n]}) / (docs + {alpha[n]} + {beta[n]})) > {rate} AS {n}_b" for n in rules)
    names = ", ".join(f"CASE WHEN {n}_b THEN '{n}' END" for n in rules)
    return f"""
    WITH m AS ({measures_sql(table)}),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {fails} FROM m),
    h AS (SELECT host, count(*) AS docs, {sums} FROM f GROUP BY host),
    a AS (SELECT {means} FROM h),
    v AS (SELECT {moments} FROM h, a),
    b AS (SELECT host, {broken} FROM h, a, v)
    SELECT {columns} FROM (
      SELECT f.*, NOT base_failed AND NOT ({" OR ".join(f"{n} AND {n}_b" for n in rules)}) AS kept,
        list_filter([{names}], lambda x: x IS NOT NULL) AS host_broken
      FROM f JOIN b ON f.host IS NOT DISTINCT FROM b.host)"""


EXACT = f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, by the table of one byte."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    digit = "strpos('123456789ABCDEF', substr(hex({0}), {1}, 1))"
    byte = f"(16 * {digit.format(text, '2 * i - 1')} + {digit.format(text, '2 * i')})::BIGINT"
    steps = f"list_concat([4294967295::BIGINT], list_transform(range(1, strlen({text}) + 1), lambda i: {byte}))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, list_extract({table}::BIGINT[], xor(c & 255, b) + 1))), 4294967295)"


RESAMPLE_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def resample_sql(buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> str:
    """Single words as features; counts by bucket, gains, weights, noise and the draw."""
    words = RESAMPLE_WORDS.format(LOWER.format("coalesce(text, '')"))
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    f AS (SELECT doc_id, unnest(w) AS w FROM d),
    g AS (SELECT unnest({words}) AS w FROM benchmark),
    v AS (SELECT w, {crc32_sql("w")} % {buckets} AS b FROM (SELECT w FROM f UNION SELECT w FROM g)),
    s AS (SELECT b, count(*) AS n FROM f JOIN v USING (w) GROUP BY b),
    t AS (SELECT b, count(*) AS n FROM g JOIN v USING (w) GROUP BY b),
    n AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
    k AS (
      SELECT s.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (n.s + {buckets})) / ((s.n + 1)::DOUBLE * (n.t + {buckets}))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (b), n),
    w AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN v USING (w) JOIN k USING (b) GROUP BY doc_id),
    x AS (
      SELECT doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w USING (doc_id)),
    r AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM x WHERE n_features >= {least})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor({percent} * n / 100) THEN place END AS rank, n_features AS n_words
    FROM x LEFT JOIN r USING (doc_id)"""


def repeats_sql(window: int = 13) -> str:
    """Windows as texts, the smallest document of each, and the words that no repeated window covers."""
    return f"""
    WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
    g AS (
      SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
    m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM g),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM m WHERE again),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    k AS (
      SELECT doc_id, count(c.i) AS n, string_agg(w[i], ' ' ORDER BY i) FILTER (c.i IS NULL) AS kept
      FROM (SELECT p.doc_id, p.i, p.w[p.i] AS x, p.w FROM p) q LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""


def repair_sql() -> str:
    """Damage, faults, and the program over whole audit strings, a row of a conversation a step."""
    cells = "(VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'u'), (1, 2, 'I', 'u'), (3, 2, 'I', 'u'), (2, 3, 'I', 'a'), (0, 3, 'II', 'ua'), (1, 3, 'II', 'ua'), (3, 3, 'II', 'ua'), (2, 2, 'II', 'au')) m(cell, mid, ins, roles)"
    # inserted turns as text: u and a are spelt out, the longer name by a mark first
    full = "replace(replace(replace({0}, 'a', '!'), 'u', chr(10) || 'user:'), '!', chr(10) || 'assistant:')"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
    WITH RECURSIVE k AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("key")} % 20 AS k
      FROM (SELECT *, {key} AS key FROM conversations)),
    b AS (
      SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
    n AS (
      SELECT *, role[1:1] AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
        regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM b),
    r AS (
      SELECT *, CASE WHEN last = '' THEN 1 WHEN seen THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM n),
    c AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
    s AS (
      SELECT conv_id, 0::BIGINT AS i, 0 AS cell, 0::BIGINT AS cost, '' AS audit, '' AS out FROM c
      UNION ALL
      SELECT conv_id, i, target, min(cost), arg_min(audit, (cost, audit)), arg_min(out, (cost, audit)) FROM (
        SELECT s.conv_id, r.i, e.target, s.audit || m.ins || e.edit AS audit,
          s.cost + 5 * len(m.ins) + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.edit <> 'D' AND fault = 3 THEN 5 ELSE 0 END AS cost,
          s.out || {full.format("m.roles")} || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
            ELSE chr(10) || CASE e.target WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text END AS out
        FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
        JOIN {cells} ON m.cell = s.cell
        JOIN (VALUES (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3), (0, 'K', 1), (0, 'K', 2), (1, 'K', 2), (3, 'K', 2), (2, 'K', 3),
          (0, 'R', 2), (1, 'R', 2), (3, 'R', 2), (2, 'R', 3)) e(mid, edit, target) ON e.mid = m.mid
        WHERE e.edit = 'D' OR (fault NOT IN (1, 2) AND (e.edit = 'R' OR ini = CASE e.target WHEN 1 THEN 's' WHEN 2 THEN 'u' ELSE 'a' END)))
      GROUP BY conv_id, i, target),
    z AS (
      SELECT c.*, s.cost + 5 * len(t.ins) AS total, s.audit || t.ins AS audit, s.out || {full.format("t.roles")} AS out
      FROM c JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n
      JOIN (VALUES (0, '', ''), (1, 'II', 'ua'), (2, 'I', 'a'), (3, '', '')) t(cell, ins, roles) ON t.cell = s.cell),
    y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total, audit) = 1)
    SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(total, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(out[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM k.conv_id"""


ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": similar_sql(),
    "op2_chat_formatting": CHAT,
    "op3_quality_rules": quality_sql(),
    "op5_exact_dedup": EXACT,
    "op11_importance_resampling": resample_sql(),
    "op12_substring_dedup": repeats_sql(),
    "op13_conversation_repair": repair_sql(),
}
