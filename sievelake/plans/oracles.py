"""The queries of ``queries`` as SQL, written apart from them."""

from __future__ import annotations

from .queries import LOW_CEILING


def _at(ceiling: int = 2000) -> str:
    return f"""
up AS MATERIALIZED (
  SELECT coalesce(lang, '') AS user_id, doc_id AS file_id, doc_id AS upload_seq, text, strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256_hash,
         ['txt', 'md', 'csv', 'docx', 'pptx', 'xlsx', 'pdf', 'png'][doc_id % 8 + 1] AS extension, (doc_id % 5 + 1)::INTEGER AS units,
         substr(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z0-9 ]', '', 'g'), 1, 40) AS filename_stem
  FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
named AS (
  SELECT *, filename_stem || '.' || extension AS filename,
         CASE extension WHEN 'txt' THEN 'plain' WHEN 'md' THEN 'plain' WHEN 'csv' THEN 'plain' WHEN 'png' THEN 'unsupported' ELSE extension END AS format,
         row_number() OVER (PARTITION BY user_id, sha256_hash ORDER BY upload_seq) > 1 AS deduplicated,
         row_number() OVER (PARTITION BY user_id ORDER BY upload_seq) AS n_files
  FROM up),
measured AS (
  SELECT *, CASE format WHEN 'docx' THEN 1500 WHEN 'pptx' THEN 150 * units WHEN 'xlsx' THEN 4 * units WHEN 'pdf' THEN 1500 * units ELSE 0 END::INTEGER AS expected_min_chars,
         CASE WHEN format = 'unsupported' THEN 0 ELSE length(text) END::INTEGER AS actual_chars FROM named),
files AS MATERIALIZED (
  SELECT *, NOT deduplicated AND CASE format WHEN 'unsupported' THEN FALSE WHEN 'plain' THEN actual_chars > 0
         ELSE actual_chars >= expected_min_chars * 0.2::DOUBLE END AS ok FROM measured),
reasons AS (
  SELECT file_id, CASE WHEN deduplicated THEN NULL WHEN format = 'unsupported' THEN 'unsupported format: .' || extension
    WHEN ok THEN CASE format WHEN 'plain' THEN 'plain-text read directly' WHEN 'docx' THEN 'docx XML text nodes parsed' WHEN 'pptx' THEN 'pptx slide text parsed'
      WHEN 'xlsx' THEN 'xlsx shared/inline strings parsed' ELSE 'pdf text layer extracted' END
    ELSE CASE format WHEN 'plain' THEN 'empty plain-text file' WHEN 'docx' THEN 'docx text layer below confidence floor' WHEN 'pptx' THEN 'pptx text below confidence floor'
      WHEN 'xlsx' THEN 'xlsx text below confidence floor' ELSE 'scanned/pdf text layer below confidence floor' END END AS extraction_reason,
    CASE WHEN NOT deduplicated AND format IN ('pptx', 'pdf') THEN units END AS page_count FROM files),
blobs AS MATERIALIZED (
  SELECT user_id, sha256_hash, any_value(size_bytes) AS size_bytes, count(*) AS ref_count, user_id || '/' || sha256_hash AS storage_path
  FROM up GROUP BY user_id, sha256_hash),
toks AS MATERIALIZED (SELECT user_id, file_id, upload_seq, text, regexp_extract_all(text, '\\S+') AS w FROM files WHERE ok),
sh AS MATERIALIZED (
  SELECT user_id, file_id, upload_seq, i, lower(array_to_string(w[i : i + 4], ' ')) AS s
  FROM toks, unnest(range(1, len(w) - 3)) r(i) WHERE len(w) >= 5),
post AS MATERIALIZED (SELECT DISTINCT user_id, file_id, upload_seq, s FROM sh),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY upload_seq) AS r FROM post),
sets AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY upload_seq) AS n_sh
  FROM (SELECT user_id, file_id, upload_seq, count(*) AS k, sum(ln(r)) AS logs FROM ranked GROUP BY ALL)),
shares AS MATERIALIZED (
  SELECT a.user_id, a.file_id AS a_id, b.file_id AS b_id, count(*) AS shared, sum(ln(b.r)) AS shared_logs, sum(ln(b.r) - ln(b.r - 1)) AS growth
  FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND a.s = b.s AND a.r < b.r GROUP BY ALL),
grown AS MATERIALIZED (
  SELECT p.*, x.k AS ka, y.k AS kb, y.logs AS lb, y.n_sh AS n_sh,
         x.logs + sum(growth) OVER (PARTITION BY p.user_id, a_id ORDER BY y.upload_seq) AS la
  FROM shares p JOIN sets x ON x.user_id = p.user_id AND x.file_id = a_id JOIN sets y ON y.user_id = p.user_id AND y.file_id = b_id),
weighed AS (
  SELECT *, shared * ln(n_sh) - shared_logs AS inter, (ka + kb) * ln(n_sh) - la - lb - (shared * ln(n_sh) - shared_logs) AS uni FROM grown),
content AS MATERIALIZED (
  SELECT user_id, a_id, b_id, shared, n_sh < 10 AS provisional,
         CASE WHEN n_sh < 10 THEN shared / (ka + kb - shared) WHEN abs(uni) < 1e-9 THEN 0 ELSE inter / uni END AS content_score FROM weighed),
newer AS (
  SELECT *, n_files > {ceiling} AS blocked, ceil(pow(1.2::DOUBLE, b - 1))::BIGINT AS low, floor(pow(1.2::DOUBLE, b + 2))::BIGINT - 1 AS high
  FROM (SELECT *, floor(ln(greatest(size_bytes, 1)) / ln(1.2::DOUBLE)) AS b FROM files) WHERE NOT deduplicated),
cand AS (
  SELECT y.user_id, x.file_id AS a_id, y.file_id AS b_id, x.ok AND y.ok AS both_ok, x.filename_stem AS sa, y.filename_stem AS sb
  FROM files x JOIN newer y ON x.user_id = y.user_id AND x.upload_seq < y.upload_seq
  WHERE NOT y.blocked OR (x.extension = y.extension AND x.size_bytes BETWEEN y.low AND y.high)),
alike AS MATERIALIZED (
  SELECT *, CASE WHEN lower(sa) = lower(sb) THEN 1.0::DOUBLE
            ELSE 1 - levenshtein(lower(sa), lower(sb))::DOUBLE / greatest(length(sa), length(sb)) END AS filename_score FROM cand),
scored AS MATERIALIZED (
  SELECT a.user_id, a.a_id, a.b_id, c.content_score, a.filename_score, 0.7::DOUBLE * c.content_score + 0.3::DOUBLE * a.filename_score AS composite_score,
         CASE WHEN provisional THEN 'provisional' ELSE 'high' END AS confidence FROM alike a JOIN content c USING (user_id, a_id, b_id)),
pairs AS MATERIALIZED (
  SELECT user_id, a_id AS file_a_id, b_id AS file_b_id, content_score, filename_score, composite_score, confidence, 'pending' AS status
  FROM scored WHERE composite_score >= 0.55::DOUBLE
  UNION ALL
  SELECT user_id, a_id, b_id, NULL, filename_score, filename_score, 'metadata-only', 'pending' FROM alike
  WHERE NOT both_ok AND filename_score >= 0.8::DOUBLE),
pending AS (SELECT user_id, file_id, count(*) AS pending FROM (SELECT user_id, unnest([file_a_id, file_b_id]) AS file_id FROM pairs) GROUP BY ALL)
"""


def _lives(ceiling: int = 2000) -> str:
    """A library whose files also go: counts and scores by comparing each arrival with all lives."""
    head, rest = _at(ceiling).split("named AS (", 1)
    shared_columns = rest.split("row_number()", 1)[0]
    measured = rest[rest.index("measured AS (") : rest.index("reasons AS (")]
    there = "{0}.user_id = {1}.user_id AND {0}.t <= {1}.t AND coalesce({0}.gone, 1::BIGINT << 60) > {1}.t"
    return f"""{head}
lived AS MATERIALIZED (SELECT *, 2 * file_id AS t, CASE WHEN file_id % 4 = 1 THEN 2 * (file_id + 60 + file_id % 41 * 25) + 1 END AS gone FROM up),
together AS MATERIALIZED (SELECT y.file_id, count(*) AS n_files, count(*) FILTER (x.sha256_hash = y.sha256_hash) > 1 AS deduplicated FROM lived x JOIN lived y ON {there.format("x", "y")} GROUP BY y.file_id),
named AS ({shared_columns} n_files, deduplicated FROM lived JOIN together USING (file_id)),
{measured}
toks AS MATERIALIZED (SELECT user_id, file_id, t, gone, regexp_extract_all(text, '\\S+') AS w FROM files WHERE ok),
post AS MATERIALIZED (
  SELECT DISTINCT user_id, file_id, t, gone, lower(array_to_string(w[i : i + 4], ' ')) AS s FROM toks, unnest(range(1, len(w) - 3)) r(i) WHERE len(w) >= 5),
lists AS MATERIALIZED (SELECT user_id, s, list(struct_pack(t := t, gone := coalesce(gone, 1::BIGINT << 60))) AS l FROM post GROUP BY ALL),
own AS MATERIALIZED (SELECT p.*, len(list_filter(l, lambda e: e.t <= p.t AND e.gone > p.t)) AS r FROM post p JOIN lists USING (user_id, s)),
shingled AS MATERIALIZED (SELECT user_id, file_id, t, gone, count(*) AS k, sum(ln(r)) AS logs FROM own GROUP BY ALL),
sets AS MATERIALIZED (SELECT y.user_id, y.file_id, any_value(y.k) AS k, any_value(y.logs) AS logs, count(*) AS n FROM shingled x JOIN shingled y ON {there.format("x", "y")} GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT b.user_id, a.file_id AS a_id, b.file_id AS b_id, b.t AS b_at, count(*) AS shared, sum(ln(b.r)) AS shared_logs
  FROM own a JOIN own b ON a.s = b.s AND a.t < b.t AND {there.format("a", "b")} GROUP BY ALL),
then_logs AS MATERIALIZED (
  SELECT p.a_id, p.b_id, sum(ln(len(list_filter(l, lambda e: e.t <= p.b_at AND e.gone > p.b_at)))) AS la
  FROM shares p JOIN post a ON a.file_id = p.a_id JOIN lists l ON l.user_id = a.user_id AND l.s = a.s GROUP BY ALL),
weighed AS (
  SELECT p.user_id, p.a_id, p.b_id, y.n < 10 AS provisional, shared / (x.k + y.k - shared) AS plain, shared * ln(y.n) - shared_logs AS inter,
         (x.k + y.k) * ln(y.n) - la - y.logs - (shared * ln(y.n) - shared_logs) AS uni
  FROM shares p JOIN then_logs USING (a_id, b_id) JOIN sets x ON x.file_id = a_id JOIN sets y ON y.file_id = b_id),
content AS MATERIALIZED (
  SELECT user_id, a_id, b_id, provisional, CASE WHEN provisional THEN plain WHEN abs(uni) < 1e-9 THEN 0 ELSE inter / uni END AS content_score FROM weighed),
newer AS (
  SELECT *, n_files > {ceiling} AS blocked, ceil(pow(1.2::DOUBLE, b - 1))::BIGINT AS low, floor(pow(1.2::DOUBLE, b + 2))::BIGINT - 1 AS high
  FROM (SELECT *, floor(ln(greatest(size_bytes, 1)) / ln(1.2::DOUBLE)) AS b FROM files) WHERE NOT deduplicated),
alike AS MATERIALIZED (
  SELECT y.user_id, x.file_id AS a_id, y.file_id AS b_id, x.ok AND y.ok AS both_ok, x.gone IS NULL AND y.gone IS NULL AS still_there,
         CASE WHEN lower(x.filename_stem) = lower(y.filename_stem) THEN 1.0::DOUBLE
         ELSE 1 - levenshtein(lower(x.filename_stem), lower(y.filename_stem))::DOUBLE / greatest(length(x.filename_stem), length(y.filename_stem)) END AS filename_score
  FROM files x JOIN newer y ON {there.format("x", "y")} AND x.t < y.t
  WHERE NOT y.blocked OR (x.extension = y.extension AND x.size_bytes BETWEEN y.low AND y.high)),
pairs AS (
  SELECT a.user_id, a_id AS file_a_id, b_id AS file_b_id, content_score, filename_score, 0.7::DOUBLE * content_score + 0.3::DOUBLE * filename_score AS composite_score,
         CASE WHEN provisional THEN 'provisional' ELSE 'high' END AS confidence, 'pending' AS status, still_there
  FROM alike a JOIN content c USING (a_id, b_id) WHERE 0.7::DOUBLE * content_score + 0.3::DOUBLE * filename_score >= 0.55::DOUBLE
  UNION ALL
  SELECT user_id, a_id, b_id, NULL, filename_score, filename_score, 'metadata-only', 'pending', still_there FROM alike WHERE NOT both_ok AND filename_score >= 0.8::DOUBLE)
"""


def _q(body: str, ceiling: int = 2000) -> str:
    return f"WITH {_at(ceiling)} {body}"


_LABEL = "CASE confidence WHEN 'high' THEN 'High confidence' WHEN 'metadata-only' THEN 'Metadata only — content couldn''t be compared' ELSE 'Provisional — still learning your library' END"
_ROUNDED = "round(content_score, 8) AS content_score, round(filename_score, 8) AS filename_score, round(composite_score, 8) AS composite_score"


def _bytes(x: str) -> str:
    """Shown bytes; one decimal by integer arithmetic, half away from zero."""
    return f"""CASE WHEN {x} <= 0 THEN '0 B' WHEN {x} < 1024 THEN {x}::VARCHAR || ' B' ELSE
      printf('%.1f', round({x} / pow(1024, least(4, floor(ln({x}) / ln(1024)))) * 10) / 10) || ' ' || ['KB', 'MB', 'GB', 'TB'][least(4, floor(ln({x}) / ln(1024)))::INTEGER] END"""


_JS_TRIM = "regexp_replace(regexp_replace({}, '^[\\s\\x{{A0}}\\x{{FEFF}}]+', ''), '[\\s\\x{{A0}}\\x{{FEFF}}]+$', '')"
_ENTITIES = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''')"
_EXCERPT = """CASE WHEN {o} > 100 THEN '…' ELSE '' END || trim(regexp_replace(substr({t}, greatest(0, {o} - 100) + 1, least(length({t}), {o} + 100) - greatest(0, {o} - 100)), '\\s+', ' ', 'g'))
  || CASE WHEN {o} + 100 < length({t}) THEN '…' ELSE '' END"""

_SHOWN, _BEYOND = "[^\\s\\x{A0}\\x{FEFF}]", "[^\\x{00}-\\x{FF}]"


def _clean(x: str) -> str:
    lines = f"regexp_replace(replace({_ENTITIES.format(x)}, '&amp;', '&'), '\\r\\n?', chr(10), 'g')"
    return _JS_TRIM.format(f"regexp_replace(regexp_replace({lines}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


SQL = {
    "flagged_pairs_with_deletes": f"WITH {_lives()} SELECT user_id, file_a_id, file_b_id, {_ROUNDED}, confidence, status, still_there FROM pairs",
    "stream_lifecycle": f"WITH {_lives()} SELECT user_id, file_a_id, file_b_id, {_ROUNDED}, confidence, CASE (file_a_id + file_b_id) % 2 WHEN 0 THEN 'kept' ELSE status END AS status FROM pairs WHERE still_there",
    "committed_blobs": _q("SELECT user_id, sha256_hash, any_value(size_bytes) AS size_bytes, user_id || '/' || sha256_hash AS storage_path FROM up WHERE file_id % 2 = 0 OR file_id % 3 = 0 GROUP BY ALL"),
    "candidates_capped": _q(
        """SELECT user_id, b_id, count(*) AS n, sum(a_id) AS sum_a FROM (
        SELECT user_id, a_id, b_id, row_number() OVER (PARTITION BY user_id, b_id ORDER BY a_id) AS place FROM cand) WHERE place <= 50 GROUP BY ALL""",
        LOW_CEILING,
    ),
    "session_scope": _q(
        """, objects AS (SELECT * FROM blobs WHERE size_bytes % 5 <> 0), tenants AS (SELECT DISTINCT user_id FROM up), counts AS (
        SELECT user_id, 'physical_blobs' AS view FROM blobs UNION ALL SELECT user_id, 'logical_files' FROM files UNION ALL SELECT user_id, 'logical_files_text' FROM files WHERE NOT deduplicated
        UNION ALL SELECT user_id, 'file_shingles' FROM sh UNION ALL SELECT user_id, 'shingle_doc_frequency' FROM (SELECT DISTINCT user_id, s FROM post)
        UNION ALL SELECT user_id, 'near_duplicate_pairs' FROM pairs UNION ALL SELECT user_id, 'storage_objects' FROM objects)
        SELECT t.user_id, v.view, count(c.view) AS n_rows FROM tenants t, (SELECT unnest(['physical_blobs', 'logical_files', 'logical_files_text', 'file_shingles', 'shingle_doc_frequency', 'near_duplicate_pairs', 'storage_objects']) AS view) v
        LEFT JOIN counts c ON c.user_id = t.user_id AND c.view = v.view GROUP BY ALL"""
    ),
    "sql_functions": _q(
        """, heads AS (SELECT user_id, min(file_id) AS file_id, count(DISTINCT file_id) AS n_files FROM sh GROUP BY user_id),
        df AS (SELECT user_id, s, count(*) AS n FROM post GROUP BY ALL)
        SELECT t.user_id, coalesce(h.n_files, 0) AS n_files, (SELECT count(*) FROM sh WHERE sh.user_id = h.user_id AND sh.file_id = h.file_id) AS n_shingles,
               (SELECT count(*) FROM post p WHERE p.user_id = h.user_id AND p.file_id = h.file_id) AS n_hashes,
               coalesce((SELECT sum(n) FROM post p JOIN df USING (user_id, s) WHERE p.user_id = h.user_id AND p.file_id = h.file_id), 0)::BIGINT AS total
        FROM (SELECT DISTINCT user_id FROM up) t LEFT JOIN heads h USING (user_id)"""
    ),
    "object_outcomes": _q(
        """SELECT user_id, sha256_hash, CASE WHEN count(*) FILTER (file_id % 2 = 0) > 0 THEN 'stored' END AS early_outcome,
        CASE WHEN count(*) FILTER (file_id % 2 = 0) > 0 THEN 'already exists' ELSE 'stored' END AS outcome, count(*) FILTER (file_id % 4 <> 0) = 0 AS removed, NULL::VARCHAR AS storage_warning
        FROM up GROUP BY user_id, sha256_hash"""
    ),
    "numbered_files": _q("SELECT file_id, 999 + row_number() OVER (ORDER BY filename, sha256_hash, file_id) AS upload_seq FROM named"),
    "shown_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '—' ELSE strftime(o_orderdate::DATE + to_hours(o_orderkey % 24) + INTERVAL 5 MINUTE, '%b %-d, %Y, %I:%M %p') END AS shown FROM orders",
    "refused_parts": """SELECT p_brand AS user_id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS file_id, CASE WHEN p_partkey % 5 = 0 THEN 'no id' ELSE 'empty file' END AS reason, 400 AS status
        FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0""",
    "file_pairs": _q("SELECT user_id, file_a_id, file_b_id, confidence FROM pairs, (SELECT file_id FROM pending ORDER BY pending DESC, file_id LIMIT 1) t WHERE file_id IN (file_a_id, file_b_id)"),
    "shingle_digests": _q(
        """, bytes AS (SELECT user_id, file_id, hex(encode(s)) AS x FROM sh),
        folded AS (SELECT user_id, file_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::HUGEINT)),
          lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM bytes),
        signed AS (SELECT user_id, file_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS h FROM folded)
        SELECT user_id, file_id, count(*) AS n, bit_xor(h) AS folded, min(h) AS least, max(h) AS greatest FROM signed GROUP BY ALL"""
    ),
    "tier1_flags_with_deletes": f"WITH {_lives()} SELECT user_id, file_id, deduplicated, ok AS extraction_ok, n_files FROM files",
    "tier1_blobs": _q("SELECT user_id, sha256_hash, size_bytes, ref_count, storage_path FROM blobs"),
    "tier1_flags": _q("SELECT user_id, file_id, sha256_hash, deduplicated FROM files"),
    "shared_badges": _q("SELECT user_id, sha256_hash, 'Shared storage ×' || ref_count AS badge FROM blobs WHERE ref_count > 1"),
    "dedup_ratio_by_user": _q(
        """SELECT user_id, uploaded, stored, CASE WHEN stored > 0 THEN uploaded / stored ELSE 1 END AS ratio, greatest(uploaded - stored, 0) AS saved
        FROM (SELECT user_id, sum(size_bytes)::BIGINT AS uploaded FROM up GROUP BY 1) JOIN (SELECT user_id, sum(size_bytes)::BIGINT AS stored FROM blobs GROUP BY 1) USING (user_id)"""
    ),
    "running_counts": _q("SELECT user_id, file_id, n_files FROM named"),
    "ext_stem": _q("SELECT file_id, extension, filename_stem AS stem FROM named"),
    "rename_split": _q(
        """SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'renamed.' || filename WHEN 2 THEN 'plain' END AS filename,
        CASE file_id % 3 WHEN 0 THEN 'renamed.' || filename_stem WHEN 2 THEN 'plain' END AS filename_stem, CASE file_id % 3 WHEN 0 THEN extension WHEN 2 THEN '' END AS extension FROM named"""
    ),
    "format_of": _q("SELECT file_id, extension, format FROM named"),
    "filename_pairs": _q("SELECT user_id, a_id, b_id, round(filename_score, 9) AS filename_score FROM alike WHERE NOT both_ok AND filename_score >= 0.8::DOUBLE"),
    "expected_floor": _q("SELECT file_id, format, expected_min_chars FROM files"),
    "confidence_ok": _q("SELECT file_id, actual_chars, expected_min_chars, ok AS extraction_ok FROM files WHERE NOT deduplicated"),
    "extraction_report": _q(
        """SELECT user_id, file_id, ok AS extraction_ok, extraction_reason, expected_min_chars, actual_chars, page_count, CASE WHEN ok THEN length(text)::INTEGER END AS stored_chars
        FROM files JOIN reasons USING (file_id) WHERE NOT deduplicated"""
    ),
    "shingle_counts": _q("SELECT user_id, file_id, count(*) AS n_shingles, count(DISTINCT s) AS n_distinct FROM sh GROUP BY ALL"),
    "shingle_offsets": _q(
        """, runs AS (SELECT file_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS t, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS k FROM toks),
        placed AS (SELECT file_id, t, k, sum(length(t)) OVER (PARTITION BY file_id ORDER BY k) - length(t) AS pos FROM runs),
        ws AS (SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY k DESC) AS back FROM placed WHERE NOT regexp_matches(t, '^\\s'))
        SELECT file_id, pos::INTEGER AS start_offset FROM ws WHERE back >= 5"""
    ),
    "word_counts": _q("SELECT file_id, len(w)::INTEGER AS n_words FROM toks"),
    "doc_frequency": _q("SELECT user_id, doc_count::INTEGER AS doc_count, count(*) AS n_shingles FROM (SELECT user_id, s, count(*) AS doc_count FROM post GROUP BY ALL) GROUP BY ALL"),
    "shingled_file_count": _q("SELECT user_id, count(DISTINCT file_id) AS n_files FROM sh GROUP BY 1"),
    "df_top_k": _q(
        """SELECT user_id, place::INTEGER AS place, doc_count::INTEGER AS doc_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY doc_count DESC) AS place
        FROM (SELECT user_id, s, count(*) AS doc_count FROM post GROUP BY ALL)) WHERE place <= 10"""
    ),
    "rpc_doc_frequencies": _q(
        """SELECT user_id, file_id, count(*) AS n, sum(doc_count)::BIGINT AS total
        FROM post JOIN (SELECT user_id, s, count(*) AS doc_count FROM post GROUP BY ALL) USING (user_id, s) GROUP BY ALL"""
    ),
    "rpc_file_shingles": _q(
        """, runs AS (SELECT file_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS t, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS k FROM toks),
        placed AS (SELECT file_id, t, k, sum(length(t)) OVER (PARTITION BY file_id ORDER BY k) - length(t) AS pos FROM runs),
        ws AS (SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY k DESC) AS back FROM placed WHERE NOT regexp_matches(t, '^\\s'))
        SELECT user_id, file_id, count(*) AS n, max(pos)::INTEGER AS last_offset FROM ws JOIN toks USING (file_id) WHERE back >= 5 GROUP BY ALL"""
    ),
    "size_buckets": _q(
        """SELECT file_id, b::BIGINT AS bucket, ceil(pow(1.2::DOUBLE, b - 1))::BIGINT AS low, floor(pow(1.2::DOUBLE, b + 2))::BIGINT - 1 AS high
        FROM (SELECT file_id, floor(ln(greatest(size_bytes, 1)) / ln(1.2::DOUBLE)) AS b FROM up)"""
    ),
    "candidates_full": _q("SELECT user_id, b_id, count(*) AS n, sum(a_id)::BIGINT AS sum_a FROM cand GROUP BY ALL"),
    "candidates_blocked": _q("SELECT user_id, b_id, count(*) AS n, sum(a_id)::BIGINT AS sum_a FROM cand GROUP BY ALL", LOW_CEILING),
    "jaccard_plain": _q("SELECT user_id, a_id, b_id, round(shared / (ka + kb - shared), 8) AS score FROM grown"),
    "jaccard_idf_snapshot": _q(
        """, tot AS (SELECT user_id, count(DISTINCT file_id) AS t FROM post GROUP BY 1),
        wt AS (SELECT user_id, s, ln(any_value(t) / count(*)) AS w FROM post JOIN tot USING (user_id) GROUP BY ALL),
        ws AS (SELECT user_id, file_id, sum(w) AS w FROM post JOIN wt USING (user_id, s) GROUP BY ALL),
        pw AS (SELECT a.user_id, a.file_id AS a_id, b.file_id AS b_id, sum(w) AS inter FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND a.s = b.s AND a.r < b.r
               JOIN wt ON wt.user_id = a.user_id AND wt.s = a.s GROUP BY ALL)
        SELECT pw.user_id, pw.a_id, pw.b_id, t < 10 AS provisional,
               round(CASE WHEN t < 10 THEN shared / (ka + kb - shared) WHEN abs(x.w + y.w - inter) < 1e-9 THEN 0 ELSE inter / (x.w + y.w - inter) END, 8) AS score
        FROM pw JOIN grown g ON g.user_id = pw.user_id AND g.a_id = pw.a_id AND g.b_id = pw.b_id JOIN tot ON tot.user_id = pw.user_id
        JOIN ws x ON x.user_id = pw.user_id AND x.file_id = pw.a_id JOIN ws y ON y.user_id = pw.user_id AND y.file_id = pw.b_id"""
    ),
    "jaccard_idf_asof": _q("SELECT user_id, a_id, b_id, shared, round(content_score, 8) AS content_score, provisional FROM content"),
    "composite_pairs": _q(f"SELECT user_id, a_id, b_id, {_ROUNDED}, confidence, composite_score >= 0.55::DOUBLE AS flagged FROM scored"),
    "flagged_pairs": _q(f"SELECT user_id, file_a_id, file_b_id, {_ROUNDED}, confidence, status FROM pairs"),
    "review_queue": _q(
        f"""SELECT p.user_id, file_a_id, file_b_id, a.filename AS filename_a, b.filename AS filename_b, {_ROUNDED}, {_LABEL} AS label,
        floor(composite_score * 100 + 0.5::DOUBLE)::BIGINT || '%' AS percent FROM pairs p JOIN named a ON a.file_id = file_a_id JOIN named b ON b.file_id = file_b_id"""
    ),
    "pending_counts": _q("SELECT user_id, file_id, pending FROM pending"),
    "pairs_for_file": _q(
        """, top AS (SELECT file_id AS top_id FROM pending ORDER BY pending DESC, file_id LIMIT 1)
        SELECT top_id, file_a_id, file_b_id, confidence FROM pairs, top WHERE top_id IN (file_a_id, file_b_id)"""
    ),
    "evidence_top2": _q(
        f""", runs AS (SELECT file_id, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS t, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) AS k FROM toks),
        placed AS (SELECT file_id, t, k, sum(length(t)) OVER (PARTITION BY file_id ORDER BY k) - length(t) AS pos FROM runs),
        ws AS (SELECT file_id, pos, row_number() OVER (PARTITION BY file_id ORDER BY k) AS i FROM placed WHERE NOT regexp_matches(t, '^\\s')),
        spots AS (SELECT user_id, file_id, s, max(pos)::INTEGER AS spot FROM sh JOIN ws USING (file_id, i) GROUP BY ALL),
        met AS (SELECT p.user_id, file_a_id, file_b_id, x.spot AS at_a, y.spot AS at_b, row_number() OVER (PARTITION BY file_a_id, file_b_id ORDER BY x.spot, y.spot)::INTEGER AS place
                FROM pairs p JOIN spots x ON x.file_id = file_a_id JOIN spots y ON y.file_id = file_b_id AND y.s = x.s WHERE confidence <> 'metadata-only')
        SELECT met.user_id, file_a_id, file_b_id, place, at_a, at_b, {_EXCERPT.format(t="a.text", o="at_a")} AS excerpt_a, {_EXCERPT.format(t="b.text", o="at_b")} AS excerpt_b
        FROM met JOIN up a ON a.file_id = file_a_id JOIN up b ON b.file_id = file_b_id WHERE place <= 2"""
    ),
    "metadata_deltas": _q(
        f"""SELECT p.user_id, file_a_id, file_b_id, abs(a.size_bytes - b.size_bytes) AS size_delta, {_bytes("abs(a.size_bytes - b.size_bytes)")} AS size_delta_shown,
        coalesce(ra.page_count::VARCHAR, 'unknown') AS pages_a, coalesce(rb.page_count::VARCHAR, 'unknown') AS pages_b, coalesce(abs(ra.page_count - rb.page_count)::VARCHAR, '—') AS pages_delta,
        coalesce(ra.extraction_reason, 'Text could not be extracted') AS reason_a, CASE WHEN NOT b.ok THEN coalesce(rb.extraction_reason, 'text could not be extracted') END AS reason_b
        FROM pairs p JOIN files a ON a.file_id = file_a_id JOIN files b ON b.file_id = file_b_id JOIN reasons ra ON ra.file_id = file_a_id JOIN reasons rb ON rb.file_id = file_b_id
        WHERE confidence = 'metadata-only'"""
    ),
    "label_map": _q(f"SELECT file_a_id, file_b_id, {_LABEL} AS label FROM pairs"),
    "file_list": _q(
        f"""SELECT n.user_id, n.file_id, filename, upload_seq, {_bytes("n.size_bytes")} AS size, ref_count, coalesce(pending, 0) AS pending,
        CASE WHEN ref_count = 1 AND pending IS NULL THEN '—' ELSE concat_ws(' ', CASE WHEN ref_count > 1 THEN 'Shared storage ×' || ref_count END,
          CASE WHEN pending > 0 THEN pending || ' possible dup' || CASE WHEN pending = 1 THEN '' ELSE 's' END END) END AS badges
        FROM named n JOIN blobs USING (user_id, sha256_hash) LEFT JOIN pending p ON p.file_id = n.file_id"""
    ),
    "library_stats": _q(
        """SELECT user_id, n_files, uploaded, n_blobs, stored, coalesce(pending, 0) AS pending, CASE WHEN stored > 0 THEN uploaded / stored ELSE 1 END AS ratio, greatest(uploaded - stored, 0) AS saved
        FROM (SELECT user_id, count(*) AS n_files, sum(size_bytes)::BIGINT AS uploaded FROM up GROUP BY 1)
        JOIN (SELECT user_id, count(*) AS n_blobs, sum(size_bytes)::BIGINT AS stored FROM blobs GROUP BY 1) USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS pending FROM pairs GROUP BY 1) USING (user_id)"""
    ),
    "format_bytes": _q(f"SELECT file_id, {_bytes('(size_bytes * size_bytes)')} AS shown FROM up"),
    "format_percent": _q("SELECT file_id, floor(units / 8 * 100 + 0.5::DOUBLE)::BIGINT || '%' AS shown FROM up"),
    "log_messages": _q(
        """, n AS (SELECT file_b_id AS file_id, count(*) AS k FROM pairs GROUP BY 1)
        SELECT f.file_id, CASE WHEN deduplicated THEN filename || ': identical bytes already stored — shared blob (Tier 1).'
        ELSE filename || ': stored — ' || CASE WHEN ok THEN 'text extracted' ELSE 'metadata-only (' || extraction_reason || ')' END || '; ' || coalesce(k, 0) || ' possible duplicate(s).' END AS message
        FROM files f JOIN reasons USING (file_id) LEFT JOIN n ON n.file_id = f.file_id"""
    ),
    "excerpts": _q(f"SELECT file_id, {_EXCERPT.format(t='text', o='(file_id * 37 % 400)')} AS excerpt FROM toks"),
    "delete_refcounts": _q("SELECT user_id, sha256_hash, count(*) AS ref_count FROM up WHERE file_id % 4 <> 0 GROUP BY ALL"),
    "delete_freed_blobs": _q("SELECT user_id, sha256_hash, storage_path, size_bytes FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.user_id = b.user_id AND u.sha256_hash = b.sha256_hash AND file_id % 4 <> 0)"),
    "delete_results": _q(
        """, freed AS (SELECT user_id, sha256_hash FROM up GROUP BY ALL HAVING bool_and(file_id % 4 = 0)),
        gone AS (SELECT *, row_number() OVER (PARTITION BY user_id, sha256_hash ORDER BY file_id % 7 DESC, file_id DESC) = 1 AS last FROM up WHERE file_id % 4 = 0),
        told AS (SELECT u.user_id, file_id, f.user_id || '/' || f.sha256_hash AS storage_path FROM gone u LEFT JOIN freed f ON last AND f.user_id = u.user_id AND f.sha256_hash = u.sha256_hash)
        SELECT user_id, file_id, TRUE AS deleted, storage_path IS NOT NULL AS blob_deleted, storage_path,
               json_object('deleted', TRUE, 'blob_deleted', storage_path IS NOT NULL, 'storage_path', storage_path)::VARCHAR AS result FROM told"""
    ),
    "foreign_deletes": _q(
        """, asked AS (SELECT CASE WHEN file_id % 20 = 0 THEN 'fr' ELSE user_id END AS user_id, file_id * 3 AS file_id FROM up WHERE file_id % 10 = 0)
        SELECT user_id, file_id FROM asked a WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.user_id = a.user_id AND u.file_id = a.file_id)"""
    ),
    "refused_uploads": """SELECT coalesce(lang, '') AS user_id, doc_id AS file_id, CASE WHEN doc_id IS NULL THEN 'no id' ELSE 'empty file' END AS reason, 400 AS status
        FROM documents WHERE doc_id IS NULL OR coalesce(text, '') = ''""",
    "increment_refs": _q("SELECT user_id, sha256_hash, count(*) AS ref_count FROM up GROUP BY ALL HAVING bool_or(file_id % 2 = 0)"),
    "tier1_lookup": _q(
        """SELECT u.user_id, u.file_id, b.id AS blob_id FROM up u LEFT JOIN (SELECT user_id, sha256_hash, min(file_id) AS id FROM up WHERE file_id % 2 = 0 GROUP BY ALL) b
        ON b.user_id = u.user_id AND b.sha256_hash = u.sha256_hash WHERE u.file_id % 2 = 1"""
    ),
    "new_blobs": _q("SELECT user_id, sha256_hash, any_value(size_bytes) AS size_bytes, user_id || '/' || sha256_hash AS storage_path FROM up GROUP BY user_id, sha256_hash HAVING bool_and(file_id % 2 = 1)"),
    "bump_frequency": _q("SELECT user_id, doc_count::INTEGER AS doc_count, count(*) AS n_shingles FROM (SELECT user_id, s, count(*) AS doc_count FROM post GROUP BY ALL) GROUP BY ALL"),
    "upsert_pairs": _q(
        """SELECT user_id, file_a_id, file_b_id, CASE WHEN (file_a_id + file_b_id) % 3 = 0 THEN 1 ELSE round(composite_score, 8) END AS composite_score,
        CASE WHEN (file_a_id + file_b_id) % 3 = 0 THEN 'pending' ELSE 'kept' END AS status FROM pairs"""
    ),
    "register_buckets": _q("SELECT user_id AS id, NOT bool_or(file_id < 5) AS public FROM up GROUP BY 1"),
    "scoped_objects": _q("SELECT 'files' AS bucket_id, storage_path AS name FROM blobs WHERE user_id = 'de' AND size_bytes % 5 <> 0"),
    "write_violations": _q("SELECT user_id, file_id FROM up WHERE user_id <> 'en'"),
    "constraint_violations": _q(
        """, spoilt AS (SELECT *, (file_a_id + file_b_id) % 11 AS k FROM pairs)
        SELECT file_a_id, CASE WHEN k = 2 THEN file_a_id ELSE file_b_id END AS file_b_id, CASE k WHEN 0 THEN 'confidence' WHEN 1 THEN 'status' ELSE 'self' END AS violation FROM spoilt WHERE k < 3
        UNION ALL SELECT file_a_id, file_b_id, 'repeated' FROM spoilt WHERE k = 3
        UNION ALL SELECT file_a_id, file_a_id, 'repeated' FROM spoilt WHERE k = 2 GROUP BY file_a_id HAVING count(*) > 1"""
    ),
    "ratio_shown": _q(
        """SELECT user_id, printf('%.2f', uploaded / stored) || '×' AS shown
        FROM (SELECT user_id, sum(size_bytes)::BIGINT AS uploaded FROM up GROUP BY 1) JOIN (SELECT user_id, sum(size_bytes)::BIGINT AS stored FROM blobs GROUP BY 1) USING (user_id)"""
    ),
    "extract_formats": _q(
        f""", kinds AS (SELECT file_id, text, string_split(text, chr(10)) AS lines, ['txt', 'docx', 'pptx', 'xlsx', 'pdf', 'png'][file_id % 6 + 1] AS ext FROM up),
        raw AS (SELECT *, CASE ext WHEN 'txt' THEN text || ' ' || chr(10) || chr(10) || chr(10) || '&lt;end&gt; &amp;lt; A' WHEN 'docx' THEN text WHEN 'pptx' THEN array_to_string(lines, chr(10) || chr(10))
          WHEN 'xlsx' THEN array_to_string(list_filter(lines, lambda x: regexp_matches(x, '{_SHOWN}')), chr(9)) WHEN 'pdf' THEN regexp_replace(text, '{_BEYOND}', '?', 'g') ELSE '' END AS t,
          CASE ext WHEN 'pptx' THEN len(lines) WHEN 'xlsx' THEN len(list_filter(lines, lambda x: regexp_matches(x, '{_SHOWN}'))) ELSE 1 END AS units FROM kinds),
        clean AS (SELECT *, {_clean("t")} AS c FROM raw),
        sized AS (SELECT *, length(c)::INTEGER AS n, (CASE ext WHEN 'docx' THEN 1500 WHEN 'pdf' THEN 1500 WHEN 'pptx' THEN 150 * greatest(units, 1) WHEN 'xlsx' THEN 4 * greatest(units, 1) ELSE 0 END)::INTEGER AS least FROM clean),
        passed AS (SELECT *, CASE ext WHEN 'png' THEN FALSE WHEN 'txt' THEN n > 0 ELSE n >= least * 0.2::DOUBLE END AS ok FROM sized)
        SELECT file_id, CASE ext WHEN 'txt' THEN 'plain' WHEN 'png' THEN 'unsupported' ELSE ext END AS format, ok AS extraction_ok,
          CASE ext WHEN 'png' THEN 'unsupported format: .png' WHEN 'txt' THEN CASE WHEN ok THEN 'plain-text read directly' ELSE 'empty plain-text file' END
            WHEN 'docx' THEN CASE WHEN ok THEN 'docx XML text nodes parsed' ELSE 'docx text layer below confidence floor' END
            WHEN 'pptx' THEN CASE WHEN ok THEN 'pptx slide text parsed' ELSE 'pptx text below confidence floor' END
            WHEN 'xlsx' THEN CASE WHEN ok THEN 'xlsx shared/inline strings parsed' ELSE 'xlsx text below confidence floor' END
            ELSE CASE WHEN ok THEN 'pdf text layer extracted' ELSE 'scanned/pdf text layer below confidence floor' END END AS extraction_reason,
          least AS expected_min_chars, n AS actual_chars, CASE WHEN ext IN ('pptx', 'pdf') THEN units END::INTEGER AS page_count, CASE WHEN ok THEN sha256(c) END AS sha256 FROM passed"""
    ),
    "stream_replay": _q(f"SELECT user_id, file_a_id, file_b_id, {_ROUNDED}, confidence, status FROM pairs"),
    "df_after_delete": _q("SELECT user_id, doc_count::INTEGER AS doc_count, count(*) AS n_shingles FROM (SELECT user_id, s, count(*) AS doc_count FROM post WHERE file_id % 4 <> 0 GROUP BY ALL) GROUP BY ALL"),
    "pairs_after_delete": _q("SELECT file_a_id, file_b_id, status FROM pairs WHERE file_a_id % 4 <> 0 AND file_b_id % 4 <> 0"),
    "keep_pairs": _q("SELECT file_a_id, file_b_id, CASE WHEN (file_a_id + file_b_id) % 2 = 0 THEN 'kept' ELSE status END AS status FROM pairs"),
    "rename_files": _q(
        """SELECT file_id, CASE WHEN file_id % 6 = 3 THEN 'New.Name.TXT' ELSE filename END AS filename, CASE WHEN file_id % 6 = 3 THEN 'New.Name' ELSE filename_stem END AS filename_stem,
        CASE WHEN file_id % 6 = 3 THEN 'txt' ELSE extension END AS extension FROM named"""
    ),
    "tenant_scope": _q("SELECT user_id, file_id, sha256_hash FROM up WHERE user_id = 'fr'"),
    "entity_decode": f"""
        WITH named AS (SELECT page_id, {_ENTITIES.format("(html || ' &#' || (page_id % 26 + 65) || ';&#8364;&amp;#65;')")} AS t FROM pages),
        cut AS (SELECT page_id, regexp_split_to_array(t, '&#\\d+;') AS parts, regexp_extract_all(t, '&#(\\d+);', 1) AS codes FROM named),
        whole AS (SELECT page_id, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(codes) THEN chr(codes[i]::INTEGER) ELSE '' END), '') AS t FROM cut)
        SELECT page_id, sha256(replace(t, '&amp;', '&')) AS sha256 FROM whole""",
    "cleaned_text": f"SELECT page_id, sha256({_clean('html')}) AS sha256 FROM pages",
}
