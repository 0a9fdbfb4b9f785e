"""SQL that answers each registered query by brute force, for checking.

The statements share no formulation with the DataFrame code: recordings are
paired with every reference, output grids are joined back to samples, spectra
are sums over samples.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


CODE = "CASE {0} % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'D' WHEN 2 THEN 'R' WHEN 3 THEN 'M' ELSE '{1}' END"
STATUS = ("CASE {0} WHEN 'H' THEN 'healthy' WHEN 'D' THEN 'degraded' WHEN 'R' THEN 'restored_early' "
          "WHEN 'M' THEN 'restored_mid' ELSE 'unknown' END")
TITLE = ("CASE {0} WHEN 'healthy' THEN 'Healthy' WHEN 'degraded' THEN 'Degraded' "
         "WHEN 'restored_early' THEN 'Restored Early' WHEN 'restored_mid' THEN 'Restored Mid' ELSE 'Unknown' END")
CATEGORIES = "(VALUES (0, 'H', 'healthy'), (1, 'D', 'degraded'), (2, 'R', 'restored_early'), (3, 'M', 'restored_mid')) AS c(ordinal, site_type, status)"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# --- Shared tables -----------------------------------------------------------

VECTORS = """vectors AS (
  SELECT vec_id, label, vec_id // 4 AS analysis_id, vec_id % 4 AS segment_idx,
         list_transform(embedding, lambda x: x::DOUBLE) AS embedding
  FROM embeddings)"""

REFS = f"""refs AS (
  SELECT vec_id AS ref_id, n_name || '_' || {CODE.format('label', 'U')} || label || '_' || vec_id || '.wav' AS filename,
         n_name || '_' || {CODE.format('label', 'U')} || label AS site_id, n_name AS country,
         {CODE.format('label', 'U')} AS site_type, list_transform(embedding, lambda x: x::DOUBLE) AS embedding
  FROM embeddings LEFT JOIN nation ON n_nationkey = label)"""

POOLED = """flat AS (
  SELECT vec_id, label, analysis_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM vectors),
pooled_flat AS (SELECT analysis_id, pos, avg(x) AS value, count(*) AS num_segments FROM flat GROUP BY ALL),
pooled AS (
  SELECT analysis_id, list(value ORDER BY pos) AS embedding, max(num_segments) AS num_segments
  FROM pooled_flat GROUP BY analysis_id)"""

PAIRS = """pairs AS (
  SELECT analysis_id, ref_id, site_id, site_type, country, list_cosine_similarity(p.embedding, r.embedding) AS similarity
  FROM pooled p JOIN refs r ON len(p.embedding) = len(r.embedding))"""


def _classes(prior: str = "0.1") -> str:
    return f"""sims AS (
  SELECT p.analysis_id, c.ordinal, c.status, avg(s.similarity) AS known
  FROM pooled p CROSS JOIN {CATEGORIES}
  LEFT JOIN pairs s ON s.analysis_id = p.analysis_id AND s.site_type = c.site_type GROUP BY ALL),
scores AS (SELECT analysis_id, ordinal, status, coalesce(known, {prior}) AS s, known FROM sims),
totals AS (SELECT analysis_id, sum(s) AS t, bool_and(s >= 0) AS positive, count(known) > 0 AS any_known FROM scores GROUP BY 1),
probs AS (
  SELECT s.analysis_id, ordinal, status, CASE WHEN t > 0 THEN s / t ELSE s END AS p, t > 0 AND positive AND any_known AS valid
  FROM scores s JOIN totals USING (analysis_id)),
labels AS (
  SELECT analysis_id, status AS label, p AS confidence, valid
  FROM probs QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY p DESC, ordinal) = 1)"""


CLASSES = _classes()

TOP = f"""top AS (
  SELECT analysis_id, row_number() OVER (PARTITION BY analysis_id ORDER BY similarity DESC, ref_id) AS rank,
         ref_id, site_id, country, {STATUS.format('site_type')} AS status, similarity
  FROM pairs QUALIFY rank <= 3)"""

POINTS = """points AS (
  SELECT analysis_id, avg(value) FILTER (pos < n // 2) AS x, avg(value) FILTER (pos >= n // 2) AS y
  FROM pooled_flat JOIN (SELECT analysis_id, count(*) AS n FROM pooled_flat GROUP BY 1) USING (analysis_id) GROUP BY 1)"""

REF_POINTS = f"""ref_points AS (
  SELECT ref_id, site_id, {STATUS.format('site_type')} AS status,
         list_avg(embedding[:len(embedding) // 2]) AS x, list_avg(embedding[len(embedding) // 2 + 1:]) AS y
  FROM refs ORDER BY ref_id LIMIT 10)"""

SAMPLES = """samples AS (
  SELECT user_id AS recording_id, event_id, ts,
         greatest(-1::DOUBLE, least(1::DOUBLE, (value - 50) / 500)) AS v,
         CASE user_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 8 END AS sample_rate
  FROM events),
sized AS (
  SELECT recording_id, any_value(sample_rate) AS sample_rate, count(*) AS n_samples FROM samples GROUP BY 1),
verdicts AS (
  SELECT *, n_samples::DOUBLE / sample_rate AS duration,
         (CASE WHEN sample_rate = 4 THEN n_samples ELSE floor(n_samples::DOUBLE / sample_rate * 4) END)::BIGINT AS n_resampled,
         CASE WHEN n_samples::DOUBLE / sample_rate < 7.5 THEN 'AUDIO_TOO_SHORT'
              WHEN n_samples::DOUBLE / sample_rate > 36 THEN 'AUDIO_TOO_LONG' END AS error_code
  FROM sized)"""

SIGNALS = SAMPLES + """,
signals AS (
  SELECT s.recording_id, row_number() OVER (PARTITION BY s.recording_id ORDER BY ts, event_id) - 1 AS sample_idx,
         v, s.sample_rate, n_samples, n_resampled
  FROM samples s JOIN verdicts w ON w.recording_id = s.recording_id AND error_code IS NULL)"""

QUANTISED = """quantised AS (
  SELECT recording_id, sample_idx, trunc(v * 32767)::BIGINT AS pcm, trunc(v * 32767) / 32768 AS v, sample_rate, n_samples, n_resampled
  FROM signals)"""


def _grid(source: str) -> str:
    return f"""grid AS (
  SELECT recording_id, sample_rate, n_samples, n_resampled, unnest(range(n_resampled)) AS j
  FROM verdicts WHERE error_code IS NULL),
placed AS (
  SELECT *, j * sample_rate / 4::DOUBLE AS spot, floor(j * sample_rate / 4::DOUBLE)::BIGINT AS i FROM grid)"""


def _resampled(source: str = "signals", last: str = "n_samples - 2") -> str:
    """`last` is the highest index the interpolation may start from."""
    return _grid(source) + f""",
resampled AS (
  SELECT g.recording_id, g.j AS sample_idx, g.n_resampled AS n_samples,
         CASE WHEN g.sample_rate = 4 THEN a.v ELSE a.v * (1 - (spot - i)) + coalesce(b.v, a.v) * (spot - i) END AS v
  FROM placed g
  JOIN {source} a ON a.recording_id = g.recording_id
    AND a.sample_idx = CASE WHEN g.sample_rate = 4 THEN j ELSE least(i, g.{last}) END
  LEFT JOIN {source} b ON b.recording_id = g.recording_id
    AND b.sample_idx = CASE WHEN g.sample_rate = 4 THEN NULL ELSE least(i, g.{last}) + 1 END)"""


SEGMENTS = """segments AS (
  SELECT recording_id, sample_idx // 16 AS segment_idx, sample_idx % 16 AS pos, v
  FROM resampled WHERE sample_idx // 16 < n_samples // 16)"""

LEVELS = """stepped AS (
  SELECT *, sign(v) <> lag(sign(v)) OVER (PARTITION BY recording_id, segment_idx ORDER BY pos) AS step FROM segments),
levels AS (
  SELECT recording_id, segment_idx, count(*) AS n, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak,
         count(*) FILTER (step) AS zero_crossings, (count(*) FILTER (step))::DOUBLE / count(*) AS zcr
  FROM stepped GROUP BY ALL)"""

SPECTRA = """bins AS (
  SELECT recording_id, segment_idx, k AS bin, k * 4::DOUBLE / 16 AS frequency,
         sqrt(sum(v * cos(2 * pi() * k * pos / 16)) ** 2 + sum(v * sin(2 * pi() * k * pos / 16)) ** 2) AS magnitude
  FROM segments, range(0, 9) AS f(k) GROUP BY ALL),
spectra AS (
  SELECT *, magnitude / (sum(magnitude) OVER (PARTITION BY recording_id, segment_idx) + 1e-10) AS share FROM bins),
centroids AS (SELECT recording_id, segment_idx, sum(frequency * share) AS centroid FROM spectra GROUP BY ALL)"""

ENDPOINT = """grid AS (
  SELECT recording_id, sample_rate, n_samples AS n, n_resampled AS m, unnest(range(n_resampled)) AS j
  FROM verdicts WHERE error_code IS NULL),
placed AS (
  SELECT *, CASE WHEN sample_rate = 4 THEN j::DOUBLE ELSE j * (n - 1) / (m - 1)::DOUBLE END AS spot FROM grid),
resampled AS (
  SELECT g.recording_id, j AS sample_idx, m AS n_samples,
         a.v + (coalesce(b.v, a.v) - a.v) * (spot - floor(spot)) AS v
  FROM placed g JOIN signals a ON a.recording_id = g.recording_id AND a.sample_idx = floor(spot)::BIGINT
  LEFT JOIN signals b ON b.recording_id = g.recording_id AND b.sample_idx = floor(spot)::BIGINT + 1)"""

NAME = f"'c' || recording_id % 7 || '_' || {CODE.format('recording_id', 'X')} || recording_id || '_20240101_120000.wav'"

LOG = """log AS (
  SELECT CASE event_type WHEN 'signup' THEN 'UPLOAD#' ELSE 'ANALYSIS#' END || (user_id * 100 + day(ts)) AS pk,
         CASE event_type WHEN 'signup' THEN 'METADATA' WHEN 'view' THEN 'PREPROCESSED'
                         WHEN 'purchase' THEN 'RESULT' ELSE 'ERROR' END AS sk,
         (user_id * 100 + day(ts))::BIGINT AS analysis_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'preprocessed'
                         WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status,
         CASE event_type WHEN 'error' THEN regexp_extract(props, '"k": ([0-9]+)', 1) END AS error
  FROM events WHERE event_type <> 'click'),
requests AS (SELECT DISTINCT (user_id * 100 + day(ts))::BIGINT AS analysis_id FROM events)"""

SITES = """sites AS (
  SELECT s_name AS site_id, n_name AS country,
         CASE s_suppkey % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'restored_early' ELSE 'restored_mid' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

FILES = f"""files AS (
  SELECT s_suppkey, s_suppkey % 11 = 0 AS noise, s_nationkey, {CODE.format('s_suppkey', 'X')} AS code, s_suppkey % 7 AS num_segments,
         CASE WHEN s_suppkey % 11 = 0 THEN 'noise.wav'
              ELSE 'n' || s_nationkey || '_' || {CODE.format('s_suppkey', 'X')} || s_suppkey || '_20230207_120400.wav' END AS filename,
         CASE WHEN s_suppkey % 11 = 0 THEN 'unknown' ELSE 'n' || s_nationkey END AS country,
         CASE WHEN s_suppkey % 11 = 0 THEN 'unknown' ELSE {CODE.format('s_suppkey', 'X')} || s_suppkey END AS site,
         CASE WHEN s_suppkey % 11 = 0 THEN 'U' ELSE {CODE.format('s_suppkey', 'X')} END AS site_type
  FROM supplier)"""

USAGE = """usage AS (
  SELECT l_returnflag AS service, strftime(l_shipdate, '%Y-%m') AS month, l_extendedprice AS amount,
         CASE l_returnflag WHEN 'A' THEN 256 WHEN 'N' THEN 1024 ELSE 512 END / 1024::DOUBLE * l_quantity AS gb_seconds
  FROM lineitem)"""


# --- Sources and sinks -------------------------------------------------------

ORACLE["scan_recordings"] = ORACLE["stream_ingest"] = with_(SAMPLES) + f"""
SELECT {NAME} AS filename, (44 + 2 * n_samples)::BIGINT AS length FROM verdicts"""

ORACLE["admit_by_size"] = """
SELECT doc_id, n_chars AS size_bytes, CASE WHEN n_chars > 5000 THEN 'FILE_TOO_LARGE' END AS error_code FROM documents"""

ORACLE["decode_recordings"] = with_(SIGNALS, QUANTISED) + f"""
SELECT {NAME} AS filename, sample_rate::BIGINT AS sample_rate, sample_idx, pcm FROM quantised"""


def _hex(value: str, size: int) -> str:
    """Little-endian hexadecimal digits."""
    return " || ".join(f"printf('%02x', (({value}) >> {8 * i}) & 255)" for i in range(size))


ORACLE["encode_recordings"] = with_(SAMPLES) + f"""
SELECT recording_id, (44 + 2 * n_samples)::BIGINT AS length,
       '52494646' || {_hex('36 + 2 * n_samples', 4)} || '57415645' || '666d7420' || {_hex('16::BIGINT', 4)}
       || {_hex('1::BIGINT', 2)} || {_hex('1::BIGINT', 2)} || {_hex('sample_rate::BIGINT', 4)} || {_hex('2 * sample_rate::BIGINT', 4)}
       || {_hex('2::BIGINT', 2)} || {_hex('16::BIGINT', 2)} || '64617461' || {_hex('2 * n_samples', 4)} AS header
FROM verdicts"""

ORACLE["segment_table"] = with_(SIGNALS, QUANTISED, _resampled("quantised"), SEGMENTS) + f"""
SELECT {NAME} AS filename, segment_idx, count(*) AS n, any_value(sample_rate)::BIGINT AS original_sample_rate,
       {r6('any_value(n_resampled / 4::DOUBLE)', 'total_duration')}, any_value(n_resampled // 16) AS num_segments,
       {r6('sum(v)', 'total')}, NULL AS error_code
FROM segments JOIN verdicts USING (recording_id) GROUP BY recording_id, segment_idx
UNION ALL SELECT {NAME}, NULL, NULL, sample_rate::BIGINT, NULL, NULL, NULL, error_code FROM verdicts WHERE error_code IS NOT NULL"""

ORACLE["load_refs"] = with_(REFS) + f"""
SELECT ref_id, filename, site_id, country, site_type, 1::BIGINT AS num_segments, len(embedding)::BIGINT AS dim,
       {r6('sqrt(list_sum(list_transform(embedding, lambda x: x * x)))', 'norm')} FROM refs"""

ORACLE["build_ref_index"] = with_(VECTORS) + f""",
flat AS (
  SELECT label, {CODE.format('label', 'X')} AS code, lpad((vec_id // 50)::VARCHAR, 6, '0') AS part,
         unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM vectors)
SELECT 'n' || label || '_' || code || label || '_20230207_' || part || '.wav' AS filename,
       'n' || label || '_' || code || label AS site_id, 'n' || label AS country, code AS site_type,
       count(*) AS num_segments, pos::BIGINT AS pos, {r6('avg(x)', 'value')}
FROM flat GROUP BY label, code, part, pos"""

# References are not held to the duration limits.
ORACLE["build_ref_tables"] = with_(SIGNALS.replace("< 7.5 THEN", "< 0 THEN").replace("> 36 THEN", "> 1e9 THEN"), QUANTISED, _resampled("quantised"), SEGMENTS) + f""",
quarters AS (SELECT recording_id, segment_idx, pos // 4 AS pos, avg(v) AS x FROM segments GROUP BY ALL)
SELECT {NAME} AS filename, 'c' || recording_id % 7 AS country, {CODE.format('recording_id', 'X')} AS site_type,
       count(*) AS num_segments, 'c' || recording_id % 7 || '_' || {CODE.format('recording_id', 'X')} || recording_id AS site_id,
       pos, {r6('avg(x)', 'value')}
FROM quarters GROUP BY recording_id, pos"""

ORACLE["pool_refs_by_site"] = with_(REFS) + f""",
flat AS (SELECT *, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM refs)
SELECT min(ref_id) AS ref_id, site_id, country, site_type, count(*) AS num_segments, pos::BIGINT AS pos, {r6('avg(x)', 'value')}
FROM flat GROUP BY site_id, country, site_type, pos"""

ORACLE["job_log_append"] = with_(LOG) + "SELECT pk, sk, analysis_id, analysis_id AS upload_id, event_id, status, error FROM log"

ORACLE["lookup_items"] = with_(LOG) + "SELECT pk, sk, event_id, status FROM log WHERE sk = 'RESULT'"

# The last put of an item, and of each attribute the newest value that is not null from there on.
ITEMS = """log AS (
  SELECT CASE WHEN event_type IN ('signup', 'click') THEN 'UPLOAD#' ELSE 'ANALYSIS#' END || (user_id * 100 + day(ts)) AS pk,
         CASE WHEN event_type IN ('signup', 'click') THEN 'METADATA' WHEN event_type = 'view' THEN 'PREPROCESSED'
              WHEN event_type = 'purchase' THEN 'RESULT' ELSE 'ERROR' END AS sk,
         event_type <> 'click' AND (event_type = 'signup' OR event_id % 4 <> 0) AS is_put, ts, event_id,
         CASE WHEN event_id % 4 <> 0 THEN CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'processing'
              WHEN 'view' THEN 'preprocessed' WHEN 'purchase' THEN 'complete' ELSE 'failed' END END AS status,
         CASE WHEN event_id % 4 <> 1 THEN event_id * 10 END::BIGINT AS size_bytes,
         CASE WHEN event_id % 4 <> 2 THEN event_id % 9 END::BIGINT AS num_segments,
         CASE event_type WHEN 'error' THEN regexp_extract(props, '"k": ([0-9]+)', 1) END AS error
  FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY pk, sk ORDER BY ts, event_id) AS i FROM log),
puts AS (SELECT pk, sk, max(i) FILTER (is_put) AS put FROM placed GROUP BY ALL),
current AS (
  SELECT pk, sk, last(event_id ORDER BY i) AS event_id,
         """ + ", ".join(f"last({c} ORDER BY i) FILTER ({c} IS NOT NULL) AS {c}" for c in ("status", "size_bytes", "num_segments", "error")) + """
  FROM placed JOIN puts USING (pk, sk) WHERE i >= coalesce(put, 0) GROUP BY pk, sk)"""

ORACLE["stored_items"] = with_(ITEMS) + "SELECT * FROM current"
ORACLE["stored_item_lookup"] = with_(ITEMS) + "SELECT pk, sk, event_id, status, num_segments FROM current WHERE sk = 'RESULT'"

ORACLE["result_documents"] = with_(VECTORS, REFS, POOLED, PAIRS, CLASSES, TOP, POINTS, REF_POINTS) + f""",
wide AS (
  SELECT analysis_id, {', '.join(f"round(max(p) FILTER (status = '{s}'), 6) + 0.0 AS p_{s}" for s in ('healthy', 'degraded', 'restored_early', 'restored_mid'))}
  FROM probs GROUP BY 1),
best AS (
  SELECT analysis_id, {', '.join(f'max(site_id) FILTER (rank = {i}) AS site_{i}, round(max(similarity) FILTER (rank = {i}), 6) + 0.0 AS similarity_{i}' for i in (1, 2, 3))}
  FROM top GROUP BY 1)
SELECT analysis_id, 'complete' AS status, label, {r6('confidence', 'confidence')}, wide.* EXCLUDE (analysis_id),
       best.* EXCLUDE (analysis_id), 'projection_2d' AS type,
       (SELECT site_id FROM ref_points ORDER BY ref_id DESC LIMIT 1) AS tenth_point,
       (SELECT round(x, 6) + 0.0 FROM ref_points ORDER BY ref_id DESC LIMIT 1) AS tenth_x, {r6('x', 'x')}, {r6('y', 'y')},
       len(embedding)::BIGINT AS dimension, num_segments, 'mean' AS aggregation, false AS synthetic,
       'Classification based on acoustic similarity to reference sites. Not a definitive health diagnosis. Complements but does not replace visual surveys.' AS caveats
FROM pooled JOIN labels USING (analysis_id) JOIN wide USING (analysis_id) JOIN best USING (analysis_id) JOIN points USING (analysis_id)"""

ORACLE["storage_rollup"] = """
SELECT source AS bucket, lang AS prefix, count(*) AS objects, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ALL"""

ORACLE["item_count"] = "SELECT count(*) AS items FROM events WHERE event_type <> 'click'"

# --- Projections, filters, scalar functions ----------------------------------

ORACLE["parse_filenames"] = with_(FILES) + """
SELECT filename, country, site, site_type, country || '_' || site AS site_id,
       CASE WHEN NOT noise THEN '2023-02-07 12:04:00' END AS recorded_at FROM files"""

ORACLE["site_status"] = with_(REFS) + f"SELECT ref_id, site_type, {STATUS.format('site_type')} AS status FROM refs"

ORACLE["default_fields"] = with_(FILES) + """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN filename ELSE 'upload_' || s_suppkey || '.wav' END AS filename,
       CASE WHEN s_suppkey % 2 = 0 THEN 'audio/x-wav' ELSE 'audio/wav' END AS content_type,
       CASE WHEN s_suppkey % 5 <> 0 THEN 's' || s_suppkey ELSE 'unknown' END AS site_id,
       CASE WHEN s_suppkey % 4 <> 0 THEN 'Fiji' ELSE 'Unknown' END AS country,
       CASE WHEN s_suppkey % 7 <> 0 THEN 'H' ELSE 'U' END AS site_type
FROM files"""

ORACLE["display_labels"] = with_(SITES) + f"""
SELECT site_id, CASE WHEN site_id LIKE '%7' THEN 'Unknown' ELSE {TITLE.format('status')} END AS label FROM sites"""

ORACLE["filter_sites"] = with_(SITES) + """
SELECT *, 'All/All' AS view FROM sites
UNION ALL SELECT *, 'NATION_3/All' FROM sites WHERE country = 'NATION_3'
UNION ALL SELECT *, 'All/degraded' FROM sites WHERE status = 'degraded'
UNION ALL SELECT *, 'NATION_3/healthy' FROM sites WHERE country = 'NATION_3' AND status = 'healthy'"""

ORACLE["round_results"] = with_(VECTORS) + f""",
normed AS (
  SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS length, unnest(embedding) AS x,
         generate_subscripts(embedding, 1) - 1 AS pos FROM vectors)
SELECT vec_id, pos::BIGINT AS pos, {r6('length', 'length')}, {r6('x', 'value')} FROM normed"""

ORACLE["parse_keys"] = with_(LOG) + """
SELECT event_id, CASE sk WHEN 'METADATA' THEN 'UPLOAD' ELSE 'ANALYSIS' END AS kind,
       analysis_id::VARCHAR AS id, analysis_id::VARCHAR AS path_id FROM log"""

ORACLE["json_required_field"] = """
SELECT event_id,
       CASE WHEN event_type = 'view' THEN '' WHEN event_type IN ('signup', 'purchase') THEN regexp_extract(props, '"k": ([0-9]+)', 1) END AS k,
       CASE WHEN event_type = 'error' THEN 'ANALYZE_FAILED' WHEN event_type IN ('view', 'click') THEN 'MISSING_UPLOAD_ID' END AS error_code
FROM events"""

# --- Signal ------------------------------------------------------------------

ORACLE["recording_duration"] = with_(SAMPLES) + f"SELECT recording_id, n_samples, {r6('duration', 'duration')} FROM verdicts"

ORACLE["downmix_mono"] = with_(SIGNALS) + f"""
SELECT recording_id, sample_idx // 2 AS sample_idx, {r6('avg(v)', 'v')}, any_value(n_samples // 2) AS n_samples
FROM signals WHERE sample_idx // 2 < n_samples // 2 GROUP BY recording_id, sample_idx // 2"""

ORACLE["normalize_fullscale"] = with_(SAMPLES) + f""",
pcm AS (
  SELECT event_id, recording_id % 3 AS kind,
         trunc(v * CASE recording_id % 3 WHEN 0 THEN 32767 WHEN 1 THEN 2147483647 ELSE 127 END)::BIGINT AS pcm FROM samples)
SELECT event_id, pcm, {r6('pcm / (CASE kind WHEN 0 THEN 32768 WHEN 1 THEN 2147483648 ELSE 128 END)::DOUBLE', 'v')} FROM pcm"""

ORACLE["normalize_peak"] = with_(SIGNALS) + f""",
peaks AS (SELECT recording_id, max(abs(v * 1.5)) AS peak FROM signals GROUP BY 1),
scaled AS (SELECT recording_id, sample_idx, CASE WHEN peak > 0 THEN v * 1.5 / peak ELSE 0 END AS v FROM signals JOIN peaks USING (recording_id))
SELECT recording_id, sample_idx, {r6('v', 'by_peak')},
       {r6('CASE recording_id % 3 WHEN 0 THEN 0 ELSE v END', 'above_one')} FROM scaled"""

ORACLE["resample_linear"] = with_(SIGNALS, _resampled()) + f"""
SELECT recording_id, sample_idx, {r6('v', 'v')}, n_samples FROM resampled"""

ORACLE["resample_linear_clamped"] = with_(SIGNALS, _resampled(last="n_samples - 1")) + f"""
SELECT recording_id, sample_idx, {r6('v', 'v')}, n_samples FROM resampled"""

ORACLE["resample_endpoint"] = with_(SIGNALS, ENDPOINT) + f"""
SELECT recording_id, sample_idx, {r6('v', 'v')}, n_samples FROM resampled"""

ORACLE["segment_fixed"] = with_(SIGNALS, _resampled(), SEGMENTS) + f"""
SELECT recording_id, segment_idx, pos AS "offset", {r6('v', 'v')} FROM segments"""

ORACLE["segment_padded"] = with_(SIGNALS, ENDPOINT) + f""",
counts AS (
  SELECT recording_id, n_resampled // 16 + CASE WHEN n_resampled % 16 > 8 THEN 1 ELSE 0 END AS windows
  FROM verdicts WHERE error_code IS NULL),
cells AS (SELECT recording_id, unnest(range(windows * 16)) AS spot FROM counts)
SELECT c.recording_id, c.spot // 16 AS segment_idx, c.spot % 16 AS "offset", {r6('coalesce(r.v, 0)', 'v')}
FROM cells c LEFT JOIN resampled r ON r.recording_id = c.recording_id AND r.sample_idx = c.spot"""

ORACLE["segment_fixed_sql"], ORACLE["segment_padded_sql"] = ORACLE["segment_fixed"], ORACLE["segment_padded"]

ORACLE["first_window"] = with_(SIGNALS) + f""",
frames AS (
  SELECT recording_id, sample_idx // 2 AS frame, avg(v) AS v, any_value(n_samples // 2) AS n
  FROM signals WHERE sample_idx // 2 < n_samples // 2 GROUP BY recording_id, sample_idx // 2)
SELECT recording_id, CASE WHEN any_value(n) >= 128 OR any_value(n) > 64 THEN 128 ELSE 0 END::BIGINT AS n,
       round(CASE WHEN any_value(n) > 64 THEN sum(v) FILTER (frame < 128) END, 6) + 0.0 AS total
FROM frames GROUP BY recording_id"""

ORACLE["quantize_pcm16"] = with_(SAMPLES) + "SELECT event_id, trunc(v * 32767)::BIGINT AS pcm FROM samples"

ORACLE["recording_summary"] = with_(SAMPLES) + f"""
SELECT recording_id, 4::BIGINT AS sample_rate, 4::DOUBLE AS segment_duration, 16::BIGINT AS segment_samples,
       {r6('n_resampled / 4::DOUBLE', 'total_duration')}, sample_rate::BIGINT AS original_sample_rate, n_resampled // 16 AS num_segments
FROM verdicts WHERE error_code IS NULL"""

# --- Validation --------------------------------------------------------------

ORACLE["validate_duration"] = with_(SAMPLES) + f"""
SELECT recording_id, {r6('duration', 'duration')}, n_resampled // 16 AS num_segments, error_code,
       CASE error_code WHEN 'AUDIO_TOO_SHORT' THEN 7.5::DOUBLE END AS min_duration_required,
       CASE error_code WHEN 'AUDIO_TOO_LONG' THEN 36::DOUBLE END AS max_duration_allowed
FROM verdicts"""

ORACLE["validate_format"] = with_(SAMPLES) + """
SELECT recording_id, CASE WHEN recording_id % 5 > 0 THEN 'INVALID_AUDIO_FORMAT' END AS error_code,
       CASE recording_id % 5 WHEN 1 THEN 'missing RIFF header' WHEN 2 THEN 'missing WAVE marker'
            WHEN 3 THEN 'missing format chunk' WHEN 4 THEN 'unsupported bit depth: 24-bit' END AS error,
       CASE recording_id % 5 WHEN 1 THEN 'missing RIFF header' WHEN 2 THEN 'missing WAVE marker' END AS marker_error,
       CASE recording_id % 5 WHEN 0 THEN n_samples END AS frames
FROM verdicts"""

ORACLE["dead_letter"] = with_(SAMPLES) + f""",
damaged AS (
  SELECT recording_id, recording_id % 5 AS damage, duration, n_resampled,
         CASE recording_id % 5 WHEN 2 THEN 43 + 2 * n_samples WHEN 3 THEN 36 ELSE 44 + 2 * n_samples END AS length
  FROM verdicts),
judged AS (
  SELECT *, CASE WHEN length > 190 THEN 'FILE_TOO_LARGE' WHEN damage IN (1, 3) THEN 'INVALID_AUDIO_FORMAT'
                 WHEN damage = 2 THEN 'PROCESSING_FAILED' WHEN duration < 12 THEN 'AUDIO_TOO_SHORT'
                 WHEN duration > 24 THEN 'AUDIO_TOO_LONG' END AS error_code
  FROM damaged)
SELECT {NAME} AS filename, error_code FROM judged WHERE error_code IS NOT NULL"""

ORACLE["stream_recordings"] = with_(SAMPLES) + f""",
judged AS (
  SELECT *, CASE recording_id % 5 WHEN 2 THEN 43 + 2 * n_samples WHEN 3 THEN 36 WHEN 4 THEN 0 ELSE 44 + 2 * n_samples END AS length,
         CASE WHEN recording_id % 5 IN (1, 3, 4) THEN 'INVALID_AUDIO_FORMAT' WHEN recording_id % 5 = 2 THEN 'PROCESSING_FAILED'
              ELSE error_code END AS found
  FROM verdicts)
SELECT {NAME} AS filename, found AS error_code, CASE WHEN found IS NULL THEN n_resampled // 16 ELSE 0 END::BIGINT AS windows FROM judged"""
ORACLE["recording_source"] = ORACLE["stream_recordings"].replace("AS filename,", "AS filename, length::BIGINT AS length,")

ORACLE["errors_by_code"] = with_(SAMPLES) + """
SELECT error_code, count(*) AS errors FROM verdicts WHERE error_code IS NOT NULL GROUP BY 1"""

ORACLE["orphan_requests"] = with_(LOG) + """
SELECT analysis_id, analysis_id AS upload_id, 'UPLOAD_NOT_FOUND' AS error_code FROM requests
WHERE analysis_id NOT IN (SELECT analysis_id FROM log WHERE sk = 'METADATA')"""

ORACLE["matched_requests"] = with_(LOG) + """
SELECT analysis_id, analysis_id AS upload_id FROM requests
WHERE analysis_id IN (SELECT analysis_id FROM log WHERE sk = 'METADATA')"""

# --- Features ----------------------------------------------------------------

_LEVELS = with_(SIGNALS, _resampled(), SEGMENTS, LEVELS)
_SPECTRA = with_(SIGNALS, _resampled(), SEGMENTS, SPECTRA)

ORACLE["feature_rms"] = _LEVELS + f"SELECT recording_id, segment_idx, {r6('rms', 'rms')} FROM levels"
ORACLE["feature_zcr"] = _LEVELS + f"SELECT recording_id, segment_idx, zero_crossings, {r6('zcr', 'zcr')} FROM levels"
ORACLE["feature_peak"] = _LEVELS + f"SELECT recording_id, segment_idx, {r6('peak', 'peak')} FROM levels"

ORACLE["magnitude_spectrum"] = _SPECTRA + f"""
SELECT recording_id, segment_idx, bin::BIGINT AS bin, {r6('frequency', 'frequency')}, {r6('magnitude', 'magnitude')}, {r6('share', 'share')}
FROM spectra"""

ORACLE["magnitude_spectrum_columns"] = ORACLE["magnitude_spectrum"]

ORACLE["spectral_centroid"] = _SPECTRA + f"SELECT recording_id, segment_idx, {r6('centroid', 'centroid')} FROM centroids"

FEATURES = """described AS (
  SELECT recording_id, segment_idx, unnest([rms, rms, peak, peak, zcr, zcr, centroid / 2, centroid / 2]) AS value,
         unnest(range(8)) AS pos
  FROM levels JOIN centroids USING (recording_id, segment_idx))"""

ORACLE["feature_embedding"] = with_(SIGNALS, _resampled(), SEGMENTS, LEVELS, SPECTRA, FEATURES) + f"""
SELECT recording_id, segment_idx, pos, {r6('value', 'value')} FROM described"""

ORACLE["feature_embedding_noisy"] = with_(SIGNALS, _resampled(), SEGMENTS, LEVELS, SPECTRA, FEATURES) + f"""
SELECT recording_id, segment_idx, (pos // 2)::BIGINT AS block, 320::BIGINT AS n, {r6('min(value)', 'value')}, true AS near, true AS varied
FROM described GROUP BY recording_id, segment_idx, pos // 2"""

# --- Embedding ---------------------------------------------------------------

ORACLE["embed_segments"] = with_(SIGNALS, QUANTISED, _resampled("quantised"), SEGMENTS) + f"""
SELECT recording_id, segment_idx, pos // 4 AS pos, {r6('avg(v)', 'value')}
FROM segments GROUP BY recording_id, segment_idx, pos // 4"""

ORACLE["embed_length_guard"] = with_(SIGNALS, _resampled()) + """
SELECT recording_id, sample_idx // 16 AS segment_idx, count(*) = 16 AS length_ok,
       CASE WHEN count(*) <> 16 THEN 'Expected 16 samples, got ' || count(*) END AS error
FROM resampled GROUP BY recording_id, sample_idx // 16"""

ORACLE["truncate_dim"] = with_(VECTORS, POOLED) + f"""
SELECT vec_id, pos::BIGINT AS pos, {r6('x', 'value')} FROM flat WHERE pos < 40"""

ORACLE["mean_pool"] = with_(VECTORS, POOLED) + f"""
SELECT analysis_id, num_segments, pos::BIGINT AS pos, {r6('value', 'value')} FROM pooled_flat"""

ORACLE["mean_pool_matrices"] = ORACLE["mean_pool"]

ORACLE["embed_with_fallback"] = with_(VECTORS, POOLED) + f""",
faulty AS (SELECT analysis_id, bool_or(vec_id % 7 = 0) AS synthetic, count(*) AS num_segments FROM vectors GROUP BY 1)
SELECT analysis_id, synthetic, num_segments, pos::BIGINT AS pos, {r6('avg(CASE WHEN synthetic THEN x * x + pos ELSE x END)', 'value')}
FROM flat JOIN faulty USING (analysis_id) GROUP BY ALL"""

ORACLE["embedding_summary"] = with_(VECTORS) + """
SELECT analysis_id, max(len(embedding))::BIGINT AS dimension, count(*) AS num_segments, 'mean' AS aggregation,
       bool_or(vec_id % 7 = 0) AS synthetic
FROM vectors GROUP BY 1"""

# --- Similarity --------------------------------------------------------------

_SIMILARITY = with_(VECTORS, REFS, POOLED, PAIRS, CLASSES)

ORACLE["pair_with_refs"] = with_(VECTORS, REFS, POOLED, PAIRS) + """
SELECT p.analysis_id, any_value(len(embedding))::BIGINT AS dim, count(ref_id) AS comparable,
       count(*) FILTER (site_type <> 'U') AS categorised
FROM pooled p LEFT JOIN pairs s ON s.analysis_id = p.analysis_id GROUP BY 1"""

ORACLE["cosine_similarity"] = with_(VECTORS, POOLED) + f"""
SELECT vec_id, analysis_id, {r6('list_cosine_similarity(v.embedding, p.embedding)', 'similarity')}
FROM vectors v JOIN pooled p USING (analysis_id)"""

ORACLE["enrich_sites"] = with_(FILES) + f"""
SELECT s_suppkey, country || '_' || site AS site_id, country, coalesce(n_name, 'Unknown') AS country_name,
       {STATUS.format('site_type')} AS status
FROM files LEFT JOIN nation ON 'n' || n_nationkey = country"""

ORACLE["category_similarity"] = with_(VECTORS, REFS, POOLED, PAIRS) + f"""
SELECT analysis_id, site_type, {STATUS.format('site_type')} AS status, {r6('avg(similarity)', 'similarity')}
FROM pairs WHERE site_type <> 'U' GROUP BY analysis_id, site_type"""

ORACLE["complete_categories"] = _SIMILARITY + f"""
SELECT analysis_id, ordinal::BIGINT AS ordinal, status, {r6("CASE status WHEN 'restored_mid' THEN 0.1::DOUBLE ELSE s END", 'similarity')}
FROM scores"""

ORACLE["class_probabilities"] = _SIMILARITY + f"SELECT analysis_id, status, {r6('p', 'probability')} FROM probs"

ORACLE["classify"] = _SIMILARITY + f"""
SELECT analysis_id, num_segments, label, {r6('confidence', 'confidence')}, valid FROM labels JOIN pooled USING (analysis_id)"""

ORACLE["probabilities_long"] = _SIMILARITY + f"SELECT analysis_id, {TITLE.format('status')} AS status, {r6('p', 'probability')} FROM probs"

ORACLE["classify_no_refs"] = with_(VECTORS) + """
SELECT DISTINCT analysis_id, 'healthy' AS label, 0.65::DOUBLE AS confidence, false AS valid,
       s.rank::BIGINT AS rank, s.site_id, s.country, 'healthy' AS status, s.similarity::DOUBLE AS similarity
FROM vectors, (VALUES (1, 'aus_H1', 'Australia', 0.94), (2, 'idn_H1', 'Indonesia', 0.91), (3, 'aus_H2', 'Australia', 0.88))
  AS s(rank, site_id, country, similarity)"""

ORACLE["top_k_sites"] = ORACLE["top_k_sites_blocked"] = with_(VECTORS, REFS, POOLED, PAIRS, TOP) + f"""
SELECT analysis_id, rank, ref_id, site_id, country, status, {r6('similarity', 'similarity')} FROM top"""

ORACLE["ref_points"] = with_(REFS, REF_POINTS) + f"SELECT ref_id, site_id, status, {r6('x', 'x')}, {r6('y', 'y')} FROM ref_points"

ORACLE["project_2d"] = with_(VECTORS, POOLED, POINTS) + f"SELECT analysis_id, {r6('x', 'x')}, {r6('y', 'y')} FROM points"

ORACLE["acoustic_space"] = with_(VECTORS, REFS, POOLED, PAIRS, CLASSES, POINTS, REF_POINTS) + f"""
SELECT analysis_id::VARCHAR AS point_id, 'Your Sample' AS site, {TITLE.format('label')} AS status, 'Your Sample' AS type, {r6('x', 'x')}, {r6('y', 'y')}
FROM points JOIN labels USING (analysis_id)
UNION ALL
SELECT ref_id::VARCHAR, site_id, {TITLE.format('status')}, 'Reference', {r6('x', 'x')}, {r6('y', 'y')} FROM ref_points"""

# --- Job status --------------------------------------------------------------

ORACLE["latest_state"] = with_(LOG) + """
SELECT pk, sk, event_id, status, error FROM log
QUALIFY row_number() OVER (PARTITION BY pk, sk ORDER BY ts DESC, event_id DESC) = 1"""


def _resolved(order: str) -> str:
    return with_(LOG) + f""",
last_error AS (
  SELECT analysis_id, error FROM log WHERE sk = 'ERROR'
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY ts DESC, event_id DESC) = 1),
states AS (
  SELECT analysis_id, CASE {order} ELSE 'not_found' END AS status FROM requests r)
SELECT analysis_id, status, CASE status WHEN 'failed' THEN error WHEN 'not_found' THEN 'ANALYSIS_NOT_FOUND' END AS error
FROM states LEFT JOIN last_error USING (analysis_id)"""


def _has(sk: str, status: str) -> str:
    return f"WHEN r.analysis_id IN (SELECT analysis_id FROM log WHERE sk = '{sk}') THEN '{status}'"


_COMPLETE, _PROCESSING, _FAILED = _has("RESULT", "complete"), _has("PREPROCESSED", "processing"), _has("ERROR", "failed")

ORACLE["resolve_status"] = _resolved(f"{_COMPLETE} {_PROCESSING} {_FAILED}")
ORACLE["resolve_status_errors_first"] = _resolved(f"{_COMPLETE} {_FAILED} {_PROCESSING}")

ORACLE["upload_lifecycle"] = with_(LOG) + """
SELECT DISTINCT u.analysis_id AS upload_id, a.analysis_id,
       CASE WHEN r.analysis_id IS NOT NULL THEN 'complete' WHEN a.analysis_id IS NOT NULL THEN 'processing' ELSE 'uploaded' END AS status
FROM log u LEFT JOIN log a ON a.analysis_id = u.analysis_id AND a.sk = 'PREPROCESSED'
LEFT JOIN log r ON r.analysis_id = a.analysis_id AND r.sk = 'RESULT' WHERE u.sk = 'METADATA'"""

ORACLE["status_answers"] = with_(LOG.replace("FROM events)", "FROM events UNION SELECT vec_id // 4 FROM embeddings)"), VECTORS, REFS, POOLED, PAIRS, CLASSES) + f""",
last_error AS (
  SELECT analysis_id, error FROM log WHERE sk = 'ERROR'
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY ts DESC, event_id DESC) = 1),
states AS (SELECT analysis_id, CASE {_COMPLETE} {_PROCESSING} {_FAILED} ELSE 'not_found' END AS status FROM requests r)
SELECT analysis_id, status, CASE status WHEN 'failed' THEN error WHEN 'not_found' THEN 'ANALYSIS_NOT_FOUND' END AS error,
       CASE status WHEN 'complete' THEN label END AS label,
       CASE status WHEN 'complete' THEN round(confidence, 6) + 0.0 END AS confidence
FROM states LEFT JOIN last_error USING (analysis_id) LEFT JOIN labels USING (analysis_id)"""

# --- Reports -----------------------------------------------------------------

ORACLE["status_counts"] = with_(SITES) + "SELECT status, count(*) AS sites FROM sites GROUP BY 1"

ORACLE["site_metrics"] = with_(SITES) + """
SELECT count(*) AS total_sites, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded,
       count(*) FILTER (status LIKE 'restored%') AS restored FROM sites"""

ORACLE["country_status_pivot"] = with_(SITES) + """
, told AS (SELECT country, right(site_id, 1) NOT IN ('7', '8') AS known, status FROM sites)
SELECT country, count(*) FILTER (known AND status = 'healthy') AS healthy, count(*) FILTER (known AND status = 'degraded') AS degraded,
       count(*) FILTER (known AND status = 'restored_early') AS restored_early,
       count(*) FILTER (known AND status = 'restored_mid') AS restored_mid, count(*) FILTER (NOT known) AS unknown
FROM told GROUP BY country"""

ORACLE["value_counts"] = with_(SITES) + """
SELECT 'status' AS field, status AS value, count(*) AS n FROM sites GROUP BY ALL
UNION ALL SELECT 'country', country, count(*) FROM sites GROUP BY ALL"""

ORACLE["distinct_countries"] = with_(SITES) + "SELECT DISTINCT country FROM sites ORDER BY 1"

ORACLE["recent_errors"] = """
SELECT event_type AS function,
       count(*) FILTER (value > 30 AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) AS errors
FROM events GROUP BY 1"""

ORACLE["monthly_cost_by_service"] = with_(USAGE) + """
SELECT month, service, round(sum(amount), 2) AS cost FROM usage GROUP BY ALL"""

ORACLE["compute_metering"] = with_(USAGE) + f""",
monthly AS (SELECT month, sum(gb_seconds) AS g, count(*) AS requests FROM usage GROUP BY 1)
SELECT month, {r6('g', 'gb_seconds')}, requests,
       {r6('greatest(0, g - 5000) * 0.0000166667::DOUBLE + greatest(0, requests - 200) * (0.2::DOUBLE / 1000000)', 'cost')}
FROM monthly"""

ORACLE["index_build_stats"] = with_(FILES) + """
SELECT country, site_type, count(*) AS files, count(*) FILTER (num_segments > 0) AS files_ok, sum(num_segments)::BIGINT AS segments
FROM files GROUP BY ALL"""

# --- Whole analysis of recording files ---------------------------------------

ORACLE["analyse_recordings"] = with_(SIGNALS, QUANTISED, _resampled("quantised"), SEGMENTS) + f""",
quarters AS (SELECT recording_id, segment_idx, pos // 4 AS pos, avg(v) AS x FROM segments GROUP BY ALL),
pooled_flat AS (SELECT recording_id, pos, avg(x) AS x, count(*) AS num_segments FROM quarters GROUP BY ALL),
pooled AS (
  SELECT recording_id AS analysis_id, list(x ORDER BY pos) AS embedding, max(num_segments) AS num_segments FROM pooled_flat GROUP BY 1),
refs AS (
  SELECT analysis_id AS ref_id, 'c' || analysis_id % 7 AS country, {CODE.format('analysis_id', 'X')} || analysis_id AS site_id,
         {CODE.format('analysis_id', 'X')} AS site_type, embedding FROM pooled),
{PAIRS}, {CLASSES}
SELECT {NAME.replace('recording_id', 'analysis_id')} AS filename, num_segments, false AS synthetic, label, {r6('confidence', 'confidence')}
, NULL AS error_code
FROM labels JOIN pooled USING (analysis_id)
UNION ALL SELECT {NAME}, NULL, NULL, NULL, NULL, error_code FROM verdicts WHERE error_code IS NOT NULL"""

# --- Streaming ---------------------------------------------------------------

ORACLE["stream_chain"] = f"""
SELECT *, CASE WHEN error_code IS NULL THEN 'complete' ELSE 'failed' END AS status FROM ({ORACLE['analyse_recordings']})"""

ORACLE["stream_features"] = with_(SIGNALS, QUANTISED, _resampled("quantised"), SEGMENTS, LEVELS, SPECTRA) + f"""
SELECT {NAME} AS filename, segment_idx, {r6('rms', 'rms')}, {r6('peak', 'peak')}, zero_crossings, {r6('centroid', 'centroid')}
FROM levels JOIN centroids USING (recording_id, segment_idx)"""

ORACLE["stream_classify"] = with_(VECTORS, REFS, POOLED, PAIRS, CLASSES, TOP) + f"""
SELECT analysis_id, label, {r6('confidence', 'confidence')}, site_id, {r6('similarity', 'similarity')}
FROM labels JOIN top USING (analysis_id) WHERE rank = 1"""

ORACLE["stream_status"] = _resolved(f"{_COMPLETE} {_PROCESSING} {_FAILED}").replace(
    "FROM states", "FROM (SELECT * FROM states WHERE analysis_id IN (SELECT analysis_id FROM log)) AS states")

ORACLE["stream_status_expiring"] = f"SELECT * FROM ({ORACLE['stream_status']}) WHERE status <> 'not_found'"

ORACLE["stream_dedup"] = with_(LOG) + "SELECT DISTINCT pk, sk, event_id, status FROM log"

ORACLE["stream_error_window"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS function, count(*) AS errors
FROM events WHERE value > 30 GROUP BY ALL"""
