"""SQL of the catalogue queries, for DuckDB on the same tables."""

from __future__ import annotations

_DAY = "strftime(ts, '%Y-%m-%d')"
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_LISTING = "SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CAST(strlen(text) AS BIGINT) * 2048 AS bytes FROM documents"
_READING = f"""
  SELECT count(*) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, first(path ORDER BY bytes DESC, path) AS largest, max(bytes) AS largest_bytes,
         count(*) FILTER (bytes > 26214400) AS n_oversized, last(path ORDER BY bytes, path) FILTER (bytes > 26214400) AS worst
  FROM ({_LISTING})"""
_VERDICT = "CASE WHEN n_oversized > 0 THEN 'oversized' WHEN count > 1200 THEN 'over_cap' WHEN count > 900 THEN 'over_budget' ELSE 'ok' END"
_SHA = "md5(CAST(doc_id AS VARCHAR)) || substr(md5('x' || CAST(doc_id AS VARCHAR)), 1, 8)"
_CACHE = f"""
  SELECT doc_id, {_SHA} AS sha,
         CASE doc_id % 4 WHEN 0 THEN {_SHA} || ':v' || doc_id % 15 || ':h' WHEN 1 THEN {_SHA} || ':eli5:v' || doc_id % 15 || ':h' WHEN 2 THEN {_SHA} || ':h' ELSE 'rollup:' || doc_id % 15 END AS key
  FROM documents"""
_MARKED = f"""
  SELECT *, CASE WHEN kind = 'eli5' THEN v < 7 WHEN kind = 'summary' THEN v < 11 ELSE regexp_matches(key, '^[0-9a-f]{{40}}:') END AS stale
  FROM (SELECT *, CASE WHEN regexp_matches(key, ':eli5:v[0-9]+:') THEN 'eli5' WHEN regexp_matches(key, ':v[0-9]+:') THEN 'summary' END AS kind,
               TRY_CAST(nullif(regexp_extract(key, ':v([0-9]+):', 1), '') AS BIGINT) AS v
        FROM ({_CACHE}))"""
#: Files of the diffs that the patch queries parse, as the line items say.
_FILES = """
  SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS BIGINT) AS file_no,
         'p' || l_partkey || '.ts' AS path, CAST(l_quantity AS INTEGER) AS q, CAST(l_quantity AS INTEGER) % 3 AS k
  FROM lineitem"""

#: The same of the diffs with headers of other kinds.
_HEADERS = """
  SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS BIGINT) AS file_no,
         'p' || l_partkey AS path, CAST(l_quantity AS INTEGER) AS q, CAST(l_quantity AS INTEGER) % 6 AS k
  FROM lineitem"""
#: Orders as records, their evidence and the notes that parts of the same day give.
_CLAIMS = """
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS sha, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus = 'P' AS noise, 'order ' || o_orderkey AS title,
         CASE WHEN o_orderkey % 7 <> 4 THEN 'words of ' || o_orderkey END AS words,
         CASE o_orderkey % 7 WHEN 0 THEN 'Group ' || o_custkey % 9 || ' in Singapore left full access on ' || strftime(o_orderdate, '%Y-%m-%d') || '.'
                             WHEN 1 THEN 'Group ' || o_custkey % 9 || ' of Israel left access.' ELSE '' END AS evidence
  FROM orders"""
_NOTES = f"""
  SELECT DISTINCT a.sha, a.day, b.sha AS peer, a.evidence || ' ' || b.words AS text
  FROM ({_CLAIMS}) a JOIN lineitem x ON x.l_orderkey = a.o_orderkey JOIN lineitem y ON y.l_partkey = x.l_partkey JOIN ({_CLAIMS}) b ON b.o_orderkey = y.l_orderkey AND b.day = a.day
  WHERE a.evidence <> '' AND NOT a.noise AND b.evidence = '' AND b.words IS NOT NULL AND NOT b.noise AND x.l_partkey % 5 <> 0"""

_EVENTS = f"""
  SELECT event_id, day(ts) AS n, lpad(CAST(event_id AS VARCHAR), 12, '0') AS sha, {_STAMP} AS date, {_DAY} AS shard, CASE WHEN event_id % 3 <> 0 THEN {_DAY} END AS day, event_type AS kind, props, user_id
  FROM events"""
_SYNC = """
        WITH e AS (SELECT event_id, md5(event_type) AS head, epoch_us(ts) // 1000 AS now, lag(md5(event_type)) OVER w AS last, lag(epoch_us(ts) // 1000) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, CASE WHEN last IS NULL THEN 'no prior sync recorded' WHEN last <> head THEN 'upstream advanced ' || substr(last, 1, 8) || ' -> ' || substr(head, 1, 8)
                              WHEN coalesce(prev, 0) = 0 THEN 'last sync timestamp unreadable'
                              WHEN now - prev >= 18000000 THEN 'last sync ' || (now - prev) // 60000 || 'm ago exceeded 300m budget' ELSE '' END AS reason
        FROM e"""

ORACLE = {
    "store_fields": f"""
        SELECT sha, shard, kind, 't' || event_id AS title, user_id, event_id % 5 AS deep, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS noise, true AS misfit FROM ({_EVENTS})""",
    "store_round_trip": f"""
        SELECT shard, count(*) AS entries, CAST(sum(length(concat_ws('|', sha, date, day, kind, props, 't' || event_id))) AS BIGINT) AS chars, CAST(sum(user_id) AS BIGINT) AS users, min(sha) AS first, max(sha) AS last
        FROM ({_EVENTS}) GROUP BY shard""",
    "store_merge": f"""
        SELECT sha, CASE WHEN moved THEN '2031-01-01' ELSE shard END AS shard, CASE WHEN moved THEN 'edited ' || kind ELSE kind END AS kind, user_id
        FROM (SELECT *, n <= 18 AND event_id % 11 = 0 AS moved FROM ({_EVENTS}))""",
    "shard_manifest": f"SELECT {_DAY} AS shard, count(*) AS entries, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "day_keys": f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN {_DAY} ELSE 'unknown' END AS shard FROM events",
    "canonical_sort": f"""
        SELECT date, sha, CAST(row_number() OVER (ORDER BY date, sha) AS INTEGER) AS rank
        FROM (SELECT {_STAMP} AS date, lpad(CAST(event_id AS VARCHAR), 12, '0') AS sha FROM events) ORDER BY date, sha LIMIT 100""",
    "canonical_ranks": f"""
        SELECT date, sha, row_number() OVER (ORDER BY date, sha) AS rank
        FROM (SELECT {_STAMP} AS date, lpad(CAST(event_id AS VARCHAR), 12, '0') AS sha FROM events)""",
    "shard_diff": f"""
        WITH e AS (SELECT {_DAY} AS shard, day(ts) AS n, event_id, concat_ws('|', event_id, event_type, props) AS r FROM events),
        o AS (SELECT shard, string_agg(r, chr(10) ORDER BY event_id) AS c FROM e WHERE n <= 18 GROUP BY shard),
        w AS (SELECT shard, string_agg(CASE WHEN n = 5 AND event_id % 7 = 0 THEN r || '*' ELSE r END, chr(10) ORDER BY event_id) AS c FROM e WHERE n >= 3 GROUP BY shard)
        SELECT coalesce(o.shard, w.shard) AS shard, CASE WHEN o.c IS NULL THEN 'write' WHEN w.c IS NULL THEN 'delete' WHEN o.c = w.c THEN 'keep' ELSE 'rewrite' END AS action
        FROM o FULL JOIN w ON o.shard = w.shard""",
    "legacy_migrate": "SELECT conv_id, turn, role, text FROM conversations",
    "size_budget": """
        SELECT doc_id, CAST(b AS INTEGER) AS bytes, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY b DESC, doc_id) AS INTEGER) AS rank
        FROM (SELECT doc_id, strlen(text) AS b, CASE WHEN strlen(text) >= 20000 THEN 'over' WHEN strlen(text) >= 8000 THEN 'near' END AS bucket FROM documents)
        WHERE bucket IS NOT NULL""",
    "size_texts": """
        SELECT doc_id, printf('%.1f', floor(CAST(strlen(text) AS DOUBLE) / 1048576 * 10 + 0.5) / 10) || ' MiB' AS mib, printf('%.1f', floor(CAST(strlen(text) AS DOUBLE) / 1024 * 10 + 0.5) / 10) || ' KiB' AS kib
        FROM documents""",
    "dist_budget": f"""
        SELECT count, bytes, largest, largest_bytes, CAST(n_oversized AS INTEGER) AS n_oversized, count > 1200 OR n_oversized > 0 AS over_cap, count > 900 AS over_budget,
               false AS tight_margin, {_VERDICT} AS verdict
        FROM ({_READING})""",
    "dist_message": f"""
        WITH r AS (SELECT *, {_VERDICT} AS verdict, printf('%.1f', floor(CAST(bytes AS DOUBLE) / 1048576 * 10 + 0.5) / 10) || ' MiB' AS total FROM ({_READING})),
        f AS (SELECT r.*, w.bytes AS worst_bytes FROM r LEFT JOIN ({_LISTING}) w ON w.path = r.worst)
        SELECT verdict, 'dist/ ' || format('{{:,}}', count) || CASE WHEN count = 1 THEN ' file (' ELSE ' files (' END || total || ', ' || CAST(floor(count / 1200.0::DOUBLE * 100 + 0.5) AS BIGINT) || '% of the 1,200-file cap): ' ||
               CASE verdict WHEN 'oversized' THEN worst || ' is ' || printf('%.1f', floor(CAST(worst_bytes AS DOUBLE) / 1048576 * 10 + 0.5) / 10) || ' MiB, more than the 25 MiB that one asset may have'
                            WHEN 'over_cap' THEN 'above the cap of 1,200 assets, so the next upload fails' WHEN 'over_budget' THEN 'above the budget of 900'
                            ELSE 'within the budget of 900, with a margin of 300' END AS message
        FROM f""",
    "retention": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path FROM orders ORDER BY o_orderdate DESC, path LIMIT 900",
    "retention_cut": """
        WITH f AS (SELECT l_shipdate AS date, CAST(l_quantity AS BIGINT) AS bytes, concat_ws('/', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS path FROM lineitem),
        s AS (SELECT path, row_number() OVER w AS place, CAST(sum(bytes) OVER w AS BIGINT) AS running FROM f WINDOW w AS (ORDER BY date DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT path, place, running, place <= 25000 AND running <= 500000 AS kept FROM s""",
    "cache_prune": f"SELECT key, kind, v, stale FROM ({_MARKED})",
    "keep_list_prune": f"""
        SELECT m.key, m.stale, m.stale AND k.sha IS NULL AS removed
        FROM ({_MARKED}) m LEFT JOIN (SELECT DISTINCT sha FROM ({_CACHE}) JOIN labels USING (doc_id) WHERE quality = 1) k ON split_part(m.key, ':', 1) = k.sha""",
    "refresh_queue": f"SELECT key FROM ({_MARKED}) WHERE stale ORDER BY key LIMIT 10",
    "sync_reason": _SYNC,
    "sync_stream": _SYNC,
    "status_check": """
        WITH l AS (SELECT event_type, max(ts) AS ts FROM events GROUP BY 1), n AS (SELECT epoch_us(max(ts)) // 1000 AS now FROM l),
        c AS (SELECT event_type, epoch_us(date_trunc('second', ts)) // 1000 AS stamp, now FROM l, n)
        SELECT event_type, CASE WHEN now - stamp >= 1800000 THEN 'status stamp is stale or invalid' END AS failure, CASE WHEN now - stamp < 1800000 THEN CAST(greatest(0, now - stamp) AS BIGINT) END AS age_ms
        FROM c""",
    "traffic_upsert": f"""
        WITH e AS (SELECT {_DAY} AS timestamp, day(ts) AS n, event_id, user_id FROM events),
        b AS (SELECT timestamp, 0 AS turn, count(*) AS count, count(DISTINCT user_id) AS uniques FROM e WHERE n <= 20 GROUP BY 1
              UNION ALL SELECT timestamp, 1, count(*), count(DISTINCT user_id) FROM e WHERE n >= 15 AND event_id % 2 = 0 GROUP BY 1)
        SELECT timestamp, count, uniques FROM (SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY turn DESC) AS k FROM b) WHERE k = 1""",
    "story_links": """
        WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, l_partkey AS path, o_orderkey AS sha FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
        SELECT DISTINCT a.day, a.sha, b.sha AS peer FROM p a JOIN p b ON a.day = b.day AND a.path = b.path AND a.sha < b.sha""",
    "prefix_ranges": """
        WITH k AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM orders), p AS (SELECT DISTINCT substr(lpad(CAST(c_custkey AS VARCHAR), 12, '0'), 1, 11 + CAST(c_custkey % 2 AS INTEGER)) AS prefix FROM customer),
        m AS (SELECT prefix, count(k.id) AS n, min(k.id) AS id FROM p LEFT JOIN k ON substr(k.id, 1, length(prefix)) = prefix GROUP BY prefix)
        SELECT prefix, n AS matches, CASE WHEN n = 1 THEN id END AS sha, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM m""",
    "prefix_lookup": """
        WITH k AS (SELECT DISTINCT md5(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders),
        a AS (SELECT DISTINCT substr(md5(CAST(c_custkey AS VARCHAR)), 1, CAST(3 + c_custkey % 4 AS INTEGER)) AS prefix FROM customer),
        f AS (SELECT a.prefix, count(k.sha) AS matches, min(k.sha) AS one FROM a LEFT JOIN k ON starts_with(k.sha, a.prefix) GROUP BY 1)
        SELECT prefix, matches, CASE WHEN matches = 1 THEN one END AS sha, CASE matches WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM f""",
    "override_edits": """
        WITH s AS (SELECT doc_id, 'stored' AS title, CASE WHEN doc_id % 4 = 0 THEN 'kept' END AS note FROM labels WHERE doc_id % 2 = 0),
        c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' END AS title, true AS noise FROM labels WHERE quality = 0),
        o AS (SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, coalesce(c.title, s.title) AS title, note, noise FROM s FULL JOIN c ON s.doc_id = c.doc_id),
        k AS (SELECT o.* FROM o WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
        SELECT CAST(d.doc_id AS VARCHAR) AS sha, CASE WHEN d.doc_id % 5 = 0 THEN 'by model' ELSE 'own ' || d.doc_id END AS begins, lang AS text, source AS eli5, k.title, note, noise
        FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "size_reading": f"""
        SELECT '2026-01-01T00:00:00Z' AS ts, CAST(sum(bytes) // 1024 AS BIGINT) AS sizeKiB, count(bytes) AS dataFiles, count(*) FILTER (bytes >= 20000000) AS overBudget, count(*) FILTER (bytes >= 8000000 AND bytes < 20000000) AS nearBudget
        FROM ({_LISTING})""",
    "commits_week": """
        WITH n AS (SELECT date_trunc('month', min(ts)) + INTERVAL 19 DAY AS now FROM events), t AS (SELECT unnest(['click', 'view', 'purchase']) AS event_type)
        SELECT t.event_type, count(e.event_id) AS count FROM t CROSS JOIN n LEFT JOIN events e ON e.event_type = t.event_type AND date_trunc('second', e.ts) <= now AND date_trunc('second', e.ts) > now - INTERVAL 7 DAY GROUP BY 1""",
    "store_status": f"""
        SELECT 'h' AS headSha, 'day-shards' AS layout, count(*) FILTER (n > 9) AS entries, CAST(7 AS BIGINT) AS changes, CAST(count(DISTINCT shard) FILTER (n > 9) AS INTEGER) AS days FROM ({_EVENTS})""",
    "override_merge": """
        SELECT CAST(d.doc_id AS VARCHAR) AS sha,
               coalesce(CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 2 = 0 THEN 'corrected' END, CASE WHEN d.doc_id % 3 = 0 THEN 'ai ' || lang END, 'own ' || d.doc_id) AS title,
               source AS summary, CASE WHEN l.doc_id IS NOT NULL THEN 'was wrong' END AS note, coalesce(CASE WHEN l.quality = 0 THEN true END, false) AS noise
        FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id""",
    "day_range": f"SELECT {_DAY} AS day, count(*) AS events FROM events WHERE {_DAY} <= (SELECT strftime(min(ts), '%Y-%m-') || '09' FROM events) GROUP BY 1",
    "feed_rows": f"""
        SELECT id, date, title, summary FROM (
          SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, {_STAMP} AS date, event_type AS title, CASE WHEN event_id % 2 = 0 THEN props ELSE 'user ' || user_id END AS summary
          FROM events WHERE event_type <> 'view') ORDER BY date DESC, id DESC LIMIT 50""",
    "compact_numbers": """
        WITH n AS (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS n FROM orders),
        u AS (SELECT *, CASE WHEN n < 999500 THEN 1000 ELSE 1000000 END AS unit, CASE WHEN n < 999500 THEN 'k' ELSE 'M' END AS suffix FROM n),
        t AS (SELECT *, CASE WHEN n < 9.995 * unit THEN printf('%.2f', ((n * 100 + unit // 2) // unit) / 100.0::DOUBLE)
                             WHEN n < 99.95 * unit THEN printf('%.1f', ((n * 10 + unit // 2) // unit) / 10.0::DOUBLE) ELSE CAST((n + unit // 2) // unit AS VARCHAR) END AS x FROM u)
        SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') || suffix ELSE x || suffix END AS short FROM t""",
    "patch_files": f"""
        SELECT key, file_no, CASE WHEN k <> 0 THEN path END AS old_path, CASE WHEN k <> 1 THEN path END AS new_path, CASE k WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status,
               '100644' AS mode, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS additions, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS deletions, CAST(1 AS BIGINT) AS hunks
        FROM ({_FILES})""",
    "patch_hunks": f"""
        SELECT key, file_no, CAST(1 AS BIGINT) AS hunk_no, CAST(q AS BIGINT) AS old_start, CAST(CASE k WHEN 0 THEN 0 ELSE 2 END AS BIGINT) AS old_len, CAST(q AS BIGINT) AS new_start,
               CAST(CASE k WHEN 1 THEN 0 ELSE 2 END AS BIGINT) AS new_len, 'at ' || q AS context_of, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS added,
               CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS removed, CAST(CASE k WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS context, true AS reconciles
        FROM ({_FILES})""",
    "patch_stats": f"""
        SELECT key, CAST(sum(CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) AS additions, CAST(sum(CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) AS deletions, count(*) AS total,
               CAST(count(*) FILTER (k = 0) AS INTEGER) AS n_added, CAST(count(*) FILTER (k = 1) AS INTEGER) AS n_removed, CAST(count(*) FILTER (k = 2) AS INTEGER) AS n_modified
        FROM ({_FILES}) GROUP BY key""",
    "version_bumps": f"SELECT key, file_no, CAST(1 AS BIGINT) AS hunk_no, '1.' || q AS old, '2.' || q AS new FROM ({_FILES}) WHERE k = 2",
    "hunk_sections": """
        WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS ls FROM documents WHERE coalesce(text, '') <> ''),
        e AS (SELECT doc_id, p - 1 AS line_no, ls[p] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM l)),
        s AS (SELECT *, sum(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM e)
        SELECT doc_id AS key, count(*) AS lines, CAST(max(section) AS BIGINT) AS sections, CAST(max(line_no) FILTER (section = 0) AS INTEGER) AS last_before FROM s GROUP BY 1""",
    "line_classify": """
        WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) AS line FROM documents WHERE coalesce(text, '') <> '')
        SELECT doc_id AS key, CASE WHEN line = '' THEN 'empty' WHEN line[1] IN ('A', 'E', 'I', 'O', 'U') THEN 'vowel' ELSE 'other' END AS kind, count(*) AS lines FROM l GROUP BY 1, 2""",
    "patch_headers": f"""
        SELECT key, file_no, CASE WHEN k < 5 THEN path END AS old_path, CASE WHEN k < 2 THEN 'moved/' || path ELSE path END AS new_path, CASE WHEN k < 2 THEN 'renamed' WHEN k = 5 THEN 'added' ELSE 'modified' END AS status,
               CAST(CASE k WHEN 0 THEN 100 WHEN 1 THEN 90 + CAST(substr(CAST(q AS VARCHAR), 1, 1) AS INTEGER) END AS INTEGER) AS similarity,
               CASE k WHEN 1 THEN '100644' WHEN 2 THEN '100644' WHEN 3 THEN '100755' WHEN 4 THEN '160000' WHEN 5 THEN '120000' END AS mode, k = 4 AS is_submodule, k = 5 AS is_symlink, k = 2 AS is_binary,
               CASE WHEN k > 0 THEN substr(md5(CAST(q AS VARCHAR)), 1, 9) END AS old_blob, CASE WHEN k > 0 THEN substr(md5(q || 'x'), 1, 9) END AS new_blob,
               CAST(CASE WHEN k IN (1, 3, 4, 5) THEN 1 ELSE 0 END AS BIGINT) AS additions, CAST(CASE WHEN k IN (1, 3, 4) THEN 1 ELSE 0 END AS BIGINT) AS deletions,
               CAST(CASE k WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS no_newline, CAST(CASE WHEN k IN (0, 2) THEN 0 ELSE 1 END AS BIGINT) AS hunks
        FROM ({_HEADERS})""",
    "patch_short_hunks": f"""
        SELECT key, file_no, CAST(CASE k WHEN 5 THEN 0 ELSE q END AS BIGINT) AS old_start, CAST(CASE k WHEN 5 THEN 0 ELSE 1 END AS BIGINT) AS old_len, CAST(CASE k WHEN 5 THEN 1 ELSE q END AS BIGINT) AS new_start,
               CAST(1 AS BIGINT) AS new_len, CAST(NULL AS VARCHAR) AS context_of, CAST(CASE k WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS no_newline, true AS reconciles
        FROM ({_HEADERS}) WHERE k NOT IN (0, 2)""",
    "fact_changes": """
        WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) - 1 AS n, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
        SELECT key, 'constant' AS fact, 'C_' || n AS name, CAST(q AS VARCHAR) AS old, '0' || q AS new FROM f WHERE q % 5 = 0
        UNION ALL SELECT key, 'env', 'V_' || n, NULL, '' FROM f WHERE q % 5 = 2
        UNION ALL SELECT DISTINCT key, 'constant', 'B_' || p, NULL, '1' FROM f WHERE q % 5 > 2 AND p % 2 = 1""",
    "patch_lines": f"""
        WITH l AS (SELECT key, unnest(CASE k WHEN 0 THEN ['added', 'added'] WHEN 1 THEN ['removed', 'removed'] ELSE ['removed', 'added', 'context'] END) AS kind,
                          unnest(CASE k WHEN 0 THEN ['one', '+++ two'] WHEN 1 THEN ['one', '-- two'] ELSE ['  "version": "1.' || q || '"', '  "version": "2.' || q || '"', 'same'] END) AS text FROM ({_FILES}))
        SELECT key, kind, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM l GROUP BY 1, 2""",
    "access_evidence": f"SELECT sha, evidence FROM ({_CLAIMS})",
    "story_notes": _NOTES,
    "day_leads": f"SELECT c.day, first(c.evidence ORDER BY c.sha) AS headline FROM ({_CLAIMS}) c WHERE c.sha IN (SELECT sha FROM ({_NOTES})) GROUP BY c.day",
    "announcements": f"""
        WITH n AS (SELECT sha, string_agg(text, chr(10) ORDER BY text) AS notes FROM ({_NOTES}) GROUP BY sha)
        SELECT sha, substr(concat_ws(chr(10), '**' || title || '**', notes, words), 1, 2000) AS announcement FROM ({_CLAIMS}) LEFT JOIN n USING (sha)""",
    "day_records": f"SELECT day, count(*) AS records, min(sha) AS first, max(sha) AS last FROM ({_CLAIMS}) WHERE NOT noise GROUP BY day",
    "record_lookup": """
        WITH k AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS title FROM orders),
        a AS (SELECT DISTINCT substr(md5(CAST(c_custkey AS VARCHAR)), 1, CAST(4 + 4 * (c_custkey % 4) AS INTEGER)) AS prefix FROM customer),
        f AS (SELECT a.prefix, count(k.sha) AS n, min(k.sha) AS one FROM a LEFT JOIN k ON starts_with(k.sha, a.prefix) GROUP BY 1)
        SELECT prefix, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, k.sha, k.day, k.title FROM f LEFT JOIN k ON f.n = 1 AND k.sha = f.one""",
    "cache_age": """
        SELECT event_id, CASE WHEN event_id % 10 = 0 THEN true ELSE epoch_us(date_trunc('day', ts)) // 1000 + 43200000 - epoch_us(date_trunc('second', ts)) // 1000 >= 21600000 END AS fetch FROM events""",
}
