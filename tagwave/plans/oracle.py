"""DuckDB texts equivalent to each registered query, written independently of the Spark plans.

They run on the same parquet tables (``events`` is a pre-registered view) and define each
result the plain way: per-hashtag ``row_number`` for the newest entries, ``lag`` + running
``sum`` for runs, unpartitioned windows for global ranks.
"""

from __future__ import annotations

from ..sources.fixtures import EDITS_SQL

PRELUDE = (
    "WITH raw AS (" + EDITS_SQL + r"""),
ways AS (
  SELECT edit_id, ts, payload,
         coalesce(payload->'metadata'->>'comment', '(no comment)') AS comment,
         json_exists(payload, '$.tags.building') AS is_b,
         json_exists(payload, '$.tags.highway') AS is_h
  FROM raw WHERE (payload->>'type') = 'way'),
tok AS (
  SELECT DISTINCT edit_id, substr(p, 2) AS t
  FROM (SELECT edit_id, unnest(string_split_regex(comment, '\s+')) AS p FROM ways)
  WHERE starts_with(p, '#') AND length(p) > 1),
tags AS (
  SELECT edit_id, hashtag FROM (
    SELECT edit_id, regexp_replace(regexp_replace(t, '^#', ''), ',$', '') AS hashtag FROM tok)
  WHERE hashtag <> ''),
mapped AS (
  SELECT w.*, CASE WHEN is_b THEN 'POLYGON' ELSE 'LINESTRING' END AS geom_type,
         list_transform(
           list_filter(CAST(payload->'nodes' AS JSON[]), lambda n: (n->>'lon') IS NOT NULL AND (n->>'lat') IS NOT NULL),
           lambda n: {'lon': CAST(n->>'lon' AS DOUBLE), 'lat': CAST(n->>'lat' AS DOUBLE)}) AS pts
  FROM ways w WHERE is_b OR is_h),
feat AS (
  SELECT edit_id, ts, payload->>'user' AS "user", payload->>'id' AS id,
         payload->'metadata'->>'id' AS changeset, payload->'metadata'->>'created_at' AS date,
         payload->>'action' AS action, comment, geom_type, pts,
         CASE WHEN geom_type = 'POLYGON'
              THEN 'POLYGON ((' || array_to_string(list_transform(
                     CASE WHEN pts[1] = pts[-1] THEN pts ELSE list_append(pts, pts[1]) END,
                     lambda p: printf('%.16f %.16f', p.lon, p.lat)), ', ') || '))'
              ELSE 'LINESTRING (' || array_to_string(list_transform(pts,
                     lambda p: printf('%.16f %.16f', p.lon, p.lat)), ', ') || ')' END AS feature
  FROM mapped
  WHERE CASE WHEN geom_type = 'POLYGON' THEN len(pts) >= 3 AND NOT (len(pts) = 3 AND pts[1] = pts[-1])
             ELSE len(pts) >= 2 END
    AND (payload->>'user') IS NOT NULL AND (payload->>'id') IS NOT NULL AND (payload->>'action') IS NOT NULL
    AND (payload->'metadata'->>'id') IS NOT NULL AND (payload->'metadata'->>'created_at') IS NOT NULL),
ht AS (SELECT f.edit_id, f.ts, f.date, f.feature, t.hashtag FROM feat f JOIN tags t USING (edit_id)),
a AS (SELECT CAST((floor(max(epoch(ts)) / 30) + 1) * 30 AS BIGINT) AS t FROM ht),
sc AS (SELECT hashtag, count(*) AS score FROM ht, a
       WHERE epoch(ts) >= a.t - 21600 AND epoch(ts) < a.t GROUP BY hashtag),
tr AS (SELECT * FROM sc WHERE score > 1),
lg AS (SELECT ht.*, tr.score,
              row_number() OVER (PARTITION BY ht.hashtag ORDER BY ts DESC, edit_id DESC) AS entry_rank
       FROM ht JOIN tr USING (hashtag), a WHERE epoch(ts) < a.t),
ent AS (SELECT *, CASE WHEN feature LIKE 'P%' THEN 'building' ELSE 'way' END AS cls
        FROM lg WHERE entry_rank <= score + 1),
opn AS (SELECT *, CASE WHEN lag(date) OVER w IS NULL OR lag(date) OVER w <> date OR lag(cls) OVER w <> cls
                       THEN 1 ELSE 0 END AS opens
        FROM ent WINDOW w AS (PARTITION BY hashtag ORDER BY entry_rank)),
rn AS (SELECT *, sum(opens) OVER (PARTITION BY hashtag ORDER BY entry_rank ROWS UNBOUNDED PRECEDING) AS run
       FROM opn),
runs AS (SELECT hashtag, CAST(run AS BIGINT) AS run, min(cls) AS feature, min(date) AS time,
                arg_min(feature, entry_rank) AS last,
                arg_min(feature, entry_rank) FILTER (WHERE opens = 0) AS second,
                count(*) AS count
         FROM rn GROUP BY hashtag, run),
tl AS (SELECT row_number() OVER (ORDER BY TRY_CAST(time AS TIMESTAMP) DESC NULLS LAST, hashtag, feature, run)
              AS position, count(*) OVER () AS n_runs, hashtag, run, feature, time, last, count FROM runs),
steps AS (SELECT n_runs - position + 1 AS step, * FROM tl),
board AS (SELECT hashtag, CAST(sum(count) AS BIGINT) AS total FROM tl GROUP BY hashtag)
""")

BODIES = {
    "trending_6h": "SELECT hashtag, score FROM sc",
    "features": """SELECT edit_id, "user", id, changeset, date, feature, action, comment,
        coalesce((SELECT string_agg(hashtag, ' ' ORDER BY hashtag) FROM tags t WHERE t.edit_id = f.edit_id), '')
          AS hashtags,
        (SELECT count(*) FROM tags t WHERE t.edit_id = f.edit_id) AS n_hashtags
        FROM feat f""",
    "hashtags_per_edit": """SELECT edit_id, comment,
        coalesce((SELECT string_agg(hashtag, ' ' ORDER BY hashtag) FROM tags t WHERE t.edit_id = w.edit_id), '')
          AS hashtags,
        (SELECT count(*) FROM tags t WHERE t.edit_id = w.edit_id) AS n_hashtags
        FROM ways w""",
    "hashtag_features": "SELECT edit_id, date, feature, hashtag FROM ht",
    "features_wkt": "SELECT edit_id, geom_type, CAST(len(pts) AS INTEGER) AS n_points, feature AS wkt FROM feat",
    "feature_centers": """SELECT edit_id,
        (list_min(list_transform(pts, lambda p: p.lon)) + list_max(list_transform(pts, lambda p: p.lon))) / 2
          AS center_lon,
        (list_min(list_transform(pts, lambda p: p.lat)) + list_max(list_transform(pts, lambda p: p.lat))) / 2
          AS center_lat
        FROM feat""",
    "feature_class_counts": """SELECT CASE WHEN feature LIKE 'P%' THEN 'building' ELSE 'way' END AS feature,
        count(*) AS n, count(DISTINCT edit_id) AS n_features FROM ht GROUP BY 1""",
    "rejected_features": """SELECT edit_id, 'too few points' AS reason FROM mapped
        WHERE NOT (CASE WHEN geom_type = 'POLYGON' THEN len(pts) >= 3 AND NOT (len(pts) = 3 AND pts[1] = pts[-1])
                        ELSE len(pts) >= 2 END)""",
    "parsed_times": """SELECT edit_id,
        CASE edit_id % 5 WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%SZ')
             WHEN 2 THEN strftime(t, '%Y-%m-%d %H:%M:%S+05:00') WHEN 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S-03:30')
             ELSE strftime(t, '%a, %d %b %Y %H:%M:%S +0200') END AS text,
        strftime(t - CASE edit_id % 5 WHEN 2 THEN INTERVAL 5 HOUR WHEN 3 THEN INTERVAL (-210) MINUTE
                                      WHEN 4 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc
        FROM (SELECT edit_id, CAST(payload->'metadata'->>'created_at' AS TIMESTAMP) AS t FROM raw)""",
    "clean_hashtag": """SELECT t AS raw, regexp_replace(regexp_replace(t, '^#', ''), ',$', '') AS hashtag,
        count(*) AS n
        FROM (SELECT substr(p, 2) AS t
              FROM (SELECT unnest(string_split_regex(comment, '\\s+')) AS p FROM ways)
              WHERE starts_with(p, '#') AND length(p) > 1)
        GROUP BY t""",
    "latest_for_hashtag": """SELECT hashtag, edit_id, feature || '|' || date AS entry FROM ht
        WHERE hashtag = url_decode('pipe%7Ctail') ORDER BY ts DESC, edit_id DESC LIMIT 101""",
    "recent_features": """SELECT edit_id, "user", date, feature,
        CAST(json_object('user', "user", 'id', id, 'changeset', changeset, 'date', date, 'feature', feature,
             'action', action, 'comment', comment, 'hashtags',
             coalesce((SELECT list(hashtag ORDER BY hashtag) FROM tags t WHERE t.edit_id = f.edit_id), [])
             ) AS VARCHAR) AS record
        FROM feat f ORDER BY ts DESC, edit_id DESC LIMIT 1001""",
    "preview": """SELECT edit_id, "user", date, feature FROM feat ORDER BY edit_id LIMIT 10""",
    "change_feed": "SELECT CAST(0 AS BIGINT) AS emit_id, position, hashtag, count FROM tl",
    "packed_entries": "SELECT edit_id, hashtag, feature || '|' || date || '|' || hashtag AS entry FROM ht",
    "unpacked_entries": """SELECT edit_id, split_part(e, '|', 1) AS feature, split_part(e, '|', 2) AS time,
        split_part(e, '|', 3) AS hashtag
        FROM (SELECT edit_id, feature || '|' || date || '|' || hashtag AS e FROM ht)""",
    "trending_repeated": "SELECT hashtag, score FROM tr",
    "score_keys": """SELECT 'hashtags:score:6:' || hashtag AS key, hashtag, score FROM sc""",
    "rolling_scores": """SELECT hashtag, bucket_end,
        CAST(sum(n) OVER (PARTITION BY hashtag ORDER BY bucket_end RANGE BETWEEN 21570 PRECEDING AND CURRENT ROW)
             AS BIGINT) AS score
        FROM (SELECT hashtag, CAST((floor(epoch(ts) / 30) + 1) * 30 AS BIGINT) AS bucket_end, count(*) AS n
              FROM ht GROUP BY 1, 2)""",
    "scores_with_zeros": """SELECT k.hashtag, CAST(coalesce(sc.score, 0) AS BIGINT) AS score
        FROM (SELECT DISTINCT hashtag FROM ht, a WHERE epoch(ts) < a.t) k LEFT JOIN sc USING (hashtag)""",
    "stream_scores_by_window": """SELECT w.label AS window_label, hashtag,
        CAST(count(*) FILTER (epoch(ts) >= a.t - w.seconds) AS BIGINT) AS score
        FROM ht, a, (VALUES ('6', 21600), ('1', 3600), ('24', 86400)) w(label, seconds)
        WHERE epoch(ts) < a.t GROUP BY w.label, hashtag""",
    "trending_edits": """SELECT hashtag, tr.score, edit_id, date, feature
        FROM ht JOIN tr USING (hashtag), a WHERE epoch(ts) < a.t""",
    "timeline_entries": "SELECT hashtag, score, edit_id, date, feature, entry_rank FROM ent",
    "timeline_runs": "SELECT hashtag, run, feature, time, last, count FROM runs",
    "timeline_runs_drop": """SELECT hashtag, run, feature, time, last, count FROM (
        SELECT hashtag, run, feature, time,
               CASE WHEN occ THEN second ELSE last END AS last,
               CASE WHEN occ THEN count - 1 ELSE count END AS count
        FROM (SELECT *, k > 1 AND (k - 1 - j) % 2 = 0 AS occ FROM (
              SELECT *, coalesce(max(CASE WHEN count >= 2 THEN k END)
                          OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS j
              FROM (SELECT *, row_number() OVER (ORDER BY hashtag, run) AS k FROM runs))))
        WHERE count > 0""",
    "collapse_stats": "SELECT (SELECT count(*) FROM ent) AS entries, (SELECT count(*) FROM runs) AS runs",
    "timeline": "SELECT position, hashtag, run, feature, time, last, count FROM tl",
    "timeline_json": """SELECT position, CAST(json_object('feature', feature, 'hashtag', hashtag, 'time', time,
        'last', last, 'count', count) AS VARCHAR) AS record FROM tl""",
    "timeline_replay": "SELECT step, hashtag, run, feature, time, last, count FROM steps",
    "timeline_progress": "SELECT step, hashtag, CAST(100.0 AS DOUBLE) * step / n_runs AS progress FROM steps",
    "running_totals": """SELECT step, hashtag, count,
        CAST(sum(count) OVER (PARTITION BY hashtag ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT)
          AS running_total FROM steps""",
    "leaderboard_totals": "SELECT hashtag, total FROM board",
    "leaderboard_ranked": """SELECT hashtag, total, rank, rank <= 10 AS leader FROM (
        SELECT *, row_number() OVER (ORDER BY total DESC, hashtag) AS rank FROM board)""",
    "top_leaders": """SELECT row_number() OVER (ORDER BY total DESC, hashtag) AS rank, hashtag, total
        FROM board ORDER BY total DESC, hashtag LIMIT 9""",
    "activity_log": """SELECT step, strftime(TRY_CAST(time AS TIMESTAMP), '%-H:%M') AS clock,
        strftime(TRY_CAST(time AS TIMESTAMP), '%-H:%M') || ' - ' || count || ' ' || feature || '(s) -' || hashtag
          AS line, hashtag, count, feature
        FROM steps ORDER BY step DESC LIMIT 100""",
}

BODIES["leader_changes"] = """SELECT sn.snapshot, hashtag, change, CAST(rank AS BIGINT) AS rank,
        CAST(total AS BIGINT) AS total FROM (
      SELECT coalesce(c.b, p.b + 1) AS b, coalesce(c.hashtag, p.hashtag) AS hashtag,
             CASE WHEN p.hashtag IS NULL THEN 'entered' ELSE 'left' END AS change,
             coalesce(c.rank, p.rank) AS rank, coalesce(c.total, p.total) AS total
      FROM ld c FULL OUTER JOIN ld p ON c.hashtag = p.hashtag AND c.b = p.b + 1
      WHERE c.hashtag IS NULL OR p.hashtag IS NULL) ch JOIN sn USING (b)"""
LEADER_PRELUDE = """,
st AS (SELECT hashtag, count,
              coalesce(CAST(floor(epoch(TRY_CAST(time AS TIMESTAMP)) / 3600) * 3600 AS BIGINT), -1) AS snapshot
       FROM steps),
upd AS (SELECT hashtag, snapshot, sum(count) AS n FROM st GROUP BY hashtag, snapshot),
sn AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS b FROM (SELECT DISTINCT snapshot FROM upd)),
ub AS (SELECT hashtag, b, n FROM upd JOIN sn USING (snapshot)),
grid AS (SELECT t.hashtag, s.b FROM (SELECT hashtag, min(b) AS b0 FROM ub GROUP BY hashtag) t JOIN sn s ON s.b >= t.b0),
tot AS (SELECT g.hashtag, g.b,
               sum(coalesce(ub.n, 0)) OVER (PARTITION BY g.hashtag ORDER BY g.b ROWS UNBOUNDED PRECEDING) AS total
        FROM grid g LEFT JOIN ub USING (hashtag, b)),
ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY total DESC, hashtag) AS rank FROM tot)
       WHERE rank <= 10)
"""

# Same definitions as the batch queries they must equal.
for _stream, _batch in {"stream_trending": "rolling_scores", "stream_trending_stateful": "rolling_scores",
                        "stream_hashtag_log": "hashtag_features", "stream_recent_features": "recent_features",
                        "stream_latest_for_hashtag": "latest_for_hashtag",
                        "stream_scores": "trending_6h", "stream_scores_with_zeros": "scores_with_zeros",
                        "stream_rejected_features": "rejected_features", "stream_collapse_stats": "collapse_stats",
                        "timeline_refresh": "timeline", "timeline_entries_indexed": "timeline_entries"}.items():
    BODIES[_stream] = BODIES[_batch]


def oracle_sql() -> dict[str, str]:
    return {name: PRELUDE + (LEADER_PRELUDE if name == "leader_changes" else "") + body
            for name, body in BODIES.items()}
