"""The driver queries of the media-library operators in SQL, written independently of the engine."""

from __future__ import annotations

_PLACE = "CASE WHEN src = 'dir' THEN path ELSE entry END"
_PARENT = "regexp_extract({p}, '([^/]*)/[^/]*$', 1)"
_BUCKET = """CASE WHEN list_contains(string_split(lower({p}), '/'), 'trash') THEN 'trash'
  WHEN list_contains(string_split(lower({p}), '/'), 'archive') THEN 'archive' END"""
_ALBUM = """CASE WHEN {a} <> '' AND lower({a}) NOT IN ('takeout', 'google photos', 'trash', 'archive')
  AND NOT regexp_full_match(lower({a}), 'photos from [0-9]{{4}}') THEN {a} END"""
_HEX = "CASE WHEN regexp_matches(lower({h}), '[0-9a-f]{{64}}') THEN regexp_extract(lower({h}), '([0-9a-f]{{64}})', 1) END"
_SUFFIX = "regexp_extract({n}, '^.+(\\.[^.]+)$', 1)"
_STEM = "left({n}, length({n}) - length(regexp_extract({n}, '^.+(\\.[^.]+)$', 1)))"
_VIDEO = "('mp4', 'mov', 'avi', 'mkv', 'm4v', '3gp', 'wmv')"


def _canon(e: str) -> str:
    bare = f"ltrim(lower({e}), '.')"
    return f"CASE WHEN {bare} IN ('jpg', 'jpeg', 'jpe') THEN 'jpg' WHEN {bare} IN ('tif', 'tiff') THEN 'tif' WHEN {bare} IN ('heic', 'heif') THEN 'heic' ELSE {bare} END"


_ALBUM_ROWS = f"""
  c AS (SELECT lower(sha256) AS sha256, scan_ord, {_PLACE} AS place FROM copies WHERE sha256 IS NOT NULL),
  p AS (SELECT *, {_PARENT.format(p='place')} AS parent FROM c),
  a AS (SELECT *, {_ALBUM.format(a='parent')} AS album FROM p)"""

# one row per document with the seconds of its two times; texts that are no JSON objects have none
_TS = """CASE WHEN regexp_full_match(json_extract_string(j, '$.{k}.timestamp'), '\\s*[+-]?[0-9]+\\s*')
  THEN TRY_CAST(trim(json_extract_string(j, '$.{k}.timestamp')) AS BIGINT) END"""
_DOCS = f"""
  doc AS (SELECT sidecar_id, ref, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM sidecar_docs),
  ts AS (SELECT sidecar_id, ref, {_TS.format(k='photoTakenTime')} AS taken, {_TS.format(k='creationTime')} AS made FROM doc),
  pick AS (SELECT sidecar_id, ref, CASE WHEN taken IS NOT NULL THEN taken ELSE made END AS t FROM ts),
  sd AS (SELECT sidecar_id, ref, CAST(extract(year FROM make_timestamp(t * 1000000)) AS INTEGER) AS year, CAST(extract(month FROM make_timestamp(t * 1000000)) AS INTEGER) AS month
         FROM pick WHERE t >= 788918400 AND t < 1830297600)"""
_EXIF_TEXT = "coalesce(nullif(datetimeoriginal, ''), nullif(createdate, ''))"


def _exif(src: str) -> str:
    y, m = "substr(trim(t), 1, 4)", "substr(trim(t), 6, 2)"
    return f"""(SELECT *, CAST({y} AS INTEGER) AS year, CAST(trim({m}) AS INTEGER) AS month FROM {src}
      WHERE length(t) >= 7 AND regexp_full_match({y}, '[0-9]{{4}}') AND regexp_full_match(trim({m}), '[+]?[0-9]+')
      AND TRY_CAST({y} AS INTEGER) BETWEEN 1995 AND 2027 AND TRY_CAST(trim({m}) AS INTEGER) BETWEEN 1 AND 12)"""


_FOLDER = "CASE WHEN src = 'dir' THEN '' ELSE zip END || '::' || regexp_extract({p}, '^(.*)/[^/]*$', 1)"
_MATCH = f"""
  m AS (SELECT DISTINCT {_FOLDER.format(p=_PLACE)} AS folder, name FROM copies),
  r AS (SELECT CASE WHEN ref.kind = 'dir' THEN '' ELSE ref.zip END AS box, CASE WHEN ref.kind = 'dir' THEN ref.path ELSE ref.entry END AS loc FROM sidecar_docs),
  s AS (SELECT DISTINCT box || '::' || regexp_extract(loc, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(loc, '([^/]*)$', 1) AS json FROM r),
  e AS (SELECT i, left('.supplemental-metadata', 22 - i) AS cut FROM range(0, 23) AS t(i)),
  b AS (SELECT folder, name, name AS base, 0 AS tier FROM m
        UNION ALL SELECT folder, name, left(st, length(st) - 7) || lower(ex), 2000 FROM (SELECT *, {_STEM.format(n='name')} AS st, {_SUFFIX.format(n='name')} AS ex FROM m) WHERE st LIKE '%-edited'),
  x AS (SELECT folder, name, tier, base, regexp_extract(base, '^(.*)(\\([0-9]+\\))(\\.[^.]+)$', 1) || regexp_extract(base, '^(.*)(\\([0-9]+\\))(\\.[^.]+)$', 3) AS whole,
          regexp_extract(base, '^(.*)(\\([0-9]+\\))(\\.[^.]+)$', 2) AS n FROM b),
  cand AS (SELECT folder, name, tier + i AS tier, 0 AS len, base || cut || '.json' AS json FROM x, e
           UNION ALL SELECT folder, name, tier + 23 + 2 * i, 0, whole || n || cut || '.json' FROM x, e WHERE n <> ''
           UNION ALL SELECT folder, name, tier + 24 + 2 * i, 0, whole || cut || n || '.json' FROM x, e WHERE n <> ''),
  inn AS (SELECT folder, json, inner_name AS inn, {_STEM.format(n='inner_name')} AS st, lower({_SUFFIX.format(n='inner_name')}) AS ex FROM (
            SELECT folder, json, regexp_replace(left(json, length(json) - 5), '(\\.supplemental-metadata|\\.s(u(p(p(l(e(m(e(n(t(a(l(-(m(e(t(a(d(at?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?|\\.)$', '') AS inner_name FROM s WHERE json LIKE '%.json')),
  fuzzy AS (SELECT m.folder, m.name, 1000 AS tier, -length(inn.st) AS len, inn.json FROM m JOIN inn ON m.folder = inn.folder AND lower({_SUFFIX.format(n='m.name')}) = inn.ex
            AND length(inn.st) >= 30 AND starts_with({_STEM.format(n='m.name')}, inn.st)),
  hit AS (SELECT cand.* FROM cand JOIN s ON cand.folder = s.folder AND cand.json = s.json UNION ALL SELECT * FROM fuzzy),
  won AS (SELECT folder, name, json AS sidecar FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY tier, len, json) AS k FROM hit) WHERE k = 1)"""

_GLOBAL = f"""
  n0 AS (SELECT DISTINCT name, {_STEM.format(n='name')} AS st0, {_SUFFIX.format(n='name')} AS ext FROM copies WHERE sidecar IS NULL AND name IS NOT NULL),
  lv AS (SELECT name, 0 AS level, st0 AS st, ext FROM n0 UNION ALL SELECT name, 1, left(st0, length(st0) - 7), ext FROM n0 WHERE st0 LIKE '%-edited'
         UNION ALL SELECT name, 2, left(st0, length(st0) - 14), ext FROM n0 WHERE st0 LIKE '%-edited-edited'),
  q AS (SELECT name, level * 2 AS tier, st || ext AS inn FROM lv
        UNION ALL SELECT name, level * 2 + 1, regexp_replace(st || ext, '^(.*)(\\([0-9]+\\))(\\.[^.]+)$', '\\1\\3\\2') FROM lv WHERE regexp_matches(st || ext, '^(.*)(\\([0-9]+\\))(\\.[^.]+)$')),
  k AS (SELECT DISTINCT inner_name AS inn FROM orphans WHERE inner_name IS NOT NULL),
  kk AS (SELECT inn, {_STEM.format(n='inn')} AS kst, lower({_SUFFIX.format(n='inn')}) AS kex FROM k),
  h AS (SELECT q.name, q.inn, q.tier, 0 AS len FROM q JOIN k ON q.inn = k.inn
        UNION ALL SELECT lv.name, kk.inn, 1000 - level, -length(kst) FROM lv JOIN kk ON lower(lv.ext) = kex AND length(kst) >= 30 AND starts_with(lv.st, kst)),
  g AS (SELECT name, inn FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, len, inn) AS r FROM h) WHERE r = 1)"""

_REF = "CASE WHEN {r}.kind = 'dir' THEN {r}.path ELSE {r}.zip || '::' || {r}.entry END"
_CHOICE = f"""
  {_DOCS.strip()},
  ok AS (SELECT {_REF.format(r='ref')} AS id, bool_or(taken >= 788918400 AND taken < 1830297600) AS good FROM ts GROUP BY 1),
  refs AS (SELECT DISTINCT inner_name, {_REF.format(r='ref')} AS id FROM orphans),
  choice AS (SELECT inner_name, id FROM (SELECT inner_name, refs.id, row_number() OVER (PARTITION BY inner_name ORDER BY CASE WHEN good THEN 0 ELSE 1 END, regexp_extract(refs.id, '([^/]*)$', 1), refs.id) AS r
    FROM refs LEFT JOIN ok ON refs.id = ok.id) WHERE r = 1)"""

_HEAD = """CASE WHEN length(x) < 24 THEN NULL WHEN starts_with(x, 'FFD8FF') THEN 'jpg' WHEN starts_with(x, '89504E470D0A1A0A') THEN 'png'
  WHEN starts_with(x, '474946383761') OR starts_with(x, '474946383961') THEN 'gif' WHEN starts_with(x, '424D') THEN 'bmp' WHEN starts_with(x, '1A45DFA3') THEN 'mkv'
  WHEN starts_with(x, '3026B2758E66CF11A6D900AA0062CE6C') THEN 'wmv'
  WHEN starts_with(x, '52494646') THEN CASE substr(x, 17, 8) WHEN '57454250' THEN 'webp' WHEN '41564920' THEN 'avi' END
  WHEN substr(x, 9, 8) = '66747970' THEN CASE
    WHEN substr(x, 17, 8) IN ('68656963', '68656978', '6865696D', '68656973', '68657663', '68657678', '6D696631', '6D736631') THEN 'heic'
    WHEN substr(x, 17, 8) IN ('61766966', '61766973') THEN 'avif' WHEN substr(x, 17, 8) = '71742020' THEN 'mov'
    WHEN regexp_matches(substr(x, 17, 8), '^(4D|6D)34(56|76)') THEN 'm4v' WHEN regexp_matches(substr(x, 17, 8), '^33(47|67)') THEN '3gp'
    WHEN substr(x, 17, 8) IN ('69736F6D', '69736F32', '69736F34', '69736F35', '69736F36', '6D703431', '6D703432', '6D703420', '6D703476', '61766331', '64617368', '6D736E76', '6E647363', '66347620', '636D6666') THEN 'mp4' END
  END"""
_TYPES = f"""
  hx AS (SELECT scan_ord, name, substr(hex(head), 1, 64) AS x, {_SUFFIX.format(n='name')} AS sfx FROM copies),
  ty AS (SELECT scan_ord, name, sfx, {_HEAD} AS sniffed, {_canon('sfx')} AS ext FROM hx),
  ty2 AS (SELECT *, {_canon('sniffed')} AS want FROM ty)"""

_PRINTS = """
  v AS (SELECT vec_id AS id, embedding AS e FROM embeddings),
  f AS (SELECT id, list_transform(range(1, 64), lambda k: CASE WHEN e[k] > e[k + 1] THEN 1 ELSE 0 END) AS bits,
          list_transform(range(1, 9), lambda k: greatest(0, least(255, CAST(floor((CAST(e[k] AS DOUBLE) + 1) * 127.5) AS INTEGER)))) AS color FROM v),
  u AS (SELECT id, unnest(range(1, 64)) AS k, unnest(bits) AS bit FROM f),
  w AS (SELECT id, sum(CASE WHEN k <= 63 THEN bit * CAST(pow(2, 63 - k) AS BIGINT) ELSE 0 END)::BIGINT AS word FROM u GROUP BY id),
  fc AS (SELECT w.id, word, color FROM w JOIN f ON w.id = f.id),
  pr AS (SELECT a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.word, b.word)) AS INTEGER) AS distance FROM fc a JOIN fc b ON a.id < b.id
    AND bit_count(xor(a.word, b.word)) <= 16 AND list_sum(list_transform(range(1, 9), lambda k: abs(a.color[k] - b.color[k]))) <= 120)"""
_GROUPS = f"""
  {_PRINTS.strip()},
  ed AS (SELECT left_id AS a, right_id AS b FROM pr UNION SELECT right_id, left_id FROM pr),
  cl AS (SELECT DISTINCT a AS id, a AS other FROM ed UNION SELECT cl.id, ed.b FROM cl JOIN ed ON cl.other = ed.a),
  gr AS (SELECT id, min(other) AS group_id FROM cl GROUP BY id)"""

_REVIEWED = """rv AS (SELECT group_id, scan_ord, path, size_bytes AS size FROM (SELECT *, row_number() OVER (PARTITION BY group_id, scan_ord ORDER BY reviewed_at DESC, path DESC, size_bytes DESC) AS k FROM dup_groups) WHERE k = 1)"""
_COUNTS = f"""
  inv AS (SELECT DISTINCT lower(sha256) AS h FROM copies WHERE sha256 IS NOT NULL),
  fin AS (SELECT DISTINCT {_HEX.format(h='hash')} AS h FROM extracted WHERE outcome = 'placed' AND hash IS NOT NULL),
  fl AS (SELECT DISTINCT replace(path, '/srv/import/', '') AS p FROM copies WHERE src = 'dir'),
  med AS (SELECT p FROM fl WHERE regexp_matches(lower(p), '\\.(jpg|jpeg|png|gif|heic|heif|avif|bmp|tiff|tif|webp|cr2|nef|arw|dng|orf|rw2|mp4|mov|avi|mkv|m4v|3gp|wmv)$')),
  n AS (SELECT (SELECT count(*) FROM inv) AS i, (SELECT count(*) FROM fin) AS d, (SELECT count(*) FROM med) AS m,
          (SELECT count(*) FROM fin WHERE h NOT IN (SELECT h FROM inv)) AS s, (SELECT count(*) FROM med WHERE list_contains(string_split(p, '/'), 'unknown')) AS u),
  ck AS (SELECT 'counts' AS section, 'unique in inventory' AS metric, i AS value, 'info' AS status FROM n
    UNION ALL SELECT 'counts', 'done', d, 'info' FROM n UNION ALL SELECT 'counts', 'media files', m, 'info' FROM n
    UNION ALL SELECT 'counts', 'missing', d - m, CASE WHEN d = m THEN 'ok' ELSE 'fail' END FROM n
    UNION ALL SELECT 'counts', 'stale', s, CASE WHEN s = 0 THEN 'ok' ELSE 'info' END FROM n
    UNION ALL SELECT 'unknown', 'undated', u, CASE WHEN u = 0 THEN 'ok' ELSE 'info' END FROM n)"""

_DIR = "regexp_extract({p}, '^(.*)/[^/]*$', 1)"

SQL = {
    "exact_dedup_keep_first": "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first_doc, count(*) AS n_copies FROM documents GROUP BY 1",
    "copies_keep_first": "SELECT lower(sha256) AS sha256, min(scan_ord) AS scan_ord, arg_min(name, scan_ord) AS name, count(*) AS n_copies FROM copies WHERE sha256 IS NOT NULL GROUP BY 1",
    "winner_prefers_sidecar": """SELECT sha256, scan_ord, has_sidecar, n_copies FROM (SELECT lower(sha256) AS sha256, scan_ord, sidecar IS NOT NULL AS has_sidecar,
        count(*) OVER (PARTITION BY lower(sha256)) AS n_copies, row_number() OVER (PARTITION BY lower(sha256) ORDER BY CASE WHEN sidecar IS NULL THEN 1 ELSE 0 END, scan_ord) AS k
        FROM copies WHERE sha256 IS NOT NULL) WHERE k = 1""",
    "content_buckets": f"""WITH c AS (SELECT lower(sha256) AS sha256, {_PLACE} AS place FROM copies WHERE sha256 IS NOT NULL), b AS (SELECT sha256, {_BUCKET.format(p='place')} AS bucket FROM c)
        SELECT sha256, CASE WHEN bool_or(bucket IS NULL) THEN NULL WHEN bool_or(bucket = 'archive') THEN 'archive' ELSE 'trash' END AS bucket FROM b GROUP BY sha256""",
    "albums_rollup": f"WITH {_ALBUM_ROWS.strip()} SELECT sha256, list_sort(list(DISTINCT album)) AS albums FROM a WHERE album IS NOT NULL GROUP BY sha256",
    "albums_manifest": f"""WITH {_ALBUM_ROWS.strip()}, fst AS (SELECT sha256, arg_min(place, scan_ord) AS place FROM c GROUP BY sha256), ha AS (SELECT DISTINCT sha256, album FROM a WHERE album IS NOT NULL)
        SELECT album, fst.place FROM ha JOIN fst ON ha.sha256 = fst.sha256""",
    "sidecar_local_match": f"WITH {_MATCH.strip()} SELECT folder, name, sidecar FROM won",
    "sidecar_orphans": f"WITH {_MATCH.strip()} SELECT folder, json, inn AS \"inner\" FROM inn WHERE inn <> '' AND NOT EXISTS (SELECT 1 FROM won WHERE won.folder = inn.folder AND won.sidecar = inn.json)",
    "sidecar_global_match": f"WITH {_GLOBAL.strip()} SELECT name, inn AS \"inner\" FROM g",
    "sidecar_choice": f"WITH {_CHOICE.strip()} SELECT inner_name, id AS ref_id FROM choice",
    "content_winners": f"""WITH {_CHOICE.strip()}, {_GLOBAL.strip()},
        c0 AS (SELECT lower(sha256) AS sha256, scan_ord, name, coalesce(path, zip || '::' || entry) AS place, {_PLACE} AS inside, bucket, {_REF.format(r='sidecar')} AS own FROM copies WHERE sha256 IS NOT NULL),
        p AS (SELECT *, {_PARENT.format(p='inside')} AS parent FROM c0), c AS (SELECT *, {_ALBUM.format(a='parent')} AS album FROM p),
        x AS (SELECT c.*, choice.id AS found FROM c LEFT JOIN g ON c.name = g.name LEFT JOIN choice ON g.inn = choice.inner_name),
        y AS (SELECT *, bool_or(own IS NOT NULL) OVER (PARTITION BY sha256) AS any_own FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY CASE WHEN own IS NOT NULL THEN 0 WHEN NOT any_own AND found IS NOT NULL THEN 1 ELSE 2 END, scan_ord) AS k FROM y),
        per AS (SELECT sha256, CASE WHEN bool_or(bucket IS NULL) THEN NULL WHEN bool_or(bucket = 'archive') THEN 'archive' ELSE 'trash' END AS bucket, coalesce(list_sort(list(DISTINCT album) FILTER (WHERE album IS NOT NULL)), []) AS albums, count(*) AS n_copies FROM c GROUP BY sha256)
        SELECT z.sha256, scan_ord, name, place, CASE WHEN any_own THEN own ELSE found END AS sidecar, NOT any_own AND found IS NOT NULL AS recovered, per.bucket, albums, n_copies FROM z JOIN per ON z.sha256 = per.sha256 WHERE k = 1""",
    "sidecar_names": f"""WITH {_MATCH.strip()} SELECT DISTINCT json, inn AS "inner", inn || CASE WHEN contains(json, '.supplemental-metadata') THEN '.supplemental-metadata.json' ELSE '.json' END AS dest FROM inn""",
    "sidecar_dates": f"WITH {_DOCS.strip()} SELECT sidecar_id, year, month FROM sd",
    "exif_dates": f"WITH t0 AS (SELECT rec_id, {_EXIF_TEXT} AS t FROM exif) SELECT rec_id, year, month FROM {_exif('t0')}",
    "date_waterfall": f"""WITH {_DOCS.strip()}, t0 AS (SELECT source_file AS id, {_EXIF_TEXT} AS t FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY rec_id) AS k FROM exif) WHERE k = 1),
        ex AS {_exif('t0')}, c AS (SELECT scan_ord, coalesce(path, zip || '::' || entry) AS id, sidecar FROM copies)
        SELECT scan_ord, CASE WHEN sd.year IS NOT NULL THEN 'sidecar' WHEN ex.year IS NOT NULL THEN 'embedded' WHEN sidecar IS NOT NULL THEN 'unknown' ELSE 'error' END AS outcome,
          coalesce(sd.year, ex.year) AS year, CASE WHEN sd.year IS NOT NULL THEN sd.month ELSE ex.month END AS month
        FROM c LEFT JOIN sd ON c.sidecar = sd.ref LEFT JOIN ex ON c.id = ex.id""",
    "media_types": f"""WITH {_TYPES.strip()} SELECT scan_ord, sniffed, CASE WHEN ext IN {_VIDEO} THEN 'videos' ELSE 'photos' END AS kind, ext,
        CASE WHEN sniffed IS NULL OR ext = want THEN name ELSE left(name, length(name) - length(sfx)) || '.' || sniffed END AS corrected FROM ty2""",
    "extension_mismatches": f"WITH {_TYPES.strip()} SELECT ext, want, count(*) AS n FROM ty2 WHERE sniffed IS NOT NULL AND ext <> want GROUP BY ext, want",
    "motion_clips": f"""WITH c AS (SELECT scan_ord, name, sidecar IS NOT NULL AS has, coalesce(path, zip || '::' || entry) AS id, {_STEM.format(n='name')} AS st, {_canon(_SUFFIX.format(n='name'))} AS ext FROM copies),
        d AS (SELECT source_file AS id, max(duration) AS duration FROM exif GROUP BY 1)
        SELECT scan_ord, name, CASE WHEN NOT has THEN 'archive' END AS disposition FROM c JOIN d ON c.id = d.id
        WHERE ext IN {_VIDEO} AND duration <= 4.0 AND st IN (SELECT st FROM c WHERE ext NOT IN {_VIDEO})""",
    "resume_pending": f"SELECT DISTINCT lower(sha256) AS sha256 FROM copies WHERE sha256 IS NOT NULL AND lower(sha256) NOT IN (SELECT {_HEX.format(h='hash')} FROM extracted WHERE hash IS NOT NULL AND {_HEX.format(h='hash')} IS NOT NULL)",
    "outcome_counters": f"SELECT outcome, count(*) AS n, count(DISTINCT {_HEX.format(h='hash')}) AS n_contents FROM extracted GROUP BY outcome",
    "set_operations": f"""WITH x AS (SELECT {_HEX.format(h='hash')} AS h, outcome FROM extracted WHERE hash IS NOT NULL), d AS (SELECT DISTINCT h FROM x WHERE outcome = 'placed' AND h IS NOT NULL),
        v AS (SELECT DISTINCT h FROM x WHERE outcome IN ('archived', 'trashed', 'motion') AND h IS NOT NULL), i AS (SELECT DISTINCT lower(sha256) AS h FROM copies WHERE sha256 IS NOT NULL)
        SELECT 'either' AS what, count(*) AS n FROM (SELECT h FROM d UNION SELECT h FROM v) UNION ALL SELECT 'both', count(*) FROM d WHERE h IN (SELECT h FROM v) UNION ALL SELECT 'stale', count(*) FROM d WHERE h NOT IN (SELECT h FROM i)""",
    "neardup_pairs": f"WITH {_PRINTS.strip()} SELECT left_id, right_id, distance FROM pr",
    "neardup_groups": f"WITH RECURSIVE {_GROUPS.strip()} SELECT id, group_id FROM gr",
    "neardup_histogram": f"WITH RECURSIVE {_GROUPS.strip()}, sz AS (SELECT group_id, count(*) AS size FROM gr GROUP BY 1) SELECT size, count(*) AS n_groups, CAST(sum(size - 1) AS BIGINT) AS extras FROM sz GROUP BY size",
    "pair_components": """WITH RECURSIVE e AS (SELECT left_ord AS a, right_ord AS b FROM near_pairs WHERE left_ord <> right_ord UNION SELECT right_ord, left_ord FROM near_pairs WHERE left_ord <> right_ord),
        r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a) SELECT node, min(other) AS component FROM r GROUP BY node""",
    "keep_suggestions": f"WITH {_REVIEWED} SELECT group_id, scan_ord, CAST(k - 1 AS INTEGER) AS rank_no, k = 1 AS suggest_keep FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC NULLS LAST, path NULLS FIRST) AS k FROM rv)",
    "groups_still_there": f"""WITH {_REVIEWED}, l AS (SELECT * FROM rv WHERE path IN (SELECT coalesce(path, zip || '::' || entry) FROM copies))
        SELECT group_id, scan_ord FROM l WHERE group_id IN (SELECT group_id FROM l GROUP BY group_id HAVING count(*) > 1)""",
    "removal_moves": f"""WITH {_REVIEWED} SELECT group_id || '-' || scan_ord AS id, path, '/srv/removed/' || regexp_extract(path, '([^/]*)$', 1) AS target FROM rv
        WHERE EXISTS (SELECT 1 FROM dup_groups d WHERE d.group_id = rv.group_id AND d.scan_ord = rv.scan_ord AND NOT d.suggest_keep)""",
    "verify_counts": f"WITH {_COUNTS.strip()} SELECT section, metric, CAST(value AS BIGINT) AS value, status FROM ck",
    "verify_verdict": f"WITH {_COUNTS.strip()} SELECT count(*) FILTER (WHERE status = 'fail') = 0 AND count(*) > 0 AS safe, count(*) FILTER (WHERE status = 'fail') AS n_failed FROM ck",
    "tag_plan": f"""WITH {_DOCS.strip()}, nm AS (SELECT sidecar_id AS id, regexp_extract(CASE WHEN ref.kind = 'dir' THEN ref.path ELSE ref.entry END, '([^/]*)$', 1) AS json FROM sidecar_docs),
        vid AS (SELECT id, regexp_matches(lower(regexp_replace(left(json, length(json) - 5), '(\\.supplemental-metadata|\\.s(u(p(p(l(e(m(e(n(t(a(l(-(m(e(t(a(d(at?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?|\\.)$', '')), '\\.(mp4|mov|avi|mkv|m4v|3gp|wmv)$') AS v FROM nm),
        g AS (SELECT ts.sidecar_id AS id, v, CASE WHEN taken BETWEEN 788918400 AND 1767398400 THEN CAST(taken AS VARCHAR) END AS t, nullif(json_extract_string(j, '$.description'), '') AS c,
            json_extract_string(j, '$.favorited') AS fav, j FROM ts JOIN doc ON ts.sidecar_id = doc.sidecar_id JOIN vid ON ts.sidecar_id = vid.id)
        SELECT id, tag, value FROM (
          SELECT id, unnest(['DateTimeOriginal', 'CreateDate']) AS tag, t AS value FROM g WHERE NOT v
          UNION ALL SELECT id, unnest(['IPTC:Caption-Abstract', 'XMP-dc:Description', 'EXIF:ImageDescription']), c FROM g WHERE NOT v
          UNION ALL SELECT id, 'XMP:Rating', CASE WHEN fav <> 'false' THEN '5' END FROM g WHERE NOT v
          UNION ALL SELECT id, 'XMP-iptcExt:PersonInImage', unnest(json_extract_string(j, '$.people[*].name')) FROM g WHERE NOT v
          UNION ALL SELECT id, unnest(['QuickTime:CreateDate', 'QuickTime:ModifyDate', 'TrackCreateDate', 'TrackModifyDate', 'MediaCreateDate', 'MediaModifyDate']), t FROM g WHERE v
          UNION ALL SELECT id, 'QuickTime:Description', c FROM g WHERE v) WHERE value IS NOT NULL""",
    "gps_tags": f"""WITH {_DOCS.strip()}, nm AS (SELECT sidecar_id AS id, regexp_extract(CASE WHEN ref.kind = 'dir' THEN ref.path ELSE ref.entry END, '([^/]*)$', 1) AS json FROM sidecar_docs),
        vid AS (SELECT id, regexp_matches(lower(regexp_replace(left(json, length(json) - 5), '(\\.supplemental-metadata|\\.s(u(p(p(l(e(m(e(n(t(a(l(-(m(e(t(a(d(at?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?|\\.)$', '')), '\\.(mp4|mov|avi|mkv|m4v|3gp|wmv)$') AS v FROM nm),
        g AS (SELECT doc.sidecar_id AS id, TRY_CAST(json_extract_string(j, '$.geoData.latitude') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(j, '$.geoData.longitude') AS DOUBLE) AS lon,
            TRY_CAST(json_extract_string(j, '$.geoData.altitude') AS DOUBLE) AS alt FROM doc JOIN vid ON doc.sidecar_id = vid.id WHERE NOT v)
        SELECT id, tag, value FROM (
          SELECT id, unnest(['GPSLatitude', 'GPSLatitudeRef']) AS tag, lat AS value FROM g
          UNION ALL SELECT id, unnest(['GPSLongitude', 'GPSLongitudeRef']), lon FROM g
          UNION ALL SELECT id, 'GPSAltitude', alt FROM g) WHERE value <> 0""",
    "path_functions": f"""WITH c AS (SELECT *, {_PLACE} AS place FROM copies), p AS (SELECT *, {_PARENT.format(p='place')} AS parent, replace(zip, '/srv/import/', '') AS zrel FROM c), a AS (SELECT *, {_ALBUM.format(a='parent')} AS album FROM p),
        f AS (SELECT *, regexp_replace(trim(regexp_replace(album, '[<>:"/\\\\|?*]', '_', 'g')), '[. ]+$', '') AS clean FROM a)
        SELECT scan_ord, CASE WHEN clean = '' THEN '_album' ELSE clean END AS album_folder,
          array_to_string(list_filter(CASE WHEN src = 'dir' THEN string_split(replace(path, '/srv/import/', ''), '/') ELSE list_concat([CASE WHEN contains(zrel, '/') THEN string_split(zrel, '/')[1] ELSE regexp_replace(zrel, '\\.[^.]+$', '') END], string_split(entry, '/')) END,
            lambda s: s NOT IN ('Takeout', 'Google Photos')), '/') AS error_path FROM f""",
    "human_sizes": """SELECT DISTINCT size_bytes, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0)
        WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576.0) ELSE printf('%.1f GB', size_bytes / 1073741824.0) END AS shown FROM dup_groups""",
    "warning_tally": """WITH l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Error: ' ELSE 'Warning: ' END || coalesce(text, '') AS line FROM documents),
        c AS (SELECT CASE WHEN contains(line, '[minor]') THEN NULL WHEN contains(lower(line), 'gps') THEN 'GPS unreadable' WHEN contains(lower(line), 'maker notes') THEN 'maker notes unparsed'
          WHEN contains(lower(line), 'not yet supported') THEN 'unsupported file type (left as-is)' WHEN contains(lower(line), 'ifd') OR contains(lower(line), 'stripoffsets') THEN 'corrupt EXIF structure'
          WHEN starts_with(line, 'Error') THEN 'other errors' ELSE 'other warnings' END AS category FROM l)
        SELECT category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY category""",
}

_MEDIA_EXT = "('jpg', 'jpeg', 'png', 'gif', 'heic', 'heif', 'avif', 'bmp', 'tiff', 'tif', 'webp', 'cr2', 'nef', 'arw', 'dng', 'orf', 'rw2', 'mp4', 'mov', 'avi', 'mkv', 'm4v', '3gp', 'wmv')"

# made of the others
SQL |= {
    "dedup_summary": f"""SELECT CAST(coalesce(sum(n_copies), 0) AS BIGINT) AS files, count(*) AS "unique", CAST(coalesce(sum(n_copies - 1), 0) AS BIGINT) AS redundant, count(sidecar) AS with_sidecar,
        count(*) FILTER (WHERE recovered) AS recovered, count(*) FILTER (WHERE sidecar IS NULL) AS without_sidecar FROM ({SQL['content_winners']})""",
    "placement_paths": f"""WITH b AS (SELECT scan_ord, {_BUCKET.format(p='place')} AS bucket FROM (SELECT scan_ord, {_PLACE} AS place FROM copies)), w AS ({SQL['date_waterfall']}),
        m AS (SELECT scan_ord, {_canon(_SUFFIX.format(n='corrected'))} AS ext FROM ({SQL['media_types']}))
        SELECT scan_ord, CASE bucket WHEN 'archive' THEN 'Archive' WHEN 'trash' THEN 'Trash' ELSE 'final' END || '/' || CASE WHEN ext IN {_VIDEO} THEN 'videos' ELSE 'photos' END || '/' ||
          CASE WHEN year IS NULL THEN 'unknown' ELSE year || '/' || lpad(CAST(month AS VARCHAR), 2, '0') END AS folder FROM b JOIN w USING (scan_ord) JOIN m USING (scan_ord)""",
    "refolder_by_year": f"SELECT year, count(*) AS n FROM ({SQL['date_waterfall']}) WHERE outcome = 'embedded' GROUP BY year",
    "sample_50": f"""WITH f AS (SELECT DISTINCT regexp_replace(path, '^/srv/import/', '') AS rel_path FROM copies WHERE src = 'dir'),
        e AS (SELECT rel_path FROM f WHERE lower(regexp_extract({_SUFFIX.format(n="regexp_extract(rel_path, '([^/]*)$', 1)")}, '^\\.(.*)$', 1)) IN {_MEDIA_EXT} AND NOT list_contains(string_split(rel_path, '/'), 'unknown')),
        d AS (SELECT DISTINCT regexp_replace(source_file, '^/srv/import/', '') AS rel_path FROM exif WHERE coalesce(nullif(datetimeoriginal, ''), nullif(createdate, '')) IS NOT NULL)
        SELECT rel_path, rel_path IN (SELECT rel_path FROM d WHERE rel_path IS NOT NULL) AS dated FROM (SELECT rel_path FROM e ORDER BY md5(rel_path || '#0'), rel_path LIMIT 50)""",
}
