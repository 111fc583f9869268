"""The folds of segments as recursions in SQL, a second reading of the rules that the queries are compared with.

Each function takes the name of a CTE of segments (recording, k, seq, speaker, s, e, text), k counting from 1 in the order
of the fold, and gives CTEs that end in one of the same columns, by the name ``p``: so one fold's rows feed the next.
"""

from __future__ import annotations

from voxframe.functions import fixed_values as V
from voxframe.plans.inputs import SEGMENTS, norm_sql, tokens_sql

_W = r"[\p{L}\p{N}_]"
_words = lambda x: tokens_sql(rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))")
_keys = lambda x: rf"list_transform({x}, lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g'))"
_forms = lambda x: tokens_sql(norm_sql(x))
_within = lambda a, b: f"({a} <> '' AND {b} <> '' AND contains({b}, {a}))"
_edge = lambda a, b, most: f"coalesce(list_max(list_filter(range(1, {most} + 1), lambda j: j <= len({a}) AND j <= len({b}) AND {a}[len({a}) - j + 1 : len({a})] = {b}[1 : j])), 0)"

#: What the segment queries call heard: whole turns that repeat and overlap one another.
HEARD = f"""{SEGMENTS},
said AS (SELECT recording, seq, speaker, start AS s, "end" AS e, {_words('text')} AS ws FROM segments),
heard AS (SELECT recording, seq, speaker, s, e, array_to_string(ws, ' ') AS text FROM said WHERE len(ws) > 0
  UNION ALL SELECT recording, seq + 100, speaker, s + CAST(0.4 AS DOUBLE), e, array_to_string(ws, ' ') FROM said WHERE len(ws) > 0 AND seq % 3 = 0
  UNION ALL SELECT recording, seq + 200, speaker, s + CAST(0.2 AS DOUBLE), e, array_to_string(ws[2:5], ' ') FROM said WHERE len(ws) > 1 AND seq % 3 = 1
  UNION ALL SELECT recording, seq + 300, speaker, e - CAST(0.1 AS DOUBLE), e + CAST(0.8 AS DOUBLE), lower(ws[len(ws)] || ' and then') FROM said WHERE len(ws) > 0 AND seq % 2 = 1)"""


def ordered(source: str, p: str) -> str:
    return f"""
{p} AS (SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY s, e, seq) AS k, seq, speaker, s, e, text FROM {source})"""


def deduplicated(source: str, p: str) -> str:
    """The list of what is kept is the state; a row meets the last one of it that it overlaps and shares its words with."""
    one = "{'seq': seq, 'speaker': speaker, 's': s, 'e': e, 'text': text, 'form': form}"
    kind = "STRUCT(seq INTEGER, speaker VARCHAR, s DOUBLE, e DOUBLE, text VARCHAR, form VARCHAR)[]"
    meets = f"s - kept[i].s <= {V.DEDUP_SECONDS} AND e > kept[i].s AND s < kept[i].e AND (contains(kept[i].form, form) OR contains(form, kept[i].form))"
    new = "{'seq': kept[place].seq, 'speaker': kept[place].speaker, 's': least(kept[place].s, s), 'e': greatest(kept[place].e, e), 'text': text, 'form': form}"
    return f"""
{p}_n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY k) AS n FROM (SELECT *, {norm_sql('text')} AS form FROM {source}) WHERE form <> ''),
{p}_f(recording, n, kept) AS (
  SELECT DISTINCT recording, CAST(0 AS BIGINT), CAST([] AS {kind}) FROM {p}_n
  UNION ALL
  SELECT recording, n, CASE WHEN place IS NULL THEN list_append(kept, {one}) WHEN contains(kept[place].form, form) THEN kept
    ELSE list_concat(list_append(kept[1 : place - 1], {new}), kept[place + 1 :]) END FROM (
    SELECT *, list_max(list_filter(range(1, len(kept) + 1), lambda i: {meets})) AS place FROM (
      SELECT o.*, f.kept FROM {p}_f f JOIN {p}_n o ON o.recording = f.recording AND o.n = f.n + 1))),
{p} AS (SELECT recording, k, r.seq AS seq, r.speaker AS speaker, r.s AS s, r.e AS e, r.text AS text FROM (
  SELECT recording, unnest(range(1, len(kept) + 1)) AS k, unnest(kept) AS r FROM (SELECT recording, arg_max(kept, n) AS kept FROM {p}_f GROUP BY recording)))"""


def _folded_into_last(source: str, p: str, told: str, step: str) -> str:
    """A fold whose state is the last segment (la, le, lt: its start, end and text). told: columns made of it and the row;
    step: fresh, a, b, t (whether a segment begins, and the last segment's start, end and text from here on)."""
    return f"""
{p}_f(recording, k, fresh, seq, speaker, la, le, lt) AS (
  SELECT recording, k, true, seq, speaker, s, e, text FROM {source} WHERE k = 1
  UNION ALL
  SELECT recording, k, fresh, CASE WHEN fresh THEN seq ELSE lseq END, CASE WHEN fresh THEN speaker ELSE lspeaker END, a, b, t FROM (
    SELECT *, {step} FROM (
      SELECT *, {told} FROM (
        SELECT o.*, f.seq AS lseq, f.speaker AS lspeaker, f.la, f.le, f.lt, {norm_sql('f.lt')} AS lform, {norm_sql('o.text')} AS form,
          {_forms('f.lt')} AS lfs, {_forms('o.text')} AS fs, {_words('f.lt')} AS lws, {_words('o.text')} AS ws
        FROM {p}_f f JOIN {source} o ON o.recording = f.recording AND o.k = f.k + 1)))),
{p} AS (SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY k) AS k, seq, speaker, la AS s, le AS e, lt AS text
  FROM (SELECT *, lead(fresh) OVER (PARTITION BY recording ORDER BY k) AS nxt FROM {p}_f) WHERE coalesce(nxt, true))"""


_SHARED = f"{_edge('lfs', 'fs', V.OVERLAP_TOKENS)} AS shared, {_within('form', 'lform')} AS inside, {_within('lform', 'form')} AS holds"
_GROWN = "CASE WHEN len(ws) > shared THEN trim(lt || ' ' || array_to_string(ws[shared + 1 :], ' ')) ELSE lt END"


def overlaps_merged(source: str, p: str) -> str:
    apart, lone = "s > le", "s <= le AND shared = 0 AND NOT inside AND NOT holds"
    moved = "round(le + CAST(0.001 AS DOUBLE), 3)"
    step = f"""s > le OR ({lone}) AS fresh,
      CASE WHEN {apart} THEN s WHEN {lone} THEN {moved} WHEN shared = 0 AND NOT inside THEN least(la, s) ELSE la END AS a,
      CASE WHEN {apart} THEN e WHEN {lone} THEN CASE WHEN {moved} < e THEN e ELSE round({moved} + CAST(0.001 AS DOUBLE), 3) END ELSE greatest(le, e) END AS b,
      CASE WHEN {apart} OR ({lone}) THEN text WHEN shared > 0 THEN {_GROWN} WHEN inside THEN lt ELSE text END AS t"""
    return _folded_into_last(source, p, _SHARED, step)


def adjacent_merged(source: str, p: str) -> str:
    asks = "ends_with(trim(lt), '?')"
    goes_on = f"(regexp_matches(trim(text), '^[{V.LOWER}]') OR len(ws) <= {V.CONTINUATION_WORDS})"
    joins = f"""(s - le <= {V.MERGE_GAP_SECONDS} AND trim(lt) <> '' AND trim(text) <> '' AND len(lws) + len(ws) <= {V.MERGED_WORDS}
      AND ({goes_on} OR (NOT {asks} AND (shared >= 2 OR inside OR holds))))"""
    repeats = f"lambda n: len(list_filter(range(greatest(0, len(lws) - 8), len(lws) - n + 1), lambda i: {_keys('lws')}[i + 1 : i + n] = {_keys('ws')}[1 : n])) > 0"
    size = f"CASE WHEN len(lws) >= 3 AND len(ws) BETWEEN 2 AND 8 THEN list_max(list_filter(range(2, least(4, len(lws), len(ws)) + 1), {repeats})) END"
    place = f"list_max(list_filter(range(greatest(0, len(lws) - 8), len(lws) - tail + 1), lambda i: {_keys('lws')}[i + 1 : i + tail] = {_keys('ws')}[1 : tail]))"
    told = f"{_SHARED}, {size} AS tail, {joins} AS goes"
    step = f"""NOT goes AS fresh, CASE WHEN goes THEN la ELSE s END AS a, CASE WHEN goes THEN greatest(le, e) ELSE e END AS b,
      CASE WHEN NOT goes THEN text WHEN shared > 0 AND NOT {asks} THEN {_GROWN} WHEN inside THEN lt WHEN holds THEN text
        WHEN tail IS NOT NULL THEN array_to_string(list_concat(lws[1 : {place}], ws), ' ') ELSE trim(lt || ' ' || text) END AS t"""
    return _folded_into_last(source, p, told, step)


def boundaries_stripped(source: str, p: str) -> str:
    head = f"^[{V.UPPER}]{{3,}}"
    cut = rf"CASE WHEN regexp_matches(text, '{head}') THEN coalesce(nullif(trim(regexp_extract(text, '{head}[,.]?\s*(.*)$', 1)), ''), text) ELSE text END"
    spelled = rf"regexp_matches(lt, '(?:^|[^\p{{L}}\p{{N}}_])(?:{_W}-){{2,}}{_W}$')"
    return _folded_into_last(source, p, f"{spelled} AS spelled", f"true AS fresh, s AS a, e AS b, CASE WHEN spelled THEN {cut} ELSE text END AS t")


_LAST = 'SELECT recording, seq, speaker, s AS start, e AS "end", text FROM'
_ORDERED = f"WITH RECURSIVE {HEARD}, {ordered('heard', 'o')}"
_REGIONS = """SELECT recording, row_number() OVER (PARTITION BY recording ORDER BY seq) AS k,
  CASE WHEN seq % 3 <> 0 THEN start END AS a, CASE WHEN seq % 2 = 0 THEN "end" END AS b, CAST(1.25 AS DOUBLE) AS d, CAST(20.0 AS DOUBLE) AS total FROM segments"""

ORACLE_SQL = {
    "dedup_segments": f"{_ORDERED}, {deduplicated('o', 'd')} {_LAST} d",
    "merge_overlaps": f"{_ORDERED}, {overlaps_merged('o', 'm')} {_LAST} m",
    "merge_adjacent": f"{_ORDERED}, {adjacent_merged('o', 'a')} {_LAST} a",
    "strip_boundaries": f"""WITH RECURSIVE {HEARD}, spoken AS (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN text || ' A-B-C' ELSE 'ABC, ' || text END AS text) FROM heard),
{ordered('spoken', 'o')}, {boundaries_stripped('o', 'b')} {_LAST} b""",
    "postprocess": f"{_ORDERED}, {deduplicated('o', 'd')}, {overlaps_merged('d', 'm')}, {boundaries_stripped('m', 'b')}, {adjacent_merged('b', 'a')} {_LAST} a",
    "region_times": f"""WITH RECURSIVE {SEGMENTS}, r AS ({_REGIONS}),
f(recording, k, cur, a, b) AS (
  SELECT DISTINCT recording, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM r
  UNION ALL
  SELECT recording, k, CASE WHEN b > a THEN greatest(cur, b) ELSE cur END, a, b FROM (
    SELECT recording, k, cur, greatest(CAST(0 AS DOUBLE), p) AS a, least(total, coalesce(q, p + d)) AS b FROM (
      SELECT r.recording, r.k, cur, total, d, r.b AS q, CASE WHEN r.b IS NULL THEN coalesce(r.a, cur) ELSE coalesce(r.a, r.b - d) END AS p
      FROM f JOIN r ON r.recording = f.recording AND r.k = f.k + 1)))
SELECT recording, a AS start, b AS "end" FROM f WHERE b > a""",
}
