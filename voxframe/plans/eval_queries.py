"""Queries of alignment and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.operators import alignment as A
from voxframe.operators import evaluation as E
from voxframe.operators import segments as G
from voxframe.plans import reports
from voxframe.plans.inputs import ALIGNED, DISTANCES, SEGMENTS, WORD_PAIRS, alignment_sql, segments, tokens_sql, word_pairs
from voxframe.plans.storage import kept
from voxframe.plans.text_queries import common_sql, islands

KEYS = ["recording", "seq", "speaker"]


def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.word_error_rates(word_pairs(spark, d), KEYS)


def wer_by_role(spark: SparkSession, d: str) -> DataFrame:
    rates = E.word_error_rates(word_pairs(spark, d), KEYS)
    return rates.groupBy("speaker").agg(F.sum("distance").alias("distance"), F.sum("ref_words").alias("ref_words"), (F.sum("distance") / F.sum("ref_words")).alias("wer"))


def weighted_wer(spark: SparkSession, d: str) -> DataFrame:
    return E.pooled(E.word_error_rates(word_pairs(spark, d), KEYS).where("ref_words > 0"), ["recording"])


def _shown_chunks():
    """Chunks as text: kind and places."""
    return F.array_join(F.transform("chunks", lambda c: F.concat_ws(" ", c["op"], c["rs"], c["re"], c["hs"], c["he"])), "|")


def error_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = A.with_alignment(word_pairs(spark, d))
    return rows.select(*KEYS, *E.METRICS, _shown_chunks().alias("chunks"))


def top_errors(spark: SparkSession, d: str) -> DataFrame:
    return A.top_errors(A.errors(A.with_alignment(word_pairs(spark, d)), ["speaker", "recording"]), ["speaker", "recording"])


def error_examples(spark: SparkSession, d: str) -> DataFrame:
    top = A.top_errors(A.errors(A.with_alignment(word_pairs(spark, d)), ["recording"]), ["recording"])
    return A.examples(top, ["recording"]).select("recording", F.array_join("examples", "\n").alias("examples"))


def _maps(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Made-up maps: what "zz" was heard for words of three letters, and words of four letters or more for their first four."""
    words = pairs.select(F.explode("ref").alias("w")).distinct()
    numbers = words.where(F.length("w") == 3).select(F.col("w").alias("variant"), F.lit("zz").alias("canonical"))
    return words.where(F.length("w") > 4).select(F.col("w").alias("variant"), F.substring("w", 1, 4).alias("canonical")), numbers


def corrected(spark: SparkSession, d: str) -> DataFrame:
    pairs = word_pairs(spark, d)
    words, numbers = _maps(pairs)
    out = E.evaluate(pairs, KEYS, words, numbers)
    return out.select(*KEYS, "hits", "sub", "ins", "del", "wer", "numbers_checked", "numbers_replaced", "numbers_before", "numbers_after", "numbers_used", "words_checked", "words_replaced", "words_before", "words_after", "words_used")


def _late(spark: SparkSession, d: str) -> DataFrame:
    """Noisy turns; every third one's hypothesis lost its first words, every third one's reference its first."""
    rows = word_pairs(spark, d)
    cut = lambda side, k, n: T.drop_words(F.col(side), F.when(F.col("seq") % 3 == k, F.lit(n)).otherwise(F.lit(0)))
    return rows.withColumn("hyp", cut("hyp", 0, 2)).withColumn("ref", cut("ref", 1, 3))


def offset_compensation(spark: SparkSession, d: str) -> DataFrame:
    """All turns, also those that a trim can empty."""
    return E.offset_compensation(_late(spark, d), KEYS)


def _roles(spark: SparkSession, d: str, exchanges: bool = False) -> DataFrame:
    """exchanges: two turns are a recording of their own, which the SQL's quadratic alignment can bear."""
    rows = segments(spark, d).where(F.col("speaker").isin(*V.EVAL_ROLES))
    if exchanges:
        rows = rows.withColumn("recording", F.concat_ws("_", "recording", F.floor(F.col("seq") / 2)))
    channels = G.channel_texts(rows.withColumn("speaker", F.when(F.col("speaker") == "interviewer", "Speaker_L").otherwise("Speaker_R")).withColumn("text", F.concat(F.col("text"), F.lit(" zz"))), ["recording"])
    truth = rows.groupBy("recording", F.col("speaker").alias("role")).agg(G.joined("text").alias("text"))
    return G.assign_roles(channels, truth, ["recording"])


def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _roles(spark, d).select("recording", "mapping", "role", "channel", F.length("ref").alias("ref_chars"), F.length("hyp").alias("hyp_chars"))


def _role_pairs(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: T.tokens(T.normalize_text(F.col(c)))
    return _roles(spark, d, exchanges=True).withColumn("ref", words("ref")).withColumn("hyp", words("hyp"))


def mapping_confidence(spark: SparkSession, d: str) -> DataFrame:
    rates = E.word_error_rates(_role_pairs(spark, d), ["recording", "mapping", "role", "channel"])
    return E.mapping_confidence(rates, ["recording"])


def length_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = word_pairs(spark, d).withColumn("hyp", F.when(F.col("seq") % 2 == 0, F.slice("hyp", 1, 5)).otherwise(F.concat("hyp", "hyp")))
    return rows.select(*KEYS, E.length_warning(F.size("ref"), F.size("hyp")).alias("warning"))


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """A report per recording, with a section for each turn."""
    pairs = word_pairs(spark, d).select("recording", F.col("seq").alias("section"), "ref", "hyp")
    sections = reports.text_report(A.with_alignment(pairs), ["recording", "section"])
    return reports.appended(sections, ["recording"])


def speaker_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.speaker_report(kept(A.with_alignment(_role_pairs(spark, d))), ["recording"])


QUERIES = {f.__name__: f for f in (wer_pairs, wer_by_role, weighted_wer, error_counts, top_errors, error_examples, corrected, offset_compensation, role_assignment, mapping_confidence, length_warnings, report_text, speaker_report)}

_RATES = f"""WITH RECURSIVE {DISTANCES},
rates AS (SELECT p.recording, p.seq, p.speaker, CAST(d[len(hyp) + 1] AS BIGINT) AS distance, CAST(len(ref) AS INTEGER) AS ref_words, CAST(len(hyp) AS INTEGER) AS hyp_words,
  CASE WHEN len(ref) > 0 THEN CAST(d[len(hyp) + 1] AS DOUBLE) / len(ref) END AS wer FROM pairs p JOIN dp ON dp.recording = p.recording AND dp.seq = p.seq AND dp.i = len(p.ref))"""

_ERRORS = f"""{ALIGNED},
errors AS (SELECT c.recording, c.seq, p.speaker, c.op, array_to_string(ref[rs + 1 : re], ' ') AS ref_text, array_to_string(hyp[hs + 1 : he], ' ') AS hyp_text, rs, hs FROM chunks c JOIN pairs p USING (recording, seq) WHERE op <> 'equal')"""


def _top(keys: str) -> str:
    return f"""counted AS (SELECT {keys}, op, ref_text, hyp_text, count(*) AS cnt, min({{'a': rs, 'b': hs, 'c': ref_text, 'd': hyp_text}}) AS f FROM errors GROUP BY ALL),
top AS (SELECT {keys}, op, ref_text, hyp_text, cnt, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, op ORDER BY cnt DESC, f) AS rank FROM counted) WHERE rank <= {V.TOP})"""


def _pass(p: str, before: str, after: str, known: str, canonical: str) -> str:
    """One dictionary pass: CTEs from {before}, {before}chunks and {before}metrics to the same of ``after``.

    known: whether the map holds a word x; canonical: what it holds it for.
    """
    form = lambda x: f"CASE WHEN {known.format(x=x)} THEN {canonical.format(x=x)} ELSE {x} END"
    return f"""{p}words AS (SELECT c.recording, c.seq, h, q.ref[rs + h - hs] AS word, q.hyp[h] AS said
  FROM (SELECT *, unnest(range(hs + 1, he + 1)) AS h FROM {before}chunks WHERE op = 'substitute') c JOIN {before} q USING (recording, seq)),
{p}fixes AS (SELECT recording, seq, list({{'h': h, 'w': word}}) AS fix FROM {p}words WHERE word <> said AND {form('word')} = {form('said')} GROUP BY ALL),
{p}spans AS (SELECT recording, seq, count(*) AS n FROM {before}chunks WHERE op = 'substitute' GROUP BY ALL),
{p}tried AS (SELECT q.recording, q.seq, q.speaker, ref, hyp, CAST(coalesce(s.n, 0) AS INTEGER) AS checked, CAST(coalesce(len(fix), 0) AS INTEGER) AS replaced,
  list_transform(range(1, len(hyp) + 1), lambda i: coalesce(list_filter(fix, lambda f: f.h = i)[1].w, hyp[i])) AS fixed
  FROM {before} q LEFT JOIN {p}fixes USING (recording, seq) LEFT JOIN {p}spans s USING (recording, seq)),
{p}again AS (SELECT recording, seq, ref, fixed AS hyp FROM {p}tried WHERE replaced > 0),
{alignment_sql(p + "again", p + "n")},
{after} AS (SELECT t.recording, t.seq, t.speaker, t.ref, CASE WHEN n.wer <= o.wer THEN fixed ELSE hyp END AS hyp, checked, replaced,
  o.wer AS before, CASE WHEN replaced > 0 THEN n.wer ELSE o.wer END AS after, coalesce(CASE WHEN replaced > 0 THEN n.wer ELSE o.wer END <= o.wer, false) AS used, coalesce(n.wer <= o.wer, false) AS changed
  FROM {p}tried t JOIN {before}metrics o USING (recording, seq) LEFT JOIN {p}nmetrics n USING (recording, seq)),
{after}chunks AS (SELECT c.* FROM {p}nchunks c JOIN {after} USING (recording, seq) WHERE changed UNION ALL SELECT c.* FROM {before}chunks c JOIN {after} USING (recording, seq) WHERE NOT changed),
{after}metrics AS (SELECT c.* FROM {p}nmetrics c JOIN {after} USING (recording, seq) WHERE changed UNION ALL SELECT c.* FROM {before}metrics c JOIN {after} USING (recording, seq) WHERE NOT changed)"""


_CORRECTED = f"""WITH RECURSIVE {WORD_PAIRS}, {alignment_sql("pairs", "pairs")},
known AS (SELECT list(DISTINCT w) AS ws FROM (SELECT unnest(ref) AS w FROM pairs)),
{_pass("x", "pairs", "numbered", "length({x}) = 3 AND list_contains((SELECT ws FROM known), {x})", "'zz'")},
{_pass("y", "numbered", "worded", "length({x}) > 4 AND list_contains((SELECT ws FROM known), {x})", "substring({x}, 1, 4)")}
SELECT w.recording, w.seq, w.speaker, m.hits, m.sub, m.ins, m.del, m.wer, a.checked AS numbers_checked, a.replaced AS numbers_replaced, a.before AS numbers_before, a.after AS numbers_after, a.used AS numbers_used,
  w.checked AS words_checked, w.replaced AS words_replaced, w.before AS words_before, w.after AS words_after, w.used AS words_used
FROM worded w JOIN numbered a USING (recording, seq) JOIN wordedmetrics m USING (recording, seq)"""

# which speaker is which channel: by length, and the other way round; rates of both
_ROLE_RATES = f"""WITH RECURSIVE {SEGMENTS}, said AS (SELECT * REPLACE (recording || '_' || (seq // 2) AS recording) FROM segments WHERE speaker IN ('interviewer', 'interviewee')),
two AS (SELECT *, count(*) OVER (PARTITION BY recording) AS n FROM (SELECT recording, speaker AS role, string_agg(text, ' ' ORDER BY seq) AS ref, string_agg(trim(text || ' zz'), ' ' ORDER BY seq) AS hyp FROM said GROUP BY ALL)),
r AS (SELECT recording, role, ref, row_number() OVER (PARTITION BY recording ORDER BY length(ref), role) AS k FROM two WHERE n = 2),
c AS (SELECT recording, CASE role WHEN 'interviewer' THEN 'speaker_l' ELSE 'speaker_r' END AS channel, hyp, row_number() OVER (PARTITION BY recording ORDER BY length(hyp), role DESC) AS k FROM two WHERE n = 2),
told AS (SELECT row_number() OVER () AS seq, r.recording, mapping, role, channel, {tokens_sql(common_sql("ref"))} AS ref0, {tokens_sql(common_sql("hyp"))} AS hyp0
  FROM r JOIN c USING (recording) JOIN (VALUES ('length', true), ('swapped', false)) m(mapping, same) ON (r.k = c.k) = m.same),
{islands("told", "seq", "ref0", "x")}, {islands("told", "seq", "hyp0", "y")},
pairs AS (SELECT recording, seq, mapping, role, channel, {tokens_sql("coalesce(xt.text, '')")} AS ref, {tokens_sql("coalesce(yt.text, '')")} AS hyp FROM told LEFT JOIN xt USING (seq) LEFT JOIN yt USING (seq)),
{alignment_sql("pairs")},
rates AS (SELECT p.recording, mapping, role, channel, wer, len(ref) AS n, len(hyp) AS m, hits, sub, ins, del FROM pairs p JOIN metrics USING (recording, seq))"""

# distances of the reversed texts: what a trim leaves of a text is a row or a column of their matrix
_OFFSETS = f"""WITH RECURSIVE {WORD_PAIRS},
cut AS (SELECT recording, seq, speaker, ref[CASE WHEN seq % 3 = 1 THEN 4 ELSE 1 END :] AS ref, hyp[CASE WHEN seq % 3 = 0 THEN 3 ELSE 1 END :] AS hyp FROM pairs),
back AS (SELECT *, list_reverse(ref) AS a, list_reverse(hyp) AS b FROM cut),
dp(recording, seq, i, d) AS (
  SELECT recording, seq, 0, range(0, len(b) + 1) FROM back
  UNION ALL
  SELECT dp.recording, dp.seq, i + 1, list_prepend(i + 1, list_transform(range(1, len(b) + 1), lambda j: j + least(i + 1, list_min(list_transform(range(1, j + 1), lambda k: least(d[k + 1] + 1, d[k] + CASE WHEN b[k] = a[i + 1] THEN 0 ELSE 1 END) - k)))))
  FROM dp JOIN back USING (recording, seq) WHERE i < len(a)),
options AS (SELECT t AS r, 0 AS h, greatest(0, 2 * t - 1) AS k FROM range(0, 7) x(t) UNION ALL SELECT 0, t, 2 * t FROM range(1, 7) x(t)),
tries AS (SELECT c.recording, c.seq, c.speaker, r, h, k, CASE WHEN len(ref) > r THEN CAST(d[len(hyp) - h + 1] AS DOUBLE) / (len(ref) - r) ELSE 0.0 END AS wer,
  len(list_filter(range(1, least(12, len(ref) - r, len(hyp) - h) + 1), lambda i: ref[r + i] = hyp[h + i])) AS prefix
  FROM cut c CROSS JOIN options JOIN dp ON dp.recording = c.recording AND dp.seq = c.seq AND dp.i = len(ref) - r WHERE k = 0 OR (len(ref) > r AND len(hyp) > h)),
o AS (SELECT * FROM tries WHERE k = 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording, seq ORDER BY wer, -prefix, k) AS z FROM tries) WHERE z = 1)
SELECT o.recording, o.seq, o.speaker, o.wer AS base_wer, b.wer AS comp_wer, CAST(b.r AS INTEGER) AS ref_trim, CAST(b.h AS INTEGER) AS hyp_trim, o.wer - b.wer AS improvement,
  CAST(o.prefix AS INTEGER) AS base_prefix, CAST(b.prefix AS INTEGER) AS comp_prefix, b.r + b.h > 0 AND o.wer - b.wer >= 0.01 AND b.prefix >= o.prefix AS "use" FROM o JOIN b USING (recording, seq)"""



def _body(keys: str) -> str:
    """CTE bodies ({keys}, body): a report's lines from the counts on, of the pairs, metrics and top there are."""
    head = lambda x: f"array_to_string({x}[1:15], ' ') || '...'"
    tail = lambda x: f"'...' || array_to_string({x}[greatest(len({x}) - 14, 1) :], ' ')"
    lines = lambda op, line: f"coalesce(string_agg(cnt || 'x | ' || {line} || chr(10), '' ORDER BY rank) FILTER (op = '{op}'), '') AS {op}s"
    one = lambda op, line: f"max(CASE WHEN rank = 1 AND op = '{op}' THEN {line} END)"
    return f"""kinds AS (SELECT {keys}, {lines("substitute", "ref_text || ' => ' || hyp_text")}, {lines("delete", "ref_text")}, {lines("insert", "hyp_text")},
  list_filter([{one("substitute", "'SUB (' || cnt || 'x): ' || chr(39) || ref_text || chr(39) || ' -> ' || chr(39) || hyp_text || chr(39)")},
    {one("delete", "'DEL (' || cnt || 'x): ' || chr(39) || ref_text || chr(39)")}, {one("insert", "'INS (' || cnt || 'x): ' || chr(39) || hyp_text || chr(39)")}], lambda x: x IS NOT NULL) AS shown FROM top GROUP BY {keys}),
bodies AS (SELECT p.*, wer, 'HITS: ' || hits || ' | SUB: ' || sub || ' | INS: ' || ins || ' | DEL: ' || del || chr(10) || chr(10) || 'Kvalitativní ukázky (2-3):' || chr(10)
  || CASE WHEN coalesce(len(shown), 0) = 0 THEN '(Nenalezeny žádné ukázky)' ELSE array_to_string(list_transform(shown, lambda x, i: i || '. ' || x), chr(10)) END
  || chr(10) || chr(10) || 'Začátek srovnání:' || chr(10) || 'REF: ' || {head("ref")} || chr(10) || 'HYP: ' || {head("hyp")}
  || chr(10) || chr(10) || 'Konec srovnání:' || chr(10) || 'REF: ' || {tail("ref")} || chr(10) || 'HYP: ' || {tail("hyp")}
  || chr(10) || chr(10) || 'Top substitutions:' || chr(10) || coalesce(substitutes, '') || chr(10) || 'Top deletions:' || chr(10) || coalesce(deletes, '') || chr(10) || 'Top insertions:' || chr(10) || coalesce(inserts, '') AS body
  FROM pairs p JOIN metrics USING (recording, seq) LEFT JOIN kinds USING ({keys}))"""


_percent = lambda x: f"coalesce(printf('%.2f %%', {x} * 100), 'n/a')"
_WIDE, _THIN = "repeat('=', 80)", "repeat('-', 80)"
_REPORT = f"""WITH RECURSIVE {_ERRORS}, {_top("recording, seq")}, {_body("recording, seq")}
SELECT recording, string_agg('ASR Evaluation Report' || chr(10) || {_WIDE} || chr(10) || {_THIN} || chr(10) || 'WER: ' || {_percent("wer")} || chr(10) || body,
  chr(10) || repeat(repeat('=', 80) || chr(10), 2) || chr(10) ORDER BY seq) AS report FROM bodies GROUP BY recording"""
_role_line = lambda r: f"'WER ({r}): ' || {_percent(f'max(wer) FILTER (role = {chr(39)}{r}{chr(39)})')} || chr(10)"
_role_part = lambda r: f"chr(10) || {_WIDE} || chr(10) || chr(10) || max(section) FILTER (role = '{r}')"
_SPEAKER_REPORT = f"""{_ROLE_RATES},
w AS (SELECT recording, mapping, avg(wer) AS macro, CASE WHEN sum(n) > 0 THEN sum(wer * n) / sum(n) ELSE 0.0 END AS wer FROM rates GROUP BY ALL),
sure AS (SELECT recording, max(wer) FILTER (mapping = 'length') AS a, max(wer) FILTER (mapping = 'swapped') AS b, max(macro) FILTER (mapping = 'length') AS macro FROM w GROUP BY recording),
errors AS (SELECT c.recording, c.seq, c.op, array_to_string(ref[rs + 1 : re], ' ') AS ref_text, array_to_string(hyp[hs + 1 : he], ' ') AS hyp_text, rs, hs FROM chunks c JOIN pairs p USING (recording, seq) WHERE op <> 'equal' AND mapping = 'length'),
{_top("recording, seq")}, {_body("recording, seq")},
sections AS (SELECT recording, role, channel, wer, 'Speaker section: ' || role || chr(10) || {_THIN} || chr(10) || 'GT role: ' || role || ' | ASR source: ' || channel || chr(10) || 'WER: ' || {_percent("wer")} || chr(10)
  || 'Word counts: REF=' || len(ref) || ' | HYP=' || len(hyp) || chr(10) || body AS section FROM bodies WHERE mapping = 'length')
SELECT recording, 'ASR Speaker Evaluation Report' || chr(10) || {_WIDE} || chr(10) || 'Evaluation source: speaker_full_transcriptions' || chr(10) || 'Speaker mapping by text length:' || chr(10)
  || '- interviewer <= ' || max(channel) FILTER (role = 'interviewer') || chr(10) || '- interviewee <= ' || max(channel) FILTER (role = 'interviewee') || chr(10)
  || 'Mapping confidence (weighted WER): length_based=' || {_percent("any_value(a)")} || ' | swapped=' || {_percent("any_value(b)")} || ' | winner=' || CASE WHEN any_value(b) < any_value(a) THEN 'swapped' ELSE 'length_based' END
  || ' | delta=' || printf('%.2f', (any_value(b) - any_value(a)) * 100) || ' p.b.' || chr(10) || {_THIN} || chr(10) || {_role_line("interviewer")} || {_role_line("interviewee")}
  || 'WER (macro avg): ' || {_percent("any_value(macro)")} || chr(10) || 'WER (weighted by REF words): ' || {_percent("any_value(a)")} || chr(10)
  || {_role_part("interviewer")} || {_role_part("interviewee")} AS report FROM sections JOIN sure USING (recording) GROUP BY recording"""

ORACLE_SQL = {
    "report_text": _REPORT,
    "speaker_report": _SPEAKER_REPORT,
    "wer_pairs": f"{_RATES} SELECT * FROM rates",
    "wer_by_role": f"{_RATES} SELECT speaker, CAST(sum(distance) AS BIGINT) AS distance, CAST(sum(ref_words) AS BIGINT) AS ref_words, CAST(sum(distance) AS DOUBLE) / sum(ref_words) AS wer FROM rates GROUP BY speaker",
    "weighted_wer": f"{_RATES} SELECT recording, avg(wer) AS macro_wer, sum(wer * ref_words) / sum(ref_words) AS weighted_wer, CAST(sum(ref_words) AS BIGINT) AS ref_words FROM rates WHERE ref_words > 0 GROUP BY recording",
    "role_assignment": f"""WITH {SEGMENTS}, s AS (SELECT * FROM segments WHERE speaker IN ('interviewer', 'interviewee')),
t AS (SELECT recording, speaker AS role, string_agg(text, ' ' ORDER BY seq) AS ref, string_agg(trim(text || ' zz'), ' ' ORDER BY seq) AS hyp FROM s GROUP BY ALL),
n AS (SELECT *, CASE role WHEN 'interviewer' THEN 'speaker_l' ELSE 'speaker_r' END AS channel, count(*) OVER (PARTITION BY recording) AS n FROM t),
r AS (SELECT recording, role, ref, row_number() OVER (PARTITION BY recording ORDER BY length(ref), role) AS k FROM n WHERE n = 2),
c AS (SELECT recording, channel, hyp, row_number() OVER (PARTITION BY recording ORDER BY length(hyp), channel) AS k FROM n WHERE n = 2)
SELECT r.recording, m.mapping, role, channel, CAST(length(ref) AS INTEGER) AS ref_chars, CAST(length(hyp) AS INTEGER) AS hyp_chars
FROM r JOIN c USING (recording) JOIN (VALUES ('length', true), ('swapped', false)) m(mapping, same) ON (r.k = c.k) = m.same""",
    "length_warnings": f"""WITH {WORD_PAIRS}, h AS (SELECT recording, seq, speaker, len(ref) AS r, CASE WHEN seq % 2 = 0 THEN least(len(hyp), 5) ELSE 2 * len(hyp) END AS h FROM pairs)
SELECT recording, seq, speaker, CASE WHEN h > 1.5 * r THEN 'hypothesis is over 1.5 times as long as the reference' WHEN h < 0.5 * r THEN 'hypothesis is under half as long as the reference' END AS warning FROM h""",
    "offset_compensation": _OFFSETS,
    "corrected": _CORRECTED,
    "error_counts": f"WITH RECURSIVE {ALIGNED} SELECT m.recording, m.seq, speaker, hits, sub, ins, del, wer, chunks FROM metrics m JOIN pairs USING (recording, seq)",
    "top_errors": f"WITH RECURSIVE {_ERRORS}, {_top('speaker, recording')} SELECT * FROM top",
    "error_examples": f"""WITH RECURSIVE {_ERRORS}, {_top('recording')},
lines AS (SELECT recording, CASE op WHEN 'substitute' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END AS k, CASE op WHEN 'substitute' THEN 'SUB (' || cnt || 'x): ''' || ref_text || ''' -> ''' || hyp_text || ''''
  WHEN 'delete' THEN 'DEL (' || cnt || 'x): ''' || ref_text || '''' ELSE 'INS (' || cnt || 'x): ''' || hyp_text || '''' END AS line FROM top WHERE rank = 1)
SELECT recording, string_agg(line, chr(10) ORDER BY k) AS examples FROM lines GROUP BY recording""",
    "mapping_confidence": f"""{_ROLE_RATES},
w AS (SELECT recording, mapping, CASE WHEN sum(n) > 0 THEN sum(wer * n) / sum(n) ELSE 0.0 END AS wer FROM rates GROUP BY ALL),
s AS (SELECT recording, max(wer) FILTER (mapping = 'length') AS length_wer, max(wer) FILTER (mapping = 'swapped') AS swapped_wer FROM w GROUP BY recording)
SELECT recording, length_wer, swapped_wer, CASE WHEN swapped_wer < length_wer THEN 'swapped' ELSE 'length' END AS winner, (swapped_wer - length_wer) * 100 AS delta_points FROM s""",
}
