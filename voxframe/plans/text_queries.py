"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.plans.inputs import SEGMENTS, norm_sql, segments, table, tokens_sql

TRIM = r"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def _sub(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', ' ', 'gi')"
    return x


def common_sql(x: str) -> str:
    inner = f"replace({_sub(f'lower({TRIM.format(x=x)})', V.HALLUCINATIONS)}, '-', ' ')"
    return rf"trim(regexp_replace(regexp_replace({inner}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def clean_for_asr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_for_asr(F.concat(F.lit("[noise] "), "text")).alias("clean"))


def normalize_common(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_common(F.col("text")).alias("norm"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def _spelled(c):
    return T.tokens(F.regexp_replace(T.normalize_for_dedup(c), "([aeiou])", " $1 "))


def collapse_letters(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("recording", "seq", F.array_join(T.collapse_letters(_spelled(F.col("text"))), " ").alias("joined"))


def islands(source: str, keys: str, words: str, p: str = "") -> str:
    """Gaps and islands over words: letter names become letters, runs of single letters one word. CTEs up to {p}t."""
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.LETTER_NAMES.items()) + "}"
    return rf"""{p}w AS (SELECT {keys}, unnest({words}) AS w0, unnest(range(1, len({words}) + 1)) AS i FROM {source}),
{p}m AS (SELECT {keys}, i, coalesce(names.n[w0], w0) AS w FROM {p}w, (SELECT {names} AS n) names),
{p}s AS (SELECT *, regexp_full_match(w, '\p{{L}}') AS one FROM {p}m),
{p}g AS (SELECT *, CASE WHEN one THEN i - row_number() OVER (PARTITION BY {keys}, one ORDER BY i) END AS g FROM {p}s),
{p}j AS (SELECT {keys}, min(i) AS i, string_agg(w, '' ORDER BY i) AS w FROM {p}g GROUP BY {keys}, coalesce('g' || g, 'i' || i)),
{p}t AS (SELECT {keys}, string_agg(w, ' ' ORDER BY i) AS text FROM {p}j GROUP BY {keys})"""


def clean_segments(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.when(F.col("seq") % 3 == 0, " - Titulky vytvořil kdosi").when(F.col("seq") % 3 == 1, " watch next, ").otherwise(" ..."))
    return segments(spark, d).select("recording", "seq", T.clean_segment(text).alias("to_line_end"), T.clean_segment(text, True).alias("phrases_only"), T.is_hallucination(text).alias("made_up"))


def normalize_for_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_for_dedup(F.col("text")).alias("norm"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the next one, which begins by repeating its last words."""
    rows = segments(spark, d)
    words = T.tokens(F.col("text"))
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - F.col("seq") % 5, F.lit(1)), F.lit(9)), " ")
    following = F.lead("text").over(Window.partitionBy("recording").orderBy("seq"))
    return rows.select("recording", "seq", "text", F.concat_ws(" ", tail, following).alias("following"))


NEIGHBOURS = rf"""{SEGMENTS},
tw AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws, lead(text) OVER (PARTITION BY recording ORDER BY seq) AS nxt FROM segments),
nb AS (SELECT recording, seq, text, concat_ws(' ', array_to_string(ws[greatest(len(ws) - seq % 5, 1) : greatest(len(ws) - seq % 5, 1) + 8], ' '), nxt) AS following FROM tw)"""


def overlap_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _neighbours(spark, d)
    trimmed = T.trim_boundary(F.col("text"), F.col("following"))
    return rows.select("recording", "seq", T.overlap_tokens(F.col("text"), F.col("following")).alias("shared"), trimmed["trimmed"].alias("trimmed"), F.length(trimmed["text"]).alias("rest_chars"))


def _edge_sql(a: str, b: str, most: int) -> str:
    return f"coalesce(list_max(list_filter(range(1, {most} + 1), lambda k: k <= len({a}) AND k <= len({b}) AND {a}[len({a}) - k + 1 : len({a})] = {b}[1 : k])), 0)"


def text_contained(spark: SparkSession, d: str) -> DataFrame:
    rows = _neighbours(spark, d)
    return rows.select("recording", "seq", T.is_contained(F.col("text"), F.col("following")).alias("in_next"), T.is_contained(F.substring("text", 3, 12), F.col("text")).alias("part_in_whole"))


def ends_spelled(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" A-B-C"))).otherwise(F.concat("text", F.lit("-D")))
    return table(spark, d, "documents").select("doc_id", T.ends_spelled(text).alias("spelled"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("speaker").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("words"), F.count("*").alias("segments"))


def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent words of each role; of equally frequent ones those said first."""
    rows = segments(spark, d).select("speaker", F.col("recording").cast("long").alias("r"), "seq", F.posexplode(T.tokens(T.normalize_for_dedup(F.col("text")))).alias("at", "token"))
    counted = rows.groupBy("speaker", "token").agg(F.count("*").alias("cnt"), F.min(F.struct("r", "seq", "at")).alias("first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("speaker").orderBy(F.desc("cnt"), "first"))).where(F.col("rank") <= V.TOP).drop("first")


def word_change_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Words beside each other that a variant map holds for the same: words of five letters or more are variants of their
    first four."""
    tokens = segments(spark, d).select("recording", "seq", F.posexplode(T.tokens(T.normalize_for_dedup(F.col("text")))).alias("at", "token"))
    mapping = tokens.where(F.length("token") >= 5).select(F.col("token").alias("variant"), F.substring("token", 1, 4).alias("canonical")).distinct()
    pairs = tokens.withColumn("nxt", F.lead("token").over(Window.partitionBy("recording", "seq").orderBy("at"))).where("nxt is not null")
    left, right = (mapping.select(F.col("variant").alias(f"v{k}"), F.col("canonical").alias(f"c{k}")) for k in (1, 2))
    joined = pairs.join(left, F.col("token") == F.col("v1"), "left").join(right, F.col("nxt") == F.col("v2"), "left")
    same = (F.coalesce("c1", "token") == F.coalesce("c2", "nxt")).cast("int")
    return joined.groupBy("recording").agg(F.sum(same).alias("equivalent"), F.count("*").alias("pairs"))


def _file_name():
    return F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.format_string("_%03d", F.col("doc_id") % 7)), F.when(F.col("doc_id") % 2 == 0, F.lit("_MIX_full_whisper")).otherwise(F.lit(" range: (wav2vec)")))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    name = _file_name()
    return table(spark, d, "documents").select("doc_id", T.recording_id(name).alias("recording"), T.safe_file_name(name).alias("safe"), T.is_full_hypothesis(name).alias("is_full"), T.is_whisper(name, F.col("source")).alias("is_whisper"), T.segment_id("seg", F.col("doc_id"), T.recording_id(name)).alias("seg_id"), T.rewrite_id(F.format_string("seg_%05d", "doc_id"), T.recording_id(name)).alias("rewritten"))


def previews(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.preview(words)["head"].alias("head"), T.preview(words)["tail"].alias("tail"), T.prefix_matches(words, T.drop_words(words, F.lit(1))).alias("prefix"))


QUERIES = {f.__name__: f for f in (clean_for_asr, normalize_common, normalize_text, collapse_letters, clean_segments, normalize_for_dedup, overlap_tokens, text_contained, ends_spelled, word_counts, top_tokens, word_change_equivalence, file_names, previews)}

_flat = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_seg_text = "text || CASE seq % 3 WHEN 0 THEN ' - Titulky vytvořil kdosi' WHEN 1 THEN ' watch next, ' ELSE ' ...' END"
_keys = lambda x: rf"list_transform(string_split({_flat.format(x=x)}, ' '), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g'))"

ORACLE_SQL = {
    "clean_for_asr": rf"SELECT doc_id, {_flat.format(x=r"regexp_replace('[noise] ' || coalesce(text, ''), '\[.*?\]', '', 'g')")} AS clean FROM documents",
    "normalize_common": f"SELECT doc_id, {common_sql('text')} AS norm FROM documents",
    "normalize_text": f"WITH n AS (SELECT doc_id, {tokens_sql(common_sql('text'))} AS ws FROM documents), {islands('n', 'doc_id', 'ws')} SELECT n.doc_id, coalesce(t.text, '') AS norm FROM n LEFT JOIN t USING (doc_id)",
    "collapse_letters": rf"WITH {SEGMENTS}, n AS (SELECT recording, seq, {tokens_sql("regexp_replace(" + norm_sql("text") + r", '([aeiou])', ' \1 ', 'g')")} AS ws FROM segments), {islands('n', 'recording, seq', 'ws')} SELECT n.recording, n.seq, coalesce(t.text, '') AS joined FROM n LEFT JOIN t USING (recording, seq)",
    "clean_segments": rf"""WITH {SEGMENTS}, x AS (SELECT recording, seq, {TRIM.format(x=_seg_text)} AS t FROM segments)
SELECT recording, seq, trim(regexp_replace({_sub('t', V.SEGMENT_PHRASES)}, '\s+', ' ', 'g'), ' .,-') AS to_line_end, trim(regexp_replace({_sub('t', V.SEGMENT_WORDS).replace("vytvořil" + chr(92) + "b", "vytvořil" + chr(92) + "b")}, '\s+', ' ', 'g'), ' .,-') AS phrases_only,
  t = '' OR {' OR '.join(f"regexp_matches(lower(t), '{p}')" for p in V.SEGMENT_PHRASES)} AS made_up FROM x""",
    "normalize_for_dedup": f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents",
    "overlap_tokens": rf"""WITH {NEIGHBOURS}, k AS (SELECT *, {tokens_sql(norm_sql('text'))} AS a, {tokens_sql(norm_sql('following'))} AS b, {_keys('text')} AS ka, {_keys('following')} AS kb, string_split({_flat.format(x='following')}, ' ') AS ws FROM nb),
e AS (SELECT *, {_edge_sql('ka', 'kb', V.BOUNDARY_WORDS)} AS n FROM k)
SELECT recording, seq, CAST({_edge_sql('a', 'b', V.OVERLAP_TOKENS)} AS INTEGER) AS shared, CAST(n AS INTEGER) AS trimmed, CAST(length(CASE WHEN n > 0 THEN array_to_string(ws[n + 1 :], ' ') ELSE following END) AS INTEGER) AS rest_chars FROM e""",
    "text_contained": f"""WITH {NEIGHBOURS}, n AS (SELECT recording, seq, {norm_sql('text')} AS a, {norm_sql('following')} AS b, {norm_sql('substring(text, 3, 12)')} AS c FROM nb)
SELECT recording, seq, a <> '' AND b <> '' AND contains(b, a) AS in_next, c <> '' AND a <> '' AND contains(a, c) AS part_in_whole FROM n""",
    "ends_spelled": r"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 2 = 0 THEN text || ' A-B-C' ELSE text || '-D' END, '(?:^|[^\p{L}\p{N}_])(?:[\p{L}\p{N}_]-){2,}[\p{L}\p{N}_]$') AS spelled FROM documents",
    "word_counts": rf"WITH {SEGMENTS} SELECT speaker, CAST(sum(len({tokens_sql(_flat.format(x='text'))})) AS BIGINT) AS words, count(*) AS segments FROM segments GROUP BY speaker",
    "top_tokens": f"""WITH {SEGMENTS}, l AS (SELECT speaker, CAST(recording AS BIGINT) AS r, seq, {tokens_sql(norm_sql('text'))} AS ws FROM segments),
w AS (SELECT speaker, r, seq, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM l),
c AS (SELECT speaker, token, count(*) AS cnt, min({{'r': r, 's': seq, 'a': pos}}) AS f FROM w GROUP BY ALL)
SELECT speaker, token, cnt, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY cnt DESC, f) AS rank FROM c) WHERE rank <= {V.TOP}""",
    "word_change_equivalence": f"""WITH {SEGMENTS}, l AS (SELECT recording, seq, {tokens_sql(norm_sql('text'))} AS ws FROM segments),
p AS (SELECT recording, unnest(ws[1 : len(ws) - 1]) AS a, unnest(ws[2 :]) AS b FROM l WHERE len(ws) > 1),
c AS (SELECT recording, CASE WHEN length(a) >= 5 THEN substring(a, 1, 4) ELSE a END AS a, CASE WHEN length(b) >= 5 THEN substring(b, 1, 4) ELSE b END AS b FROM p)
SELECT recording, CAST(count(*) FILTER (a = b) AS BIGINT) AS equivalent, count(*) AS pairs FROM c GROUP BY recording""",
    "file_names": r"""WITH n AS (SELECT doc_id, source, doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE format('_{:03d}', doc_id % 7) END || CASE WHEN doc_id % 2 = 0 THEN '_MIX_full_whisper' ELSE ' range: (wav2vec)' END AS name FROM documents),
r AS (SELECT *, nullif(regexp_extract(name, '^(\d+_\d+|\d+)', 1), '') AS recording FROM n)
SELECT doc_id, recording, trim(regexp_replace(name, '[^\p{L}\p{N}_.-]+', '_', 'g'), '._') AS safe, contains(lower(name), '_full_') OR ends_with(lower(name), '_full') AS is_full,
  contains(lower(name || ' ' || source), 'whisper') AS is_whisper, format('seg_{}_{:05d}', recording, doc_id) AS seg_id, format('seg_{}_{:05d}', recording, doc_id) AS rewritten FROM r""",
    "previews": rf"""WITH w AS (SELECT doc_id, {tokens_sql(_flat.format(x="text"))} AS ws FROM documents)
SELECT doc_id, array_to_string(ws[1:15], ' ') || '...' AS head, '...' || array_to_string(ws[greatest(len(ws) - 14, 1) :], ' ') AS tail,
  CAST(len(list_filter(range(1, least(len(ws) - 1, 12) + 1), lambda i: ws[i] = ws[i + 1])) AS INTEGER) AS prefix FROM w""",
}
