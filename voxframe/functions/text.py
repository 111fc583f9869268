"""Text normalisation as Column expressions.

Letters and digits are Unicode's (a word character is a letter, a digit or an underscore), and so is white space; Java's
own ``\\w`` and ``\\s`` are ASCII only. Nulls count as empty texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

#: All that is neither word character nor white space.
MARKS = r"[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]"
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"


def clean_text(c: Column) -> Column:
    """Trimmed on both sides; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), rf"^{SPACE}|{SPACE}\z", "")


def collapse_space(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def tokens(c: Column) -> Column:
    """Words of a text, [] for a blank one."""
    return F.array_remove(F.split(collapse_space(c), " "), "")


def clean_for_asr(c: Column) -> Column:
    """Without [notes], white space collapsed."""
    return collapse_space(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?d)\[.*?\]", ""))


def _without(c: Column, patterns: list[str]) -> Column:
    """Without what the patterns match. One quick look for their plain words keeps most texts from the slow part; the
    long s is the one letter that ignoring case equates with another and lower() leaves."""
    plain = "|".join(re.sub(r"\\b|\.\*", "", p) for p in patterns)
    out = c
    for p in patterns:  # (?d): a dot stops at line ends alone; (?U): word boundaries know all letters
        out = F.regexp_replace(out, f"(?idU){p}", " ")
    return F.when(F.lower(c).rlike(f"{plain}|ſ"), out).otherwise(c)


def normalize_common(c: Column, patterns: list[str] | None = None) -> Column:
    """Lower case, made-up phrases and punctuation removed, white space collapsed.

    The phrases run to the end of the line, which in a joined transcript is its end.
    """
    text = _without(F.lower(clean_text(c)), V.HALLUCINATIONS if patterns is None else patterns)
    return collapse_space(F.regexp_replace(F.replace(text, F.lit("-"), F.lit(" ")), MARKS, " "))


def collapse_letters(words: Column) -> Column:
    """Letter names become letters, and two or more single letters in a row one word; takes and gives an array."""
    names = F.create_map(*[F.lit(x) for pair in V.LETTER_NAMES.items() for x in pair])
    # membership is a hash look-up, the map a scan: few words get there
    mapped = F.transform(words, lambda w: F.when(w.isin(*V.LETTER_NAMES), F.try_element_at(names, w)).otherwise(w))
    joined = F.regexp_replace(F.array_join(mapped, " "), r"(?<=(?:^| )\p{L}) (?=\p{L}(?: |$))", "")
    return F.array_remove(F.split(joined, " "), "")


def normalize_text(c: Column) -> Column:
    return F.array_join(collapse_letters(tokens(normalize_common(c))), " ")


def clean_segment(c: Column, whole_phrases: bool = False) -> Column:
    """A segment without made-up phrases; whole_phrases: only the phrases themselves, not what follows."""
    text = _without(clean_text(c), V.SEGMENT_WORDS if whole_phrases else V.SEGMENT_PHRASES)
    return F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" .,-"))


def is_hallucination(c: Column) -> Column:
    text = F.lower(clean_text(c))
    found = text == ""
    for p in V.SEGMENT_PHRASES:
        found = found | text.rlike(f"(?idU){p}")
    return found


def normalize_for_dedup(c: Column) -> Column:
    return collapse_space(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), MARKS, " "))


def word_key(c: Column) -> Column:
    """A word's letters and digits, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]", "")


def is_contained(short: Column, long: Column) -> Column:
    """Whether one normalised text is part of the other; false if either is blank."""
    a, b = normalize_for_dedup(short), normalize_for_dedup(long)
    return (a != "") & (b != "") & b.contains(a)


def _overlap(left: Column, right: Column, most: int) -> Column:
    def longest(s: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.lit(most))
        return F.array_max(F.filter(sizes, lambda k: (k <= F.size(s["l"])) & (k <= F.size(s["r"])) & (F.slice(s["l"], -k, k) == F.slice(s["r"], F.lit(1), k))))

    # words are bound to a variable: inside the inner lambda they would be split anew for every size
    bound = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), longest)
    return F.coalesce(F.element_at(bound, 1), F.lit(0))


def overlap_tokens(left: Column, right: Column, most: int = V.OVERLAP_TOKENS) -> Column:
    """The largest number of words that end one text and begin the other."""
    return _overlap(tokens(normalize_for_dedup(left)), tokens(normalize_for_dedup(right)), most)


def boundary_overlap(previous: Column, current: Column, most: int = V.BOUNDARY_WORDS) -> Column:
    """The same on words without punctuation, kept word by word."""
    return _overlap(F.transform(tokens(previous), word_key), F.transform(tokens(current), word_key), most)


def trim_boundary(previous: Column, current: Column, most: int = V.BOUNDARY_WORDS) -> Column:
    """struct(text: current without the words that end previous, trimmed: how many)."""
    k = boundary_overlap(previous, current, most)
    words = tokens(current)
    rest = F.when(k > 0, F.array_join(F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), " ")).otherwise(current)
    return F.struct(rest.alias("text"), k.alias("trimmed"))


def ends_spelled(c: Column) -> Column:
    """Whether a text ends in letters spelled with hyphens."""
    return F.coalesce(c, F.lit("")).rlike(r"(?U)(?:\b\w-){2,}\w$")


def prefix_matches(left: Column, right: Column, most: int = V.OFFSET_PREFIX) -> Column:
    """Equal words at equal places among the first ones; takes arrays."""
    n = F.least(F.size(left), F.size(right), F.lit(most))
    pairs = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: (a == b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def drop_words(words: Column, n: Column) -> Column:
    return F.slice(words, n + 1, F.greatest(F.size(words), F.lit(1)))


def preview(words: Column, n: int = 15) -> Column:
    """The first words and the last."""
    head = F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))
    tail = F.concat(F.lit("..."), F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " "))
    return F.struct(head.alias("head"), tail.alias("tail"))


def recording_id(name: Column) -> Column:
    """The number, or two joined by an underscore, that a file's name starts with; null if there is none."""
    return F.nullif(F.regexp_extract(name, r"^(\d+_\d+|\d+)", 1), F.lit(""))


def safe_file_name(stem: Column) -> Column:
    name = F.btrim(F.regexp_replace(stem, r"[^\p{L}\p{N}_.-]+", "_"), F.lit("._"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("hypothesis")).otherwise(name)


def is_full_hypothesis(stem: Column) -> Column:
    return F.lower(stem).contains("_full_") | F.lower(stem).endswith("_full")


def is_whisper(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts)).contains("whisper")


def segment_id(prefix: str, number: Column, recording: Column | None = None) -> Column:
    if recording is None:
        return F.format_string(f"{prefix}_%05d", number)
    return F.format_string(f"{prefix}_%s_%05d", recording, number)


def rewrite_id(segment: Column, recording: Column) -> Column:
    """The first "seg_" of an id becomes "seg_<recording>_"."""
    at = F.instr(segment, "seg_")
    return F.when(at > 0, F.concat(F.substring(segment, F.lit(1), at - 1), F.lit("seg_"), recording, F.lit("_"), F.substring(segment, at + 4, F.length(segment)))).otherwise(segment)
