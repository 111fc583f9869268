"""Fixed values that results depend on: phrase lists, letter names, limits."""

# Phrases that recognisers make up on silence, removed before transcripts are compared.
HALLUCINATIONS = [
    r"titulky vytvořil.*",
    r"děkuji za sledování.*",
    r"odběratelé.*",
    r"přeložil.*",
    r"reaping.*",
    r"watch next.*",
    r"thanks for watching.*",
    r"titulky.*",
]
# The same for single segments, to the end of the line.
SEGMENT_PHRASES = [
    r"titulky vytvořil.*",
    r"děkuji za sledování.*",
    r"odběratelé.*",
    r"přeložil.*",
    r"watch next.*",
    r"thanks for watching.*",
    r"titulky.*",
]
# The same for single segments, whole phrases only.
SEGMENT_WORDS = [
    r"\btitulky vytvořil\b",
    r"\bděkuji za sledování\b",
    r"\bthanks for watching\b",
    r"\bwatch next\b",
    r"\bjohnyx\b",
]
# Czech names of letters.
LETTER_NAMES = {
    "a": "a", "á": "a", "bé": "b", "b": "b", "cé": "c", "c": "c", "čé": "č", "č": "č", "dé": "d", "d": "d",
    "é": "e", "e": "e", "ef": "f", "f": "f", "gé": "g", "g": "g", "há": "h", "h": "h", "chá": "ch",
    "í": "i", "i": "i", "jé": "j", "j": "j", "ká": "k", "k": "k", "el": "l", "l": "l", "em": "m", "m": "m",
    "en": "n", "n": "n", "ó": "o", "o": "o", "pé": "p", "p": "p", "kvé": "q", "q": "q", "er": "r", "r": "r",
    "es": "s", "s": "s", "té": "t", "t": "t", "ú": "u", "u": "u", "ů": "u", "vé": "v", "v": "v", "w": "w",
    "dvojitévé": "w", "ix": "x", "x": "x", "ý": "y", "y": "y", "zet": "z", "z": "z", "žet": "ž", "ž": "ž",
}
# Letters of capitalised and lower-case words in segments.
UPPER = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
LOWER = "a-záčďéěíňóřšťúůýž"
# Limits of the segment operators and of the evaluation.
WINDOW_OVERFLOW_SECONDS = 0.6
OFFSET_TRIM_WORDS = 6
OFFSET_IMPROVEMENT = 0.01
OFFSET_PREFIX = 12
OVERLAP_TOKENS = 12
BOUNDARY_WORDS = 8
MERGE_GAP_SECONDS = 1.2
MERGED_WORDS = 36
CONTINUATION_WORDS = 4
DEDUP_SECONDS = 1.5
CHANNEL_DEDUP_SECONDS = 1.0
PACK_GAP_SECONDS = 0.1
PACKED_CHUNK_SECONDS = 360.0
PLAIN_CHUNK_SECONDS = 60.0
CHUNK_OVERLAP_SECONDS = 2.0
CHUNK_BACKSHIFT_SECONDS = 1.0
VAD = {"min_dur": 0.25, "max_dur": 20.0, "max_silence": 1.0, "threshold": 45.0}
TOP = 20
EVAL_ROLES = ("interviewer", "interviewee")
# How a sequence-to-sequence recogniser is asked to decode.
DECODING = {"language": "cs", "verbose": False, "condition_on_previous_text": False, "no_speech_threshold": 0.25, "temperature": 0.0, "beam_size": 5}
