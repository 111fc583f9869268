"""Exact, memoised encoding with the tokenizers library.

Both public vocabularies used here split a text into pre-tokens before byte pairs are merged. The patterns below cut a
text only where a pre-token ends, so a text's ids are its parts' ids in a row, and a worker encodes each different part
once. The vocabulary's special strings are cut out first and have their own ids, as in the library. Results equal
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` of whole texts; tests compare them.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from ._common import held

#: White space, as the vocabularies' own patterns have it, and characters that are sure to be letters, or sure not to be,
#: in any Unicode version.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_OTHERS = r"\x00-\x40\x5b-\x60\x7b-\x7f"
#: Words that carry the blank before them: a run of letters or of stops is a part, anything else goes to the next blank.
LEADING = re.compile(
    rf" ?[{_LETTERS}]+(?=[{_OTHERS}{_WS}]|\Z)|[.,]+(?=[{_WS}]|\Z)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]"
)
#: Words without white space.
DROPPED = re.compile(rf"[{_LETTERS}]+(?=[{_OTHERS}{_WS}]|\Z)|[.,]+(?=[{_WS}]|\Z)|[^{_WS}]+")


def load(path: str):
    """The library's tokenizer of a vocabulary file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def lowered(text: str) -> str:
    """In lower case, where Python and the word-end vocabulary are sure to agree on it: in Latin-1 letters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordMemo:
    """encode_all(texts): for each text its ids as little-endian unsigned bytes; null counts as empty.

    leading_space: True for vocabularies whose words carry the blank before them (byte-level), False for those that
    drop white space and case (word-end). Parts are remembered in two generations of ``limit`` / 2 parts (some 170 bytes
    a part): when the young one is full it becomes the old one, and what is met again moves back to the young one, so
    frequent words are never learned anew.
    """

    def __init__(self, path: str, leading_space: bool, dtype: str = "<u4", limit: int = 900_000):
        self.tokenizer, self.dtype, self.half = load(path), np.dtype(dtype), limit // 2
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: np.array([i], self.dtype).tobytes() for i, t in added.items()}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path} has special strings that take more than themselves")
        by_length = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(map(re.escape, by_length))})") if by_length else None
        # special strings are cut out before parts are made: in a part they can only come from lower-casing, as plain text
        self.tokenizer.encode_special_tokens = True
        self.find, self.leading = (LEADING if leading_space else DROPPED).findall, leading_space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # ids that begin a word with its blank (U+0120 in the byte-level alphabet), or that end a word
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        edges = [i for t, i in vocabulary.items() if (t[0] == "Ġ" if leading_space else t.endswith("</w>"))]
        self.edge[edges] = True

    def parts(self, text: str) -> list[str]:
        return self.find(text if self.leading else lowered(text))

    def learn(self, parts: list[str], run: int = 512) -> None:
        """Words of letters alone are encoded many in a row, and told apart by their first or last ids."""
        known, encode = self.young, self.tokenizer.encode_batch_fast
        if self.leading:
            words = [p for p in parts if p[0] == " " and p[1:].isalpha()]
            rest = [p for p in parts if not (p[0] == " " and p[1:].isalpha())]
        else:
            words, rest = [p for p in parts if p.isalpha()], [p for p in parts if not p.isalpha()]
        runs = [words[a : a + run] for a in range(0, len(words), run)]
        size, between = self.dtype.itemsize, "" if self.leading else " "
        for some, found in zip(runs, encode([between.join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(self.edge[ids]) * size
            if len(cuts) != len(some):  # some word is more than one to the vocabulary
                rest += some
                continue
            raw = ids.tobytes()
            cuts = [*cuts.tolist(), len(raw)] if self.leading else [0, *(cuts + size).tolist()]
            known.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        kind = {2: "H", 4: "I"}[size]
        for part, found in zip(rest, encode(rest, add_special_tokens=False)):
            known[part] = array(kind, found.ids).tobytes()

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts without special strings. Each different part is looked up once in the memo, and after that
        in a small table of these texts alone, which a processor's cache can hold."""
        cut = [self.parts(t) for t in texts]
        need = list(set().union(*cut))
        found = dict(zip(need, map(self.young.get, need)))
        missing = {p for p, v in found.items() if v is None}
        if missing:
            if len(self.young) + len(missing) > self.half:
                self.old, self.young = self.young, {}  # what was found already stays in ``found``
            young, old = self.young, self.old
            known = missing.intersection(old) if old else ()
            young.update((p, old[p]) for p in known)
            new = missing.difference(known)
            if new:
                self.learn(list(new))
            found.update((p, young[p]) for p in missing)
        get = found.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode_all(self, texts: list[str | None], block: int = 512) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), block):
            some = [t or "" for t in texts[at : at + block]]
            split = self.at_special.split if any(s in t for s in self.special for t in some) else None
            if split is None:
                out += self._block(some)
                continue
            pieces = [split(t) for t in some]  # text, special string, text, ...
            ids = iter(self._block([x for p in pieces for x in p[::2]]))
            out += [b"".join(self.special[x] if k % 2 else next(ids) for k, x in enumerate(p)) for p in pieces]
        return out


def memo(path: str, leading_space: bool, dtype: str = "<u4") -> WordMemo:
    """One memo per Python worker; workers are reused between tasks."""
    return held(("tokens", path, leading_space, dtype), lambda: WordMemo(path, leading_space, dtype))


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
