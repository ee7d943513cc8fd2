"""Whole texts to token ids by a public tokenizer, with words encoded once per worker.

A text is cut where a run of white space begins.  No token of these tokenizers
crosses such a place, so the ids of the parts, joined, are the ids of the text.
Parts recur: a batch of texts asks for its distinct parts only, and their ids
are kept, by the bytes of the part, in a bounded table per Python worker.  New
parts go through the tokenizers library.  Texts with white space outside ASCII
go through the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from chartloom.llm.shared import WORKER_TABLES, claim_worker, distinct_ranges, lower_ascii, word_bounds

_ASCII_SPACE = " \t\n\x0b\x0c\r"
_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")

_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First bytes of that white space in UTF-8.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

#: Signs that end a word and are ids of their own: no letter, digit, apostrophe or white space.
_SIGNS = ".,;:!?$%&*#@^~|/+=_-()[]{}\"`"

#: Bytes of texts whose parts are looked up together.
CHUNK_BYTES = 2 << 20

#: Parts kept per worker before the table starts anew.
KEEP = 600_000
#: Words kept next to them, for parts that differ from a word by signs.
KEEP_WORDS = 200_000

_encoders: dict[str, Encoder] = {}
WORKER_TABLES.append(_encoders)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        ends = [i for t, i in vocabulary.items() if t.endswith("</w>")]
        #: Word tokenizers mark the end of a word and drop white space; byte-level ones mark the space before it.
        self.drops_space = len(ends) > 1000
        marks = ends if self.drops_space else [i for t, i in vocabulary.items() if t.startswith("Ġ")]
        self.mark = np.zeros(self.size, bool)
        self.mark[marks] = True
        self.parts: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        #: Whether capitals make no difference; then they share their parts.
        self.folds = all(self._encode(x) == self._encode(x.lower()) for x in ("A", "Zq", "OF", "IT'S"))
        self.plain_ascii = array("I").itemsize == 4 and sys.byteorder == "little" and self._agrees()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _agrees(self) -> bool:
        """Whether the model alone gives the tokenizer's ids of some words."""
        some = ["the", "zq", "internationalization", "a"] if self.drops_space else ["The", " zq", " Internationalization", " a"]
        self._learn_ascii(some)
        return all(self.words.pop(w) == self._encode(w) for w in some)

    def _split(self, part: str) -> tuple[str, str, str]:
        """(front, word, signs) of a part made of white space, one run of letters and signs; the word is empty for other parts.

        Word tokenizers drop the front.  For byte-level ones a word takes one
        space in front of it along; a line end in front is an id of its own.
        """
        core = part.rstrip(_SIGNS)
        signs = part[len(core):]
        if self.drops_space:
            word = core.lower() if core.isascii() else core
            return "", word if word.isalpha() else "", signs
        if core[:1] == " " and core[1:].isalpha():
            return "", core, signs
        if core[:1] == "\n" and core[1:].isalpha():
            return "\n", core[1:], signs
        return "", core if core.isalpha() else "", signs

    def _learn_ascii(self, words: list[str]) -> None:
        """Words of ASCII letters are what the model works on, but for the sign of the space before them."""
        split = self.model.tokenize
        for word in words:
            self.words[word] = array("I", [t.id for t in split("Ġ" + word[1:] if word[0] == " " else word)]).tobytes()

    def _learn_words(self, words: list[str], between: str) -> None:
        """Encode words together; the ids of each end at a mark or at the id between them."""
        if self.plain_ascii:
            self._learn_ascii([w for w in words if w.isascii()])
            words = [w for w in words if not w.isascii()]
        own = np.frombuffer(self._encode(between), "<u4") if between.strip(" ") else None
        for i in range(0, len(words), 500):
            some = words[i:i + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            if own is not None:
                at = np.flatnonzero(ids == own[0])
                first, last, n = [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), 4 * len(ids)], len(at) + 1
            else:
                at = np.flatnonzero(self.mark[ids])
                edges = [0, *((at + 1) * 4).tolist()] if self.drops_space else [*(at * 4).tolist(), 4 * len(ids)]
                first, last, n = edges[:-1], edges[1:], len(at)
            if n != len(some):
                self.words.update((w, self._encode(w)) for w in some)
                continue
            raw = ids.tobytes()
            self.words.update(zip(some, map(raw.__getitem__, map(slice, first, last)), strict=True))

    def _tail(self, signs: str) -> bytes:
        if signs not in self.tails:
            self.tails[signs] = self._encode(signs)
        return self.tails[signs]

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of new parts."""
        if len(self.words) > KEEP_WORDS:
            self.words = {}
        split = [self._split(p) for p in parts]
        new = {w for _, w, _ in split if w}.difference(self.words)
        if self.drops_space:
            self._learn_words(list(new), " ")
        else:
            self._learn_words([w for w in new if w[0] == " "], "")
            self._learn_words([w for w in new if w[0] != " "], "\n")
        out = []
        for part, (front, word, signs) in zip(parts, split, strict=True):
            ids = self.words[word] if word else self._encode(part)
            if signs and word:
                ids += self._tail(signs)
            out.append(self._tail(front) + ids if front else ids)
        return out

    def _parts(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first part of each text) of all parts: words, with the white space before them where it counts."""
        begin, end, first = word_bounds(raw, starts)
        if self.drops_space:
            return self._cut_stops(raw, begin, end, first)
        n = np.diff(first)
        begin = np.concatenate([[0], end[:-1]]) if len(end) else begin
        begin[first[:-1][n > 0]] = starts[:-1][n > 0]
        last = np.where(n > 0, end[np.maximum(first[1:] - 1, 0)], starts[:-1]) if len(end) else starts[:-1]
        rest = np.flatnonzero(last < starts[1:])  # white space that ends a text
        if len(rest):
            begin, end = np.insert(begin, first[1:][rest], last[rest]), np.insert(end, first[1:][rest], starts[1:][rest])
            more = np.zeros(len(starts), np.int64)
            more[rest + 1] = 1
            first = first + np.cumsum(more)
        return self._cut_stops(raw, begin, end, first)

    @staticmethod
    def _cut_stops(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A stop or comma behind an ASCII letter is a part of its own; tokens never cross that place either."""
        long_ = np.flatnonzero(end - begin > 1)
        at = long_[_STOP[raw[end[long_] - 1]] & _LETTER[raw[end[long_] - 2]]]
        if not len(at):
            return begin, end, first
        cut = end.copy()
        cut[at] -= 1
        return np.insert(begin, at + 1, cut[at]), np.insert(cut, at + 1, end[at]), first + np.searchsorted(at, first)

    def _known(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        if len(self.parts) > KEEP // 2:  # what recurs comes back from the older half
            self.older, self.parts = self.parts, {}
        found = list(map(self.parts.get, parts))
        gaps = [i for i, x in enumerate(found) if x is None]
        older = [self.older.get(parts[i]) for i in gaps]
        missing = [i for i, x in zip(gaps, older, strict=True) if x is None]
        learned = iter(self._learn([parts[i].decode() for i in missing]))
        for i, x in zip(gaps, older, strict=True):
            found[i] = self.parts[parts[i]] = next(learned) if x is None else x
        return found

    def encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, first id of each text and the end) from UTF-8 bytes and text offsets."""
        whole = raw
        if self.folds and b"<|" not in raw.tobytes():
            raw = lower_ascii(raw)
        begin, end, first = self._parts(raw, starts)
        kind, where = distinct_ranges(raw, begin, end)
        text = raw.tobytes()
        ids = self._known([text[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        n = size[kind]
        after = np.cumsum(n)
        shift = (np.cumsum(size) - size)[kind] - (after - n)
        out = flat[np.repeat(shift, n) + np.arange(after[-1] if len(after) else 0)]
        edges = np.concatenate([[0], after])[first]
        odd = self._odd_texts(whole, starts)
        if odd:
            own = [out[edges[i]:edges[i + 1]] for i in range(len(starts) - 1)]
            for i, text in odd:
                own[i] = np.frombuffer(self._encode(text), "<u4")
            out, edges = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return out, edges

    @staticmethod
    def _odd_texts(raw: np.ndarray, starts: np.ndarray) -> list[tuple[int, str]]:
        """Texts with white space outside ASCII's usual six; found by its first bytes, then by the pattern."""
        at = np.flatnonzero(_ODD_LEAD[raw])
        texts = np.unique(np.searchsorted(starts, at, "right") - 1).tolist()
        found = ((i, raw[starts[i]:starts[i + 1]].tobytes().decode()) for i in texts)
        return [(i, t) for i, t in found if _ODD_SPACE.search(t)]

    def ids(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0].tobytes()


def encoder(name: str) -> Encoder:
    """One encoder per worker and tokenizer."""
    claim_worker("encoding")
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
