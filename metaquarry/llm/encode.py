"""Token ids of whole texts by the tokenizers library, each distinct word encoded once while a worker remembers it.

Both public tokenizers part a text at white space before anything else, so the ids of a text are those of its words
in turn. word: white space is dropped, so a text is parted at all of it. byte: a word keeps the one space before it,
and only a space or one line end before a visible character is a sure boundary. A text in which that doesn't hold (a special token's
string, odd control characters, runs of spaces) is encoded by the library as a whole. The words that are new in a
batch go to the library together, parted by a special token, beside which it encodes each part by itself.
"""

from __future__ import annotations

import gc
from array import array

import numpy as np

#: Words that a worker remembers, longer ones once they come again; further ones are encoded anew in each step. About 300 bytes each.
REMEMBERED = 500_000
#: Characters of words that are remembered the first time, as most of them come again.
SHORT = 8
#: New words in one call of the library.
AT_ONCE = 20_000
#: Marks that may close a word; the tokenizers part them from the letters before.
CLOSING = ".,;:!?"
#: Characters of text in one step.
STEP = 6_000_000

_KEPT: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """One for each worker process, file and kind."""
    if (path, kind) not in _KEPT:
        _KEPT[path, kind] = Encoder(path, kind)
    return _KEPT[path, kind]


class Known(dict):
    """Ids of the words that are remembered; `fresh` has those of a step's other words."""

    fresh: dict[str, bytes] = {}


class Encoder:
    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        if kind not in ("word", "byte"):
            raise ValueError(f"kind is word or byte, not {kind!r}")
        self.kind = kind
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.mark = "<|endoftext|>"
        self.mark_id = self.special[self.mark]
        self.known = Known()
        self.closing: dict[str, bytes] = {}
        self.seen = bytearray(1 << 22)
        self.edge = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        for piece, i in self.library.get_vocab(with_added_tokens=False).items():
            self.edge[i] = piece.endswith("</w>") if kind == "word" else piece.startswith("\u0120")

    def plain(self, text: str) -> bytes:
        """As the library encodes the whole text."""
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        """As the library encodes a text, without where its tokens stand."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _odd(self, text: str) -> bool:
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f\x85")

    def _learn(self, words: list[str], before: str, into: dict[str, bytes]) -> None:
        """Ids of words that each stand for themselves: a special token between two keeps them apart."""
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            ids = self._ids(self.mark.join([before + w for w in some]))
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) != len(some):
                raise RuntimeError("the tokenizer doesn't keep its special token apart")
            start = 0
            for w, end in zip(some, ends.tolist()):
                into[w] = ids[start:end].tobytes()
                start = end + 1

    def _learn_letters(self, words: list[str], into: dict[str, bytes]) -> None:
        """The same for words of letters alone, quicker: spaces between them, and the ids tell where a word ends or begins."""
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            ids = self._ids(("" if self.kind == "word" else " ") + " ".join(some))
            edges = np.flatnonzero(self.edge[ids])
            ends = edges + 1 if self.kind == "word" else np.append(edges[1:], len(ids))
            if len(ends) != len(some):
                self._learn(some, "" if self.kind == "word" else " ", into)
                continue
            start = 0
            for w, end in zip(some, ends.tolist()):
                into[w] = ids[start:end].tobytes()
                start = end

    def _learn_words(self, words: list[str], into: dict[str, bytes]) -> None:
        """Words, for byte with one space before each: letters, letters with closing marks, and whatever else there is."""
        part, lead, lower = self.library.model.tokenize, "" if self.kind == "word" else "\u0120", self.kind == "word"
        own: dict[str, bytes] = {}
        marked, rest, other = [], [], []
        get = self.known.get

        def letters(c: str) -> None:
            if c.isascii():  # what comes before the model leaves ASCII letters as they are but for case
                own[c] = array("I", [t.id for t in part(c.lower() if lower else lead + c)]).tobytes()
            else:
                own[c] = b""
                other.append(c)

        for w in words:
            if w.isalpha():
                if w not in own:
                    letters(w)
            elif (core := w.rstrip(CLOSING)).isalpha():
                marked.append((w, core))
                if core not in own:
                    if (v := get(core)) is not None:
                        own[core] = v
                    else:
                        letters(core)
            else:
                rest.append(w)
        self._learn_letters(other, own)
        self._learn([m for m in {w[len(c) :] for w, c in marked} if m not in self.closing], "", self.closing)
        into.update((w, own[c] + self.closing[w[len(c) :]]) for w, c in marked)
        into.update((w, own[w]) for w in words if w in own)
        if len(self.closing) > 10_000:
            self.closing.clear()
        self._learn(rest, "" if self.kind == "word" else " ", into)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; null is empty."""
        gc.disable()  # millions of short-lived strings, none of them in a cycle
        try:
            return self._steps(texts)
        finally:
            gc.enable()

    def _steps(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= STEP):
                size += len(texts[end] or "")
                end += 1
            out += self._step(texts[at:end])
            at = end
        return out

    def _words(self, text: str) -> list[str] | None:
        if self._odd(text):
            return None
        if self.kind == "word":
            return text.split()
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def _sure(word: str) -> bool:
        """What begins with a visible character, or with one line end and that: the token before it ends there."""
        at = word[1:2] if word[:1] == "\n" else word[:1]
        return bool(at) and not at.isspace()

    def _step(self, texts: list[str | None]) -> list[bytes]:
        byte = self.kind == "byte"
        known, fresh, first = self.known, set(), set()
        split: list[tuple[str, list[bytes | None], list[str]] | None] = []  # of each text the first word, if byte, the ids of words that are remembered, and the other words
        for t in texts:
            words = self._words(t) if t else []
            if words is None:
                split.append(None)
                continue
            lead = words.pop(0) if byte and words else ""
            ids = list(map(known.get, words))
            new = [w for w, v in zip(words, ids) if v is None]
            first.add(lead)
            fresh.update(new)
            split.append((lead, ids, new))
        odd = {w for w in fresh if not self._sure(w)} if byte else set()
        got: dict[str, bytes] = {}
        self._learn([w for w in fresh if byte and w not in odd and w[0] == "\n"], "", got)
        self._learn_words([w for w in fresh if w not in odd and w not in got], got)
        if len(known) < REMEMBERED:
            seen, mask = self.seen, len(self.seen) - 1
            for w, v in got.items():  # longer words the second time that they are new to a step
                if len(w) <= SHORT or seen[h := hash(w) & mask]:
                    known[w] = v
                else:
                    seen[h] = 1
        known.fresh = got
        begin = {"": b""}
        self._learn([w for w in first if w], "", begin)
        out = []
        for text, parts in zip(texts, split):
            if parts is None or (odd and not odd.isdisjoint(parts[2])):
                out.append(self.plain(text))
                continue
            lead, ids, new = parts
            rest = map(known.fresh.__getitem__, new)
            out.append(begin[lead] + b"".join([next(rest) if v is None else v for v in ids] if new else ids))
        known.fresh = {}
        return out
