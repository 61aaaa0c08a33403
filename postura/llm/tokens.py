"""Token ids of whole texts by a public tokenizer file, with a word memo per Python worker.

Both supported tokenizer kinds cut a text at a single space between two non-space characters before they merge
anything, so a text without other spacing at that place is the concatenation of its space-separated parts. Every part
is handed to the ``tokenizers`` library once and remembered; texts with runs of spaces, or spaces at an end, go to the
library whole; where white space is dropped anyway, every ASCII one separates. A part of plain Latin letters with ASCII
marks behind them is split by the tokenizer between the two only, and at a line end between two such, so these go straight to
the library's merge model. Special-token strings inside a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Iterable

from postura.llm.common import by_value

#: Parts remembered per worker and generation; two generations are held, so memory is bounded by twice this.
MEMO_PARTS = 300_000
#: Longer parts are not remembered.
MEMO_CHARS = 48
#: Letters that are composed, and in lower case one letter again, in every version of the character tables.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")
#: White space other than the space and the line end, as the standard library sees it.
_RARE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


#: ASCII white space but the space.
_BREAKS = "\n\t\r\x0b\x0c"


def _separate(text: str) -> bool:
    """No space touches another white space or an end of the text."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _RARE)


def worker_state(name: str, make):
    """An object that lives as long as the Python worker, also when this package travels by value."""
    store = sys.modules.setdefault("_postura_worker", types.ModuleType("_postura_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def worker_slot(name: str, key: object, make):
    """An object for a key that lives until another key takes its slot, so a worker holds one of a kind."""
    slot = worker_state(name, dict)
    if key not in slot:
        slot.clear()
        slot[key] = make()
    return slot[key]


class Encoder:
    """Text to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, lead: str, lower: bool):
        """``lead``: what stands before every part but the first of a text, the space where it belongs to the word.

        ``lower``: the tokenizer works on lower case.
        """
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.lead = Tokenizer.from_file(path), lead
        self.tok.encode_special_tokens = True
        self.lower, self.letters = lower, _byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # without marks, in the tokenizer's case

    def _word(self, word: str) -> bytes:
        """Ids of one unit of the tokenizer's own splitting."""
        if self.lower:
            word = word.lower()
        ids = self.words.get(word)
        if ids is None:
            letters = word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()
            if len(self.words) >= MEMO_PARTS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text (null: empty)."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.lower:
                for mark in _BREAKS:
                    text = text.replace(mark, " ")
                out.append(b"".join(self._parts(text.split(" "))))  # nothing between two spaces is a part without ids
            elif not _separate(text):
                out.extend(self._library([text]))
            else:
                head, *parts = text.split(" ")
                out.append(self._part(head, "") + b"".join(self._parts(parts)))
        return out

    def _part(self, part: str, lead: str) -> bytes:
        m = _WORD.fullmatch(part)
        if m:
            word, marks = m.groups()
            ids = self._word(lead + word)
            return ids + self._word(marks) if marks else ids
        if "\n" in part and not self.lower:
            lines = part.split("\n")
            if all(map(_WORD.fullmatch, lines)):
                return self._word("\n").join([self._part(lines[0], lead), *[self._part(x, "") for x in lines[1:]]])
        return self._library([lead + part])[0]

    def _parts(self, parts: list[str]) -> list[bytes]:
        got = [*map(self.new.get, parts)]
        new, old, lead, i = self.new, self.old, self.lead, -1
        for _ in range(got.count(None)):
            i = got.index(None, i + 1)
            part = parts[i]
            ids = new.get(part) or old.get(part)
            if ids is None:
                ids = self._part(part, lead)
            if len(part) <= MEMO_CHARS:
                new[part] = ids
            got[i] = ids
        if len(new) > MEMO_PARTS:
            self.old, self.new = new, {}
        return got


def _byte_letters() -> dict[int, str]:
    """The published letter of every byte in byte-level vocabularies: printable bytes stand for themselves, the others
    for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def byte_bpe(path: str) -> Encoder:
    """The worker's encoder for a byte-level vocabulary in which the space belongs to the word behind it."""
    return worker_state("byte_bpe_" + path, lambda: Encoder(path, " ", False))


def word_bpe(path: str) -> Encoder:
    """The worker's encoder for a lower-case vocabulary with word ends."""
    return worker_state("word_bpe_" + path, lambda: Encoder(path, "", True))


by_value(__name__)
