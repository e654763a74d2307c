"""Whole texts to ids with a file of the `tokenizers` library, each distinct word encoded once.

The library encodes about half a megabyte a second here, and nearly all of it is spent on words seen
before. Where a tokenizer's pre-tokenizer never spans white space, a text's ids are those of its words
in order, so a worker keeps the ids of the words it has met (at most `MAX_WORDS`, then it starts anew).
Texts with characters for which that isn't plain (outside Latin letters, or with added tokens) go to the
library whole.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from .common import worker_memory

#: Words a worker remembers; about 100 MB.
MAX_WORDS = 400_000
#: Bytes of Latin-1 that Python and the library may not treat alike: separators, C1 controls, NBSP.
_ODD_BYTES = bytes([*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F, *range(0x80, 0xA1)])
_ODD = re.compile("[^\t-\r\x20-\x7e\xa1-įı-ɏ‐-‧‰-‿€]")


class WordIds(dict):
    """Word to its place in `starts`; a word that's missing is encoded on first use."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [x["content"] for x in spec.get("added_tokens") or [] if x["content"]]
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        self.plain = (
            len(steps) == 2
            and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall if self.plain else None
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.starts = array("I"), array("q", [0])

    def __missing__(self, word: str) -> int:
        pieces = [word] if word.isalpha() else self.pieces(word)
        if len(pieces) == 1 and pieces[0] == word:
            found = [x.id for x in self.model.tokenize(word if word.isascii() else self.bytes_of(word)[0][0])]
        else:
            found = []
            for piece in pieces:
                at = self[piece]
                found += self.ids[self.starts[at]:self.starts[at + 1]]
        self.ids.extend(found)
        self.starts.append(len(self.ids))
        self[word] = at = len(self.starts) - 2
        return at

    def _by_words(self, text: str) -> bool:
        if not self.plain or any(x in text for x in self.added):
            return False
        try:
            b = text.encode("latin-1")
            return len(b.translate(None, _ODD_BYTES)) == len(b)
        except UnicodeEncodeError:
            return _ODD.search(text) is None

    def encode(self, texts: list, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start (one more at the end). A null is empty."""
        if len(self) > MAX_WORDS:
            self.forget()
        places, whole, counts = [], {}, np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self._by_words(text):
                found = np.fromiter(map(self.__getitem__, text.lower().split()), np.int64)
                places.append(found)
                counts[i] = len(found)
            else:
                whole[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
        word = np.concatenate(places) if places else np.zeros(0, np.int64)
        starts, ids = np.array(self.starts, np.int64), np.array(self.ids, np.uint32)
        lengths = (starts[1:] - starts[:-1])[word]
        ends = np.cumsum(lengths)
        flat = ids[np.repeat(starts[word] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        # ids of each text, then the whole ones and the end ids put in their places
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(before)
        for i, x in whole.items():
            sizes[i] = len(x)
        end = 0 if end_id is None else 1
        at = np.concatenate([[0], np.cumsum(sizes + end)])
        out = np.empty(at[-1], np.uint32)
        if end:
            out[at[1:] - 1] = end_id
        n = np.diff(before)
        out[np.repeat(at[:-1] - before[:-1], n) + np.arange(len(flat))] = flat
        for i, x in whole.items():
            out[at[i]:at[i] + len(x)] = x
        return out, at


def word_ids(path: str) -> WordIds:
    """This worker's tokenizer of that file."""
    kept = worker_memory()
    if path not in kept.__dict__:
        setattr(kept, path, WordIds(path))
    return kept.__dict__[path]
