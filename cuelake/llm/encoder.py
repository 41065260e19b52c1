"""Whole texts to token ids with a public tokenizer file, for use inside tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np

# Positions that every pre-tokenizer of the GPT-2 pattern splits at: a single space between two
# characters that are not white space. The space belongs to what follows it.
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_FIRST = "\x00"
# A full stop or comma that may belong to a run of marks: it follows something else than a digit or a
# Latin letter that stays one letter when lowered and composed (all up to U+017F but U+0130).
_MARKS = re.compile(r"[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\s][.,] ")


class Encoder:
    """Encodes texts piece by piece and remembers the ids of pieces.

    Byte-pair tokenizers work inside the pieces that their pre-tokenizer cuts, so encoding pieces
    cut at positions where it always cuts, and joining the ids, gives the ids of the whole text.
    `keeps_spaces` tells the two families apart: byte-level tokenizers put a space in front of the
    following piece; word tokenizers drop white space, so lone marks and (if the tokenizer lowers)
    ASCII capitals need no pieces of their own.

    The memory is emptied when it holds `most_chars` characters, so it stays bounded."""

    def __init__(self, path: str, keeps_spaces: bool, most_chars: int = 6_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces = keeps_spaces
        self.most_chars = most_chars
        self.lowers = not keeps_spaces and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word)}
        self.mark_id, self.mark = next(iter(special.items()), (None, None))
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars = 0
        self.used = 0
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.beside = np.empty(1 << 14, bool)

    def pieces(self, text: str) -> list[str]:
        """Pieces cut at every space. With spaces kept, that is wrong for a text that has a space
        beside white space; `_beside` marks the pieces that show it."""
        if not self.keeps_spaces:
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            if self.lowers and text.isascii() and "<|" not in text:
                text = text.lower()
            # a lone mark behind a letter or digit is a token of its own
            if _MARKS.search(text) is None:
                text = text.replace(". ", " . ").replace(", ", " , ")
            return text.split(" ")
        out = text.split(" ")
        out[0] = _FIRST + out[0]
        return out

    def safe_pieces(self, text: str) -> list[str]:
        out = _SAFE_SPACE.split(text)
        out[0] = _FIRST + out[0]
        return out

    def _beside(self, piece: str) -> bool:
        piece = piece.removeprefix(_FIRST)
        return self.keeps_spaces and (not piece or piece[0].isspace() or piece[-1].isspace())

    def _encode_apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short texts. A tokenizer cuts a text at its special tokens before all else,
        so texts joined by one are encoded apart in a single call, and its id tells where each ends."""
        if self.mark is not None and not any(self.mark in t for t in texts):
            runs = [self.mark.join(texts[k : k + 256]) + self.mark for k in range(0, len(texts), 256)]
            encoded = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
            is_mark = ids == self.mark_id
            ends = np.flatnonzero(is_mark)
            return ids[~is_mark], np.diff(np.concatenate([[-1], ends])) - 1
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter((i for ids in encoded for i in ids), np.uint32, int(lengths.sum())), lengths

    def _learn(self, new: list[str]) -> None:
        if self.keeps_spaces:
            texts = [p[1:] if p[:1] == _FIRST else " " + p for p in new]
        else:
            texts = new
        flat, lengths = self._encode_apart(texts)
        first, n = len(self.slot), len(new)
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
            self.beside = np.concatenate([self.beside, np.empty_like(self.beside)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.beside[first : first + n] = list(map(self._beside, new))
        self.used += len(flat)
        self.slot.update(zip(new, range(first, first + n)))
        self.chars += sum(map(len, new))

    def _slots(self, pieces: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            missing = [pieces[k] for k in unknown.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            slots[unknown] = list(map(self.slot.__getitem__, missing))
        return slots

    def _join(self, slots: np.ndarray) -> np.ndarray:
        lengths = self.lengths[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[slots] - (ends - lengths), lengths) + np.arange(total)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the number of ids of each text."""
        if self.chars > self.most_chars:
            self._forget()
        # a text with the marker character of first pieces is encoded as it is, in one piece
        whole = [k for k, t in enumerate(texts) if _FIRST in t]
        split = [self.pieces("" if _FIRST in t else t) for t in texts]
        slots = self._slots([p for parts in split for p in parts])
        bounds = np.concatenate([[0], np.cumsum([len(parts) for parts in split])])
        odd = np.logical_or.reduceat(self.beside[slots], bounds[:-1]) if self.keeps_spaces else np.zeros(len(texts), bool)
        again = {k: self._join(self._slots(self.safe_pieces(texts[k]))) for k in np.flatnonzero(odd).tolist() if _FIRST not in texts[k]}
        for k, e in zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)):
            again[k] = np.array(e.ids, np.uint32)
        counts = np.add.reduceat(self.lengths[slots], bounds[:-1])
        ids = self._join(slots)
        if again:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k, own in again.items():
                parts[k], counts[k] = own, len(own)
            ids = np.concatenate(parts)
        return ids, counts


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level tokenizers write each byte as: printable Latin-1
    characters stand for themselves, the other bytes take the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(others)}


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """One encoder per file and Python worker."""
    key = (path, keeps_spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_spaces)
    return _ENCODERS[key]


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts and their counts, with an end id behind each text."""
    counts = counts + 1
    closed = np.empty(len(ids) + len(counts), np.uint32)
    ends = np.cumsum(counts) - 1
    inside = np.ones(len(closed), bool)
    inside[ends] = False
    closed[inside], closed[ends] = ids, end_id
    return closed, counts


def in_slices(texts: list[str], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most_chars` characters; a longer text comes alone."""
    start, chars = 0, 0
    for k, t in enumerate(texts):
        if k > start and chars + len(t) > most_chars:
            yield start, k
            start, chars = k, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)
