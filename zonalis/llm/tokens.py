"""Exact encoding with the tokenizers library, a batch of texts at a time.

Texts are cut before every space that follows a non-space; no pre-token of the supported files and no added token spans
such a cut, so the ids of the pieces, joined, are the ids of the text. The cuts are found on the UTF-8 bytes of a whole
batch; Arrow numbers its distinct pieces, each is encoded once, and the ids of all are gathered by number. Pieces recur
between batches too, so each worker keeps the ids of those it has met, up to a fixed number of them.

A piece that holds the string of an added token (such as <|endoftext|>) goes through the library's own matching, so the
ids are those of encode(text, add_special_tokens=False), which maps such a string to the token's id.
"""

from __future__ import annotations

import os
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import chunks, text_buffers

KEEP, CHUNK, PIECES = 300_000, 1 << 22, 1 << 20
STOPS = '.,;:!?)"'


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters for bytes, by its rule: printable bytes stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


LETTERS = byte_letters()
STOP, ALNUM, LETTER = (np.isin(np.arange(256), [ord(c) for c in kind]) for kind in (STOPS, string.ascii_letters + string.digits, string.ascii_letters))


if sys.byteorder != "little":
    raise ImportError("ids are laid out for little-endian machines")


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte offsets, the rows' own included, at which the texts are cut.

    Before a space behind a character that is no white space; the blanks of Unicode outside ASCII are told by their two or
    three bytes. Between a letter or digit, ASCII or two bytes from C3 on, and one of STOPS. Between a single line feed,
    behind a printable ASCII character, and an ASCII letter. Both pre-tokenizers end a pre-token there or drop the blank.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero(raw[1:] == 32) + 1
    if len(at):
        one = raw[at - 1]
        blank = (one <= 32) | (one == 127)
        wide = np.flatnonzero(one >= 128)  # a lead byte and what it leads stand before, for texts are whole
        x, y, z = one[wide], raw[at[wide] - 2], raw[np.maximum(at[wide] - 3, 0)]
        two = (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
        three = (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
        three |= (z == 0xE2) & (y == 0x81) & (x == 0x9F) | (z == 0xE3) & (y == 0x80) & (x == 0x80) | (z == 0xE1) & (y == 0x9A) & (x == 0x80)
        blank[wide] = two | three
        cut[at[~blank]] = True
    at = np.flatnonzero(STOP[raw[1:]]) + 1
    if len(at):
        one = raw[at - 1]
        two = np.where(at > 1, raw[at - 2], 0)
        cut[at[ALNUM[one] | (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)]] = True
    at = np.flatnonzero(raw[1 : n - 1] == 10) + 1
    if len(at):
        cut[at[(raw[at - 1] > 32) & (raw[at - 1] < 127) & LETTER[raw[at + 1]]] + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class Memo(dict):
    """Piece to its little-endian uint32 ids, as bytes. When it holds KEEP pieces they become the older ones, and a piece
    met again moves back, so the common ones stay; at most twice KEEP are held.

    A new piece goes through the tokenizer's own normaliser, pre-tokenizer and model; a word of Latin letters alone, which
    is one pre-token, goes to the model directly.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model.tokenize
        self.model_size = tokenizer.get_vocab_size()
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if any(" " in t or any(c in STOPS + "\n" for c in t) for t in self.added):
            raise ValueError("a cut could part the string of an added token")
        self.pre_tokens = tokenizer.pre_tokenizer.pre_tokenize_str
        self.normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.older: dict[str, bytes] = {}
        probe = [w for w, _ in self.pre_tokens(self.normal(" Ab,"))]
        #: What the model sees for " Ab": with the space, or lower-cased without it; None: some other scheme.
        self.head = {"\u0120Ab": LETTERS[32], "ab": ""}.get(probe[0]) if probe[1:] == [","] else None

    def pre_token(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model(word)]).tobytes()

    def fresh(self, piece: str) -> bytes:
        core = piece[1:] if piece[:1] == " " else piece
        if core.isalpha() and self.head is not None:
            word = core if self.head else core.lower()
            if word.isascii():
                return self.pre_token(word if core is piece else self.head + word)
            if max(core) < "\u0130":
                word = word.encode().decode("latin-1").translate(LETTERS)
                return self.pre_token(word if core is piece else self.head + word)
        if any(t in piece for t in self.added):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return b"".join([self.pre_token(w) for w, _ in self.pre_tokens(self.normal(piece))])

    def of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those not met before, or long, are encoded."""
        known = [self.get(p) for p in pieces]
        for i, out in enumerate(known):
            if out is None:
                p = pieces[i]
                out = self.older.get(p)
                known[i] = out = self.fresh(p) if out is None else out
                if len(p) <= 64:
                    if len(self) >= KEEP:
                        self.older = dict(self)
                        self.clear()
                    self[p] = out
        return known

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, joined, and the len+1 offsets of the texts among them."""
        at = cuts(raw, offsets)
        parts, to = [np.zeros(0, np.uint32)], np.zeros(len(at), np.int64)
        for first in range(0, len(at) - 1, PIECES):
            own = at[first : first + PIECES + 1]
            held = pa.py_buffer(raw[own[0] : own[-1]])
            pieces = pa.StringArray.from_buffers(len(own) - 1, pa.py_buffer((own - own[0]).astype(np.int32)), held).dictionary_encode()
            known = pa.array(self.of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
            _, ends, ids = known.take(pieces.indices).buffers()
            end = np.frombuffer(ends, np.int32)[1 : len(own)] // 4
            parts.append(np.frombuffer(ids, "<u4")[: end[-1]])
            to[first + 1 : first + len(own)] = end + to[first]
        return np.concatenate(parts), to[np.searchsorted(at, offsets)]

    def encode(self, text: str) -> bytes:
        """Little-endian uint32 ids of one whole text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tobytes()

    def encode_column(self, column: pa.Array, end: int) -> Iterator[np.ndarray]:
        """The ids of every row, then `end`, row by row; a null row is `end` alone. Works in chunks of about CHUNK bytes."""
        raw, offsets = text_buffers(column)
        for a, b in chunks(offsets, CHUNK):
            ids, at = self.encode_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids = np.insert(ids, at[1:], np.uint32(end))
            at = at + np.arange(b - a + 1)
            for i in range(b - a):
                yield ids[at[i] : at[i + 1]]


_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _memos:
        _memos.clear()
        _memos[path] = Memo(path)
    return _memos[path]
