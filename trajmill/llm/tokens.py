"""Token ids of public vocabulary files inside tasks: long texts in stretches, one loaded vocabulary per process.

The vocabularies of the `tokenizers` files are run by `tiktoken`, whose merge loop gives the same ids several times
faster: it merges by rank, and in these files the rank of a merge is the id of its result. Texts that the fast way does not cover
go through `tokenizers` itself; tests compare both ways over all code points and all vocabulary entries.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

STRETCH = 1 << 20  # characters; a longer text is encoded in stretches where it has a blank between two letters
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_MARK = "\0"  # closes a word for the merge loop; texts that hold it take the slow way
_KNOWN = 0x180  # code points below it, and common dashes and quotes, take the fast way of vocabularies with word ends


def stretches(text: str, size: int | None = None) -> Iterator[str]:
    """The text in stretches of about ``size`` characters, cut before blanks between ASCII letters.

    No token of the vocabularies used here reaches over such a place, so the stretches' ids are the text's ids. A text
    without such places stays whole.
    """
    first, size = 0, size or STRETCH
    while len(text) - first > size:
        cut = _CUT.search(text, first + size)
        if cut is None:
            break
        yield text[first: cut.start()]
        first = cut.start()
    yield text[first:]


def _symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as character -> byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _raw(token: str, symbols: dict[str, int]) -> bytes:
    return bytes(symbols[c] for c in token)


class WordEnds:
    """A lower-casing BPE vocabulary whose words end with ``</w>`` (word_bpe_49k.json)."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        symbols = _symbols()
        ranks = {}
        for token, number in vocabulary.items():
            if token not in special:
                end = token.endswith("</w>") and token != "</w>"
                ranks[_raw(token.removesuffix("</w>") if end else token, symbols) + (_MARK.encode() if end else b"")] = number
        self.fast = tiktoken.Encoding("words", pat_str=rf"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})
        kinds = {"L": "", "N": "", "Z": "\t\n\v\f\r\x85"}
        for code in range(_KNOWN):
            kind = unicodedata.category(chr(code))[0]
            if kind in kinds:
                kinds[kind] += chr(code)
        letters, digits, blanks = (re.escape(kinds[k]) for k in "LNZ")
        self.pieces = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{letters}{digits}{blanks}{_MARK}]+")
        self.blanks = re.compile(rf"[{blanks}]")
        self.covered = re.compile(rf"[\x01-{chr(_KNOWN - 1)}\u2010-\u201f]*").fullmatch
        self.special = special

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text as the vocabulary file's own pipeline gives them, without added special tokens."""
        parts = [self._stretch(s) for s in stretches(text)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _stretch(self, text: str) -> np.ndarray:
        if not self.covered(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        plain = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().replace(" ", _MARK).replace("\n", _MARK)
        if self.blanks.search(plain):
            plain = self.blanks.sub(_MARK, plain)
        # Runs of letters end at marks; every other piece gets one on both sides. What lies between two marks is a word.
        return np.array(self.fast.encode_ordinary(self.pieces.sub(rf"{_MARK}\g<0>{_MARK}", plain) + _MARK), np.uint32)


class ByteLevel:
    """A byte-level BPE vocabulary (byte_bpe_50k.json); special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        symbols = _symbols()
        ranks = {_raw(t, symbols): i for t, i in content["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}

    def ids(self, text: str) -> list[int]:
        return [i for s in stretches(text) for i in self.fast.encode_ordinary(s)]


class Pieces:
    """A sentencepiece vocabulary with byte fallback (piece_bpe_32k.model), which puts a blank before the text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spell = lambda i: self.model.id_to_piece(i)
        self.bytes = {i: bytes([int(spell(i)[3:-1], 16)]) if self.model.is_byte(i) else spell(i).replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size())}

    def ids(self, text: str) -> list[int]:
        parts = list(stretches(text))  # all but the first begin with the blank that the model puts there itself
        return [i for k, s in enumerate(parts) for i in self.model.encode(s[1:] if k else s, num_threads=1)]


@cache
def word_ends(path: str) -> WordEnds:
    return WordEnds(path)


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)
