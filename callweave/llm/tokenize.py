"""Texts cut into units that a tokenizer encodes independently; each distinct unit is merged once.

A vocabulary string that is proved to encode alone as one token needs no merging at all: its units are counted directly.
The proof runs offline, over the vocabulary, when the tokenizer is opened.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from callweave.llm import workers

#: Distinct units that a worker keeps; beyond it, the cache starts again from the proved ones.
CACHED_UNITS = 400_000
SPACED = re.compile(r" +[^ ]*")


class PieceUnits:
    """A sentencepiece BPE model with byte fallback.

    A unit is a run of spaces with what follows it up to the next space. That is exact if no piece holds a space mark
    behind another character and the normaliser changes nothing but the spaces' mark; a line feed may be cut off likewise
    if no piece holds one. Where the vocabulary does not prove this, whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = " ﬁ①  Ａé\tx\n y "
        plain = self.sp.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.separable = plain and not any("▁" in p.lstrip("▁") or ("\n" in p) for p in pieces) and not any(map(self.sp.is_unused, range(len(pieces))))
        self.single = {}
        for i, p in enumerate(pieces):
            key = p[1:]
            if p[:1] == "▁" and key and "▁" not in key and self.sp.encode(key) == [i]:
                self.single[key] = i
        self.dtype = np.dtype("<u2") if len(pieces) <= 1 << 16 else np.dtype("<u4")

    def units(self, text: str) -> list[str]:
        """Keys for encode(): a key led by a space is a unit with all its spaces, one led by a line feed has no space before it, others stand behind one space."""
        if not self.separable:
            return [text] if text else []
        if not text:
            return []
        if text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text:
            return SPACED.findall(" " + text)
        return text.replace("\n", " \n").split(" ")

    def encode(self, key: str) -> list[int]:
        if self.separable and key[0] == " ":
            return self.sp.encode(key[1:]) if len(key) > 1 else [self.sp.piece_to_id("▁")]
        if self.separable and key[0] == "\n":
            return self.sp.encode(key)[1:]  # without the mark of the space that encode() puts first
        return self.sp.encode(key)


class PreTokenUnits:
    """A tokenizers JSON file: the units are its own pre-tokens; a text that holds a special string is encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        self.single = {t: i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if [x.id for x in self.tok.model.tokenize(t)] == [i]}
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def units(self, text: str) -> list:
        if self.special and self.special.search(text) or self.tok.pre_tokenizer is None:
            return [(text,)]
        if self.tok.normalizer:
            text = self.tok.normalizer.normalize_str(text)
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, key) -> list[int]:
        if isinstance(key, tuple):
            return self.tok.encode(key[0], add_special_tokens=False).ids
        return [t.id for t in self.tok.model.tokenize(key)]


class Counts(dict):
    """Unit -> number of tokens."""

    def __init__(self, units):
        self.of, self.base = units, dict.fromkeys(units.single, 1)
        super().__init__(self.base)

    def __missing__(self, key):
        if len(self) > len(self.base) + CACHED_UNITS:
            self.clear()
            self.update(self.base)
        self[key] = n = len(self.of.encode(key))
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.of.units(text)))


class Ids(dict):
    """Unit -> token ids, as bytes of units.dtype."""

    def __init__(self, units):
        self.of = units
        self.base = {k: np.array([i], units.dtype).tobytes() for k, i in units.single.items()}
        super().__init__(self.base)

    def __missing__(self, key):
        if len(self) > len(self.base) + CACHED_UNITS:
            self.clear()
            self.update(self.base)
        self[key] = ids = np.array(self.of.encode(key), self.of.dtype).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.of.units(text)))


@cache
def opened(path: str):
    """The units of a tokenizer file, opened once a process."""
    return PieceUnits(path) if path.endswith(".model") else PreTokenUnits(path)


def counts(path: str) -> Counts:
    return workers.held(("counts", path), lambda: Counts(opened(path)))


def ids(path: str) -> Ids:
    return workers.held(("ids", path), lambda: Ids(opened(path)))
