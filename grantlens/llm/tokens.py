"""Whole-text token ids by the ``tokenizers`` library, with a memo of words.

Both byte-pair tokenizers used here cut a text before a space or newline that
stands alone between visible characters, so the ids of a text are those of
its lines and space-led words one after the other.  Each Python worker keeps
the ids of words it has met, as bytes, and asks the library only for others:
its model where the word is plain letters (the normaliser and the byte
alphabet then work letter by letter, and are taken from the library), its
``encode`` otherwise.  Both also cut between a letter and the signs after it,
so a word that ends in signs is its letters' ids and the signs'.  Most
distinct words of a large corpus are rare: new words go to a small store that
is emptied when full, and those met again there stay.  Texts in which a cut
could be unsafe (other white space, runs of spaces or newlines, unusual
characters) go to ``encode`` whole.  So the ids are always the library's.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Spaces, newlines, and characters that are visible whatever the Unicode version.
_SAFE = re.compile("[ \n!-~¡-ᙿⰀ-⿟ぁ-퟿]*")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: Signs that neither join a letter before them nor begin a special token.
_SIGNS = ".,;:!?#$%&*"
#: Longer words (encoded data, say) are not kept, so that a store of so many words has a bounded size.
_LONG = 64
_ENCODERS: dict[tuple[str, int, str], WordMemo] = {}


class _Run(Exception):
    """A space or newline does not stand alone."""


class _Other(Exception):
    """A word has characters beside the plain letters."""


class _Letters(dict):
    """Code point of a letter -> its text in the model's alphabet, for ``str.translate``."""

    def __missing__(self, point: int) -> str:
        raise _Other


class _Words(dict):
    """word -> ids of ``lead + word``: words that were met twice stay while there is room (two thirds of ``entries``),
    others until ``new`` is full."""

    def __init__(self, memo: WordMemo, lead: str, entries: int):
        super().__init__()
        self.memo, self.lead, self.new = memo, lead, {}
        self.room, self.new_room = entries - entries // 3, entries // 3

    def __missing__(self, word: str) -> bytes:
        new = self.new
        ids = new.get(word)
        if ids is not None:
            if len(self) < self.room:
                self[word] = ids
                del new[word]
            return ids
        if not word:
            raise _Run
        memo = self.memo
        if not memo.by_letter:
            ids = memo.ask(self.lead + word)
        else:
            bare = word.rstrip(_SIGNS)
            if len(bare) < len(word) and bare[-1:] in memo.plain:
                known = bare in self
                ids = self[bare] + memo.ends[word[len(bare):]]
                if not known:  # the letters are new: with these signs they may be rarer still
                    return ids
            else:
                try:
                    ids = memo.letters(self.lead, word)
                except _Other:
                    ids = memo.ask(self.lead + word)
        if len(word) <= _LONG:
            if len(new) >= self.new_room:
                new.clear()
            new[word] = ids
        return ids


class _Ends(dict):
    """Ids of the signs that end a word."""

    def __init__(self, memo: WordMemo):
        super().__init__()
        self.memo = memo

    def __missing__(self, text: str) -> bytes:
        ids = self.memo.ask(text)
        if len(text) <= _LONG and len(self) < 10_000:
            self[text] = ids
        return ids


class WordMemo:
    """``encode(texts)`` gives each text's ids as little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str, entries: int, dtype: str = "<u4"):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError(f"ids of {path} do not fit {dtype}")
        self.code = {"<u2": "H", "<u4": "I"}[dtype] if sys.byteorder == "little" else None
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        normal = self.library.normalizer
        one = lambda c: alphabet.pre_tokenize_str(normal.normalize_str(c) if normal else c)[0][0]
        self.table, self.plain = _Letters((ord(c), one(c)) for c in _LETTERS), frozenset(_LETTERS)
        self.tokenize = self.library.model.tokenize
        self.space = alphabet.pre_tokenize_str(" ")[0][0]
        self.by_letter = False
        self.ends = _Ends(self)
        self.newline = self.ask("\n")
        # the way by letters is taken only where it gives what encode gives, with the space kept or dropped
        samples = ["a", "The", "été", "ÀÖØÿß", "straße", "Internationalization", "x" * 40]
        for space in (self.space, ""):
            self.space = space
            if all(self.letters(lead, w) == self.ask(lead + w) for w in samples for lead in ("", " ")):
                self.by_letter = True
                break
        self.led, self.first = _Words(self, " ", entries), _Words(self, "", entries // 8)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def ask(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def letters(self, lead: str, word: str) -> bytes:
        text = word.translate(self.table)
        return array(self.code, [t.id for t in self.tokenize(self.space + text if lead else text)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        led, first, whole = self.led.__getitem__, self.first.__getitem__, []
        for i, text in enumerate(texts):
            try:
                if _SAFE.fullmatch(text) is None:
                    raise _Run
                lines = []
                for line in text.split("\n"):
                    words = line.split(" ")
                    lines.append(first(words[0]) + b"".join(map(led, words[1:])))
                out[i] = self.newline.join(lines)
            except _Run:
                whole.append(i)
        found = self.library.encode_batch([texts[i] for i in whole], add_special_tokens=False)
        for i, e in zip(whole, found):
            out[i] = self._bytes(e.ids)
        return out


def encoder(path: str, entries: int = 1_000_000, dtype: str = "<u4") -> WordMemo:
    """The worker's encoder for a vocabulary file (kept between batches and tasks)."""
    key = (path, entries, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordMemo(path, entries, dtype)
    return _ENCODERS[key]


def id_dtype(path: str) -> str:
    """The smallest of the unsigned types that holds the vocabulary's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
