"""From raw text to byte-level pieces, as a word-BPE tokenizer file prescribes, with a bounded word memo.

White space never ends up inside a piece and no rule looks across it, so a text's ids are the ids of its
space-separated words one after the other. Each distinct word is therefore split and encoded once and kept
in a memo that is emptied when it holds `MEMO_WORDS` words (memory stays bounded, results do not depend on it).

Words of safe letters are split here; all others go through the file's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import tokenizers

#: Words kept by a Python worker, about 200 MB.
MEMO_WORDS = 1_000_000
#: Words of a group that are looked up together.
GROUP_WORDS = 400_000
SUFFIX = "</w>"
#: Marks that are pieces of their own after a word of letters.
MARKS = frozenset((b".", b",", b"!", b"?", b";", b":"))

# Lower case, in composed form and letters under every Unicode version: normalizing leaves such words as they are.
_safe = re.compile("[!-~à-öø-ÿß]+")
_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^0-9a-zà-öø-ÿß]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_letters = _byte_letters()


def byte_level(piece: str) -> str:
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_letters)


class WordSplitter:
    """Pieces of one word (bytes without ASCII white space)."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {token.content: i for i, token in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def parts(self, word: bytes) -> list[str | int]:
        """Byte-level pieces in order; a special token is given as its id."""
        head, tail = word[:-1], word[-1:]
        if word.isalpha():  # ASCII letters
            return [word.lower().decode()]
        if tail in MARKS and head.isalpha():
            return [head.lower().decode(), tail.decode()]
        text = word.decode()
        if _safe.fullmatch(text) and "<|" not in text:
            return [byte_level(p) for p in _pieces.findall(text.lower())]
        out: list[str | int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out


def words_of(text: bytes) -> list[bytes]:
    """Space-separated words, lower-cased in ASCII unless the text may hold a special token."""
    return text.split() if b"<|" in text else text.lower().split()


class WordEncoder:
    """Packed ids (little-endian unsigned 32-bit) of whole texts, each distinct word encoded once.

    `encode_pieces` gets the distinct pieces of the words not yet known and returns their ids.
    """

    def __init__(self, splitter: WordSplitter, encode_pieces: Callable[[list[str]], list[list[int]]], limit: int = MEMO_WORDS) -> None:
        self.splitter, self.encode_pieces, self.limit = splitter, encode_pieces, limit
        self.memo: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [b"".join(runs) for runs in self.runs(texts)]

    def runs(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """The packed ids of every text, cut at its words."""
        return ([self.memo[w] for w in words] for words in self._known(texts))

    def _known(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """Word lists of the texts, group by group, with all of a group's words in the memo."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size < min(self.limit, GROUP_WORDS)):
                group.append(words_of(texts[at]))
                size += len(group[-1])
                at += 1
            found = set(chain.from_iterable(group))
            fresh = found.difference(self.memo)
            if len(self.memo) + len(fresh) > self.limit and self.memo:
                self.memo.clear()
                fresh = found
            self._learn(fresh)
            yield from group

    def _learn(self, words: set[bytes]) -> None:
        split = {w: self.splitter.parts(w) for w in words}
        pieces = sorted({p for parts in split.values() for p in parts if isinstance(p, str)})
        ids = dict(zip(pieces, (b"".join(i.to_bytes(4, "little") for i in x) for x in self.encode_pieces(pieces))))
        for w, parts in split.items():
            self.memo[w] = b"".join(ids[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts)


class LibraryWords(dict):
    """Packed ids of words by the tokenizers library: its normalizer, pre-tokenizer and model, up to a bound of words."""

    def __init__(self, path: str, wide: bool = True, limit: int = MEMO_WORDS) -> None:
        super().__init__()
        self.splitter, self.code, self.limit = WordSplitter(path), "I" if wide else "H", limit
        self.model = self.splitter.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        head, tail = word[:-1], word[-1:]
        if tail in MARKS and head.isalpha():
            packed = self[head] + self[tail]
        else:
            ids: list[int] = []
            for part in self.splitter.parts(word):
                ids += [t.id for t in self.model.tokenize(part)] if isinstance(part, str) else [part]
            packed = struct.pack(f"<{len(ids)}{self.code}", *ids)
        self[word] = packed
        return packed

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, words_of(text)))
