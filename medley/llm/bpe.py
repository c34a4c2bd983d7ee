"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

For byte-pair merges the encoding of a prefix is fixed by its last token alone: cut that token off and what
is left is the encoding of the shorter prefix. Exactly one vocabulary token fits a prefix's end so that it
stands next to the last token of the shorter prefix without merging across the seam. Sorted words are the
trie in depth-first order; the walk keeps the last token of every prefix on the current path, so a prefix
shared by many words is computed once, and an encoding is read off by walking the last tokens back.

Whether two neighbours stay apart follows from the merge ranks: the tokens that touch the seam over time are
the right-most parts of the left token and the left-most parts of the right one, each alive from its own
rank to the rank of the merge that takes it up. They merge across the seam if a pair alive at the same time
has a rule.

Defined results: null and empty texts have no ids and decode to the empty text; white space gives no ids;
strings of special tokens give their ids; equal texts and ids give equal rows; an empty table gives an empty
table; other columns are ignored. Texts are encoded whole; memory is bounded by the word memo and a batch.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import batches, only, utf8
from medley.llm.wordpieces import MEMO_WORDS, SUFFIX, WordEncoder, WordSplitter

END = float("inf")


class TrieEncoder:
    """Ids of byte-level pieces under the merges of a word-BPE file."""

    def __init__(self, path: str) -> None:
        with open(path) as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rule: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rule[left, right] = rank
            if whole not in self.made_of:
                self.made_of[whole], self.born[whole] = (left, right), rank
        self.width = {i: len(t.removesuffix(SUFFIX)) for t, i in self.ids.items()}
        self.widest = max(self.width.values())
        self._apart: dict[tuple[int, int], bool] = {}
        self._real: dict[int, bool] = {}

    def _edge(self, token: int, side: int, until: float = END) -> list[tuple[int, float, float]]:
        """(part, born, taken up) along one outer edge of a token, from the whole token inwards."""
        out = []
        while True:
            born = self.born.get(token, -1)
            out.append((token, born, until))
            if token not in self.made_of:
                return out
            until, token = born, self.made_of[token][side]

    def _first_merge(self, left: int, right: int) -> tuple[float, tuple[int, int] | None]:
        """When, and as which pair, two neighbours merge across their seam."""
        found: tuple[float, tuple[int, int] | None] = (END, None)
        for a, a_born, a_until in self._edge(left, 1):
            for b, b_born, b_until in self._edge(right, 0):
                rank = self.rule.get((a, b))
                if rank is None:
                    continue
                at = max(rank, a_born, b_born)
                # Of merges with one rank the left one goes first: it takes `a` away, or `b` before its right neighbour.
                if at < a_until and at <= b_until and at < found[0]:
                    found = (at, (a, b))
        return found

    def apart(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            known = self._apart[key] = self._first_merge(left, right)[1] is None
        return known

    def real(self, token: int) -> bool:
        """Whether the merges turn the token's own string into the token."""
        known = self._real.get(token)
        if known is None:
            pair = self.made_of.get(token)
            known = pair is None or (self.real(pair[0]) and self.real(pair[1]) and self._first_merge(*pair)[1] == pair)
            self._real[token] = known
        return known

    def _last(self, piece: str, end: int, suffix: str, path: list[int]) -> int:
        """Last token of piece[:end] (+ suffix), given those of all shorter prefixes."""
        for start in range(max(0, end - self.widest), end):
            token = self.ids.get(piece[start:end] + suffix)
            if token is not None and self.real(token) and (not start or self.apart(path[start], token)):
                return token
        raise ValueError(f"no token ends {piece!r}")

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of the pieces, which must be sorted."""
        out, path, before = [], [-1], ""
        for piece in pieces:
            last = len(piece) - 1  # the final symbol carries the suffix and is a leaf
            shared, most = 0, min(last, len(path) - 1)
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, last + 1):
                path.append(self._last(piece, end, "", path))
            ids, at = [self._last(piece, last + 1, SUFFIX, path)], last + 1
            while (at := at - self.width[ids[-1]]) > 0:
                ids.append(path[at])
            out.append(ids[::-1])
            before = piece
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder with its memo for each Python worker."""
    trie = TrieEncoder(path)
    made = WordEncoder(WordSplitter(path), trie.encode)
    made.memos = [made.memo, trie._apart]
    return made


class Decoder(dict):
    """Decoded texts of runs of packed ids, remembered up to a bound. The file has no decoder: tokens are joined by spaces."""

    def __init__(self, path: str) -> None:
        names = {i: t for t, i in WordSplitter(path).tokenizer.get_vocab(with_added_tokens=True).items()}
        self.tokens = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        text = self[run] = self.decode(np.frombuffer(run, "<u4"))
        return text

    def text(self, runs: list[bytes]) -> bytes:
        return b" ".join([self[r] for r in runs if r])


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def coders(path: str) -> tuple[WordEncoder, Decoder]:
    """Encoder and decoder, whose memos take the place of another operator's."""
    only(*encoder(path).memos, decoder(path))
    return encoder(path), decoder(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and, on request, the decoded text of every document."""
    fields = [("doc_id", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.string())] * with_decoded
    schema = pa.schema(fields)

    def rows(batch: pa.RecordBatch) -> dict:
        ids = coders(path)[0].encode(utf8(batch, "text"))
        out = {"doc_id": batch.column("doc_id"), "ids": ids}
        if with_decoded:
            out["decoded"] = [decoder(path).decode(np.frombuffer(i, "<u4")).decode() for i in ids]
        return out

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(batches(schema, rows), "doc_id long, ids binary" + ", decoded string" * with_decoded)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the sha256 of ids and decoded text, made where the ids are so that neither leaves its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(batch: pa.RecordBatch) -> dict:
        counts, ids, texts = [], [], []
        ahead, back = coders(path)
        for runs in ahead.runs(utf8(batch, "text")):
            packed = b"".join(runs)
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(back.text(runs)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": texts}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(batches(schema, rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
