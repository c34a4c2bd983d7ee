"""Encoding, decoding and token files against the tokenizers library and plain arrays."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import tokenizers

from medley.llm import bpe, sharding, wavelet
from medley.llm.queries import vocabulary

PIECES = (
    "a b the ing A 's 'S 'll 0 12 ! ... é é É ß ẞ İ ı Σ ς ΑΣ 中文 한 ᄒ ᅡ 🙂 👩‍👩‍👧 <|endoftext|> <|ENDOFTEXT|> <| |> "
    "ﬁ Å aaaaaaaaaaaa ffffff ½ ² ٣ Ǆ ǅ"
).split(" ") + [" ", "\n", "\t", "\x00", "\x1c", "\x85", " ", "\xa0"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def test_trie_equals_library_on_random_texts(library):
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(r.choice("abetinghrsolll'!") for _ in range(r.randint(1, 50))) for _ in range(4000)]
    for text, ids in zip(texts, bpe.encoder(vocabulary()).encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_memo_bound_does_not_change_results(library):
    splitter = bpe.WordSplitter(vocabulary())
    small = bpe.WordEncoder(splitter, bpe.TrieEncoder(vocabulary()).encode, limit=5)
    texts = ["one two three four five six seven", "", "two eight nine ten one", "the the the"] * 3
    for text, ids in zip(texts, small.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests_of_edge_rows(docs, edge_rows, sample, library):
    rows = edge_rows + sample[:60]
    got = sorted(map(tuple, bpe.digests(docs(rows), vocabulary()).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs([]), vocabulary()).count() == 0
    full = bpe.encoded(docs(rows[:8]), vocabulary(), with_decoded=True).collect()
    assert {(r["doc_id"], r["decoded"]) for r in full if r["doc_id"] == 4} == {
        (4, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for t in ("one", "another text, same id")
    }


@pytest.mark.parametrize(("bits", "n"), [(1, 0), (1, 1), (3, 7), (5, 512), (5, 1025), (16, 3000), (17, 600)])
def test_wavelet_queries(bits, n):
    r = np.random.default_rng(n)
    tokens = r.integers(0, 2**bits, n)
    m = wavelet.WaveletMatrix.of(tokens, bits)
    m = wavelet.WaveletMatrix.read(n, m.zeros, b"".join(p.tobytes() for p in m.planes), b"".join(x.astype("<u4").tobytes() for x in m.ranks))
    assert m.tokens().tolist() == tokens.tolist()
    for i in r.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == tokens[i]
    for t in {*tokens[:20].tolist(), 0, 2**bits - 1, 2**bits}:
        places = np.flatnonzero(tokens == t)
        assert m.count(t) == len(places)
        assert [m.locate(t, j) for j in range(min(5, len(places)))] == places[:5].tolist()
        assert m.count(t, n // 2) == int((places < n // 2).sum())
        with pytest.raises(IndexError):
            m.locate(t, len(places))


def test_files_hold_all_documents_in_order(spark, docs, edge_rows, sample, library, tmp_path, monkeypatch):
    rows = edge_rows + [(i + 100, t) for i, t in sample[:80]]
    folder = str(tmp_path / "tokens")
    monkeypatch.setattr(wavelet, "BLOCK_TOKENS", 3000)
    wavelet.write_tokens(docs(rows), folder, vocabulary())
    got = wavelet.read_documents(spark, folder).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
        (i, len(x), zlib.crc32(x.tobytes())) for i, xs in ids.items() if i is not None for x in xs
    )
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    every = np.concatenate([x for xs in ids.values() for x in xs])
    asked = [2, int(every[5]), 48_000]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(spark, folder, asked).collect()} == {t: int((every == t).sum()) for t in asked}
    empty = str(tmp_path / "empty")
    wavelet.write_tokens(docs([]), empty, vocabulary())
    assert wavelet.read_documents(spark, empty).count() == 0


def test_permutation_is_exact_and_reversible():
    for n in (1, 2, 3, 5, 64, 1000, 1025):
        p = sharding.permuted(np.arange(n), n, seed=7)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.permuted(p, n, seed=7, forward=False).tolist() == list(range(n))
    assert sharding.permuted(np.arange(1000), 1000, 1).tolist() != sharding.permuted(np.arange(1000), 1000, 2).tolist()


def test_shards(docs, edge_rows, sample):
    rows = edge_rows + [(i + 100, t) for i, t in sample]
    got = sharding.sharded(docs(rows, 5), shards=16).collect()
    again = sharding.sharded(docs(rows, 2), shards=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    for shard in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
        assert len(slots) - len(rows) // 16 in (0, 1)
    for r in got:
        assert sharding.place(r["row_number"], len(rows), 16) == (r["shard"], r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], len(rows), 16) == r["row_number"]
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by_number = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert by_number[0] is None and by_number[1:] == sorted(by_number[1:])
    assert sharding.sharded(docs([]), shards=16).count() == 0


def test_a_worker_keeps_the_memos_of_one_operator():
    from medley.llm import minhash
    from medley.llm.queries import vocabulary

    ahead, back = bpe.coders(vocabulary())
    [runs] = ahead.runs([b"some words here"])
    assert back.text(runs) and ahead.memo and len(back)
    assert len(minhash.shingle_sets([b"some other words"])[0]) == 1
    assert not ahead.memo and not len(back) and minhash._words
    bpe.coders(vocabulary())
    assert not minhash._words
