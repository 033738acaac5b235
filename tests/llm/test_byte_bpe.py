import hashlib
import random

import numpy as np
import pytest
import tiktoken

import public_tokenizers
from leafmill.llm import byte_bpe as B


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def judge(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


PARTS = [" ", "  ", "\n", " \n", "\t", "a", "Don't", "he'll", "ß", "½", "²", "Ⅷ", "x.", "42", "9a", "!!", "é,", " ", " ", "\x1c", "\x85", "漢字", "😀", "_", "'s", "it's.", "...", "ſ", "<|endoftext|>", "supercalifragilistic"]


def test_words_and_pieces_equal_the_library(ranks, judge):
    split, rng = B.Splitter(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        first, others = split.words(text)
        got = [i for w in (first, *(" " + x for x in others)) for p in split.pieces(w) for i in B.merged_short(p.encode(), ranks)]
        assert got == judge(text), repr(text)


def test_heap_equals_short(ranks):
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdething \xc3\xa9") for _ in range(rng.randint(0, 60)))
        assert B.merged_by_heap(piece, ranks) == B.merged_short(piece, ranks)


@pytest.mark.parametrize("most", [0, 5, 1 << 18])
def test_round_trip_over_dictionary_sizes(make, odd, ranks, judge, most):
    rng = random.Random(3)
    extra = make([(100 + i, "".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(40))) for i in range(20)] + [(200, "z" * 700 + " " + "é" * 300)])
    docs = odd.unionByName(extra)
    want = sorted((str(r.doc_id), judge(r.text or "")) for r in docs.collect())
    encoded = B.encode(docs, ranks, public_tokenizers.PATTERN, most)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
    assert sorted(bytes(r.decoded).decode() for r in B.decode(encoded, ranks).collect()) == sorted(r.text or "" for r in docs.collect())


def test_digests(odd, none, ranks, judge):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(odd, ranks, public_tokenizers.PATTERN).collect())
    want = sorted((str(r.doc_id), len(ids := judge(r.text or "")), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert got == want
    assert B.digests(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_dictionary_keeps_its_bound(make, ranks, monkeypatch):
    monkeypatch.setattr(B, "MOST_COUNT", 3)
    docs = make([(i, " ".join(f"word{k}" for k in range(40))) for i in range(6)])
    found = B.dictionary(docs, public_tokenizers.PATTERN, B.rank_map(ranks), 5)
    assert found.count() == 5


def test_many_pieces_are_merged_at_once(ranks):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abcdeth \xc3\xa9") for _ in range(rng.randint(1, 30))) for _ in range(500)] + [b"aaaaaaaaa", b"\n" * 9, bytes(range(256))]
    assert B.Merges(ranks).merged(pieces) == [np.array(B.merged_by_heap(p, ranks), dtype="<i4").tobytes() for p in pieces]
    assert B.Merges(ranks).merged([]) == []
    few = {b"a": 0, b"b": 1, b"ab": 7, b"bab": 5}  # bab is made only of b and ab, after a rank above its own
    assert B.Merges(few).merged([b"bab", b"abab", b"b"]) == [np.array(B.merged_by_heap(p, few), dtype="<i4").tobytes() for p in (b"bab", b"abab", b"b")]
    with pytest.raises(KeyError):
        B.Merges(few).merged([b"abc"])


def test_no_rare_piece_is_merged_by_itself(make, ranks, monkeypatch):
    """The work on rare pieces is one call for many texts, whose cost does not go with the number of pieces in Python."""
    calls = []
    merged = B.Merges.merged
    monkeypatch.setattr(B.Merges, "merged", lambda self, pieces: calls.append(len(pieces)) or merged(self, pieces))
    import pyarrow as pa

    docs = make([(k, f"rareword{k}x other{k}y") for k in range(200)])
    run = B.encoder(docs, ranks, public_tokenizers.PATTERN, 0)
    out = list(run([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([f"rareword{k}x other{k}y" for k in range(200)])], names=["doc_id", "text"])]))
    assert sum(b.num_rows for b in out) == 200 and len(calls) == 2 and sum(calls) > 300
