import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tagloom.llm import byte_bpe
from tests.llm.common import ODD, frame

PATH = byte_bpe.default_path()


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_reference_on_random_texts(reference):
    random.seed(1)
    parts = ["'", "'s", "'ll", "'re", "'v", " ", "  ", "\n", "\t", "a", "bc", "é", "1", "٣", "!", "...", " ", "日本", "😀", "r", "e", "　", "S", "don't", "\r\n", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(4000)] + ["a" * 3000, "ab" * 2000, " " * 3000, "", "\n" * 500 + "x"]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum(list(map(len, raw))))
    codec = byte_bpe.Codec(PATH)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, starts, before = codec.encode(data, offsets)
    for t, a, b in zip(texts, before, before[1:], strict=False):
        assert ids[a:b].tolist() == reference.encode_ordinary(t), t
    decoded, ends = codec.decode(ids, before)
    assert decoded.tobytes() == b"".join(raw) and (ends == offsets).all()
    assert (np.diff(starts) > 0).all()


def test_odd_rows_round_trip(spark, reference):
    docs = frame(spark, ODD)
    encoded = byte_bpe.encode(docs, PATH)
    found = {(r.doc_id, bytes(r.text)) for r in byte_bpe.decode(encoded, PATH).collect()}
    assert found == {(i, (t or "").encode()) for i, t in ODD}
    digests = byte_bpe.digests(docs, PATH).collect()
    assert len(digests) == len(ODD)
    by_id = {r.doc_id: r for r in digests if r.doc_id in (2, 6, 7)}
    for i, t in ODD:
        if i in by_id:
            ids = reference.encode_ordinary(t)
            assert by_id[i].n_tokens == len(ids)
            assert by_id[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert by_id[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_table(spark):
    assert byte_bpe.digests(frame(spark, []), PATH).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(frame(spark, []), PATH), PATH).count() == 0


def test_pieces_that_share_a_hash_stay_apart(reference, monkeypatch):
    from tests.llm.test_repeats import turned

    texts = [*turned(2048), "some words and some more"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])

    def check():
        own = byte_bpe.Codec(PATH)
        ids, _, before = own.encode(data, offsets)
        decoded, _ = own.decode(ids, before)
        assert decoded.tobytes() == data.tobytes()
        assert [ids[a:b].tolist() for a, b in zip(before, before[1:])] == [reference.encode_ordinary(t) for t in texts]

    check()
    monkeypatch.setattr(byte_bpe.RangeHash, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    check()
