import random

import numpy as np
import pytest
import sentencepiece

from tagloom.llm import token_counts
from tests.llm.common import ODD, frame

PATH = token_counts.default_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return token_counts.Pieces(PATH)


def counted(own, texts):
    raw = [t.encode() for t in texts]
    return own.count(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(list(map(len, raw))))).tolist()


def differ(own, library, texts):
    return [t for t, n, ids in zip(texts, counted(own, texts), library.encode(texts, num_threads=1), strict=True) if n != len(ids)]


def test_equals_library_on_blanks_and_special_strings(own, library):
    texts = [" " * n + end for n in range(70) for end in ("", "x", "\n", "the")]
    texts += ["<s>", "</s>", "<unk>", "<0x0A>", "a\x00b", "▁", "▁▁ ▁a", "\r\n", "ﬁ", "é", "é", "　", "", "x" * 3000, "ab" * 500, "\t" * 40]
    assert not differ(own, library, texts)


def test_equals_library_on_random_texts(own, library):
    random.seed(1)
    whole = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    parts = ["'", " ", "  ", "\n", "a", "bc", "é", "1", "٣", "!", "...", " ", "日本", "😀", "in", "er", "the", "<s>", "▁", "​", "x" * 9, " " * 20, "é"]
    letters = "abcdeinorst "
    texts = ["".join(random.choices(whole, k=random.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(random.choices(letters, k=random.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(1, 0xD7FF), random.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(1000)]
    assert not differ(own, library, texts)


def test_equals_library_without_remembered_pieces_and_in_small_arrays(own, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "TOGETHER", 7)
    own.known.clear()
    random.seed(2)
    assert not differ(own, library, ["".join(random.choices("thers in", k=50)) for _ in range(200)])


def test_ranges_that_share_a_hash_are_told_apart(own, library, monkeypatch):
    class Same(token_counts.RangeHash):
        def of(self, start, end):
            return np.zeros(len(start), np.uint64)

    monkeypatch.setattr(token_counts, "RangeHash", Same)
    assert not differ(own, library, ["these are the words of a text", "others here"])


def test_rows(spark, library):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(frame(spark, ODD), PATH).collect()}
    sizes = lambda t: (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096)
    assert got == {(i, *sizes(t)) for i, t in ODD} and token_counts.counts(frame(spark, ODD), PATH).count() == len(ODD)
    assert any(r[3] for r in got) and token_counts.counts(frame(spark, []), PATH).count() == 0


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(Exception):
        token_counts.Pieces(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_equals_library_on_documents(spark, library):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: len(library.encode(r.text or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.query(spark, folder).collect()} == want
