import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from talus.llm import bpe

from .common import clashing

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expect(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_documents_as_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op1_bpe(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {d: expect(library, t) for d, t in texts.items()}
    assert len(got) == len(texts)


def test_odd_texts(spark, library):
    data = [None, "", "a" * 5000, "  \n\n x\t\ty    z", "=" * 3000 + "ab" * 700, "it's I'LL we've 'tis 123456789 \U0001f600\U0001f600 é", "ééé ing ng inging " * 50]
    data += ["thetheinging" * 200, "<|endoftext|>", "\x1c a \x85 b", "same", "same", "\x00\x01", "word " * 20000]
    df = clashing(spark, [(i, t) for i, t in enumerate(data)] + [(None, "no key")])
    got = {r.doc_id: r for r in bpe.encode(df, FILE, P.PATTERN).collect()}
    for i, t in [*enumerate(data), (None, "no key")]:
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expect(library, t), t
        assert r.ids == " ".join(map(str, library.encode_ordinary(t or ""))) and bytes(r.decoded) == (t or "").encode()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), FILE, P.PATTERN).collect() == []


def test_decode_ids(library):
    codec = bpe.Codec(FILE)
    ids = [library.encode_ordinary(x) for x in ("héllo wörld", "", "\U0001f600 x")]
    assert codec.decode(ids) == [library.decode_bytes(x) for x in ids]


def test_long_words_in_windows(library):
    """Words far over a window, random and repetitive: one answer, in time that grows with their length."""
    import random
    import string

    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    words = [pick(string.ascii_lowercase, 100_000), pick(string.ascii_letters, 20_000), pick("ACGT", 5_000), pick("ab", 5_000), "a" * 20_000, "abc" * 5_000, "the" * 500 + pick("xyz", 900) + "q" * 700]
    words += [pick(string.ascii_lowercase, n) for n in range(120, 140)] + [pick("\u00e9\u4e00\U0001f600", 500), "=" * 4_000]
    codec = bpe.Codec(FILE)
    ids, n, raw = codec.encode(words)
    for w, got, k, back in zip(words, ids.to_pylist(), n.to_pylist(), raw.to_pylist()):
        want = library._core_bpe.encode_single_piece(w.encode())
        assert [int(x) for x in got.split(" ")] == want and k == len(want) and back == w.encode()
