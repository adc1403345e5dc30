import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from talus.llm import packing

from .common import clashing

FILE = P.path("byte_bpe_50k.json")


def check(pieces, texts, length):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    full = []
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        full.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sorted(full)[1:] == [length] * (len(full) - 1)


def test_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(packing.op10_packing(spark, sf).collect(), texts, 2048)


def test_odd_texts(spark):
    data = [None, "", "a" * 3000, "<|endoftext|> it's", "x y\n\n z  \t", "é\U0001f600", "same", "same", "word " * 3000]
    df = clashing(spark, list(enumerate(data)))
    check(packing.pack(df, FILE, P.PATTERN, length=64).collect(), dict(enumerate(data)), 64)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE, P.PATTERN).collect() == []


def test_hilbert_is_a_curve():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(side, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_equal_texts_are_neighbours(spark):
    df = spark.createDataFrame([(i, ("apple pear " if i % 2 else "zug bahn ") * 40) for i in range(40)], "doc_id long, text string")
    got = packing.pack(df, FILE, P.PATTERN, length=512).collect()
    order = [r.doc_id % 2 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_words_of_any_letters_are_encoded_together():
    """One call for a thousand words of any script; a letter that the tokenizer's pattern knows as none changes nothing."""
    encoder = packing.WordEncoder(FILE)
    alone, calls = encoder.tokenizer, []

    class Counted:
        def encode(self, *a, **k):
            return alone.encode(*a, **k)

        def encode_batch(self, words, **k):
            calls.extend(words)
            return alone.encode_batch(words, **k)

    encoder.tokenizer = Counted()
    ids = lambda words: [np.array(alone.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    words = [f" {a}\u0436{b}\u00e9" for a in "\u0430\u0431\u0432\u0433\u00f6\u00df" for b in "abcd\u4e2d\u6587"]
    assert encoder.encode(words)[0].to_pylist() == ids(words) and not calls
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()][::5]
    words = [" a" + c + "b" for c in letters] + [" ", " a1", " \u0661", "\u0436", " a\u0301", " _", "  ", " a b"]
    assert encoder.encode(words)[0].to_pylist() == ids(words)

    class Unknowing(Counted):  # splits after each z, as if z were no letter
        def encode(self, text, **k):
            return alone.encode(text.replace("z", "z."), **k)

    encoder.tokenizer = Unknowing()
    words = [" az\u0436", " b\u0436"]
    assert encoder.encode(words)[0].to_pylist() == ids(words)
