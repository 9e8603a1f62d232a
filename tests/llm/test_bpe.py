import hashlib
import random
import time

import public_tokenizers as P
import tiktoken
from tests.llm import cases

from tuplewright.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {p: i for i, p in enumerate(bpe.vocabulary(PATH)) if p}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_decoding(spark):
    rng = random.Random(8)
    enc = reference()
    words = [b"", b"a", b" the", "日本語".encode(), b"\x00", bytes(range(40)), b"x" * 300] + ["".join(rng.choices("abcdeéñüß 'θ", k=rng.randint(1, 24))).encode() for _ in range(4000)]
    df = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").repartition(4)
    out = bpe.encode_words(df, PATH)
    out = out.withColumn("back", bpe.decode_ids(out.ids, bpe.piece_array(bpe.vocabulary(PATH))))
    began = time.time()
    got = out.collect()
    print("seconds", time.time() - began)
    assert len(got) == len(words)
    for r in got:
        assert r.ids == enc._encode_single_piece(bytes(r.word)) if r.word else r.ids == []
        assert bytes(r.back) == bytes(r.word)


def test_query(spark, tmp_path):
    enc = reference()
    got = bpe.op10_bpe(spark, cases.stored(spark, tmp_path)).collect()
    assert len(got) == len(cases.rows())
    texts = {r[0]: r[1] or "" for r in cases.rows()}
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids), r.doc_id
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty(spark, tmp_path):
    assert bpe.op10_bpe(spark, cases.stored(spark, tmp_path, [])).count() == 0


def test_splitters_agree_on_every_character():
    import regex

    find, split = regex.compile(P.PATTERN).findall, bpe.splitter(P.PATTERN)
    for a in range(0, 0x110000, 256):
        chars = [chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000]
        for text in (f"{c}x1_ {c}{c} {c}" for c in chars):
            assert split(text) == find(text), hex(ord(text[0]))


def test_long_words_and_a_foreign_decoding(spark):
    rng = random.Random(9)
    enc = reference()
    ranks = bpe.ranks_of(PATH)
    for word in [b"x", b"ab" * 700, "é日".encode() * 400, *("".join(rng.choices("abcdeé", k=rng.randint(2, 40))).encode() for _ in range(500))]:
        assert bpe.merge_by_heap(word, ranks) == enc._encode_single_piece(word)
    began = time.time()
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20)).encode()
    assert b"".join(bpe.vocabulary(PATH)[i] for i in bpe.merge_by_heap(word, ranks)) == word and time.time() - began < 60
    df = spark.createDataFrame([(0, bytearray(b"abc"), None), (0, bytearray(b"abc"), [5, 6])], "shard int, word binary, long_ids array<int>")
    rows = sorted(bpe.encoded_words(df, PATH).collect(), key=lambda r: r.plain is not None)
    assert rows[0].plain is None and bytes(rows[1].plain) == bpe.vocabulary(PATH)[5] + bpe.vocabulary(PATH)[6]
