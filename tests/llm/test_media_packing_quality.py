import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tests.llm import cases
from tokenizers import Tokenizer

from tuplewright.llm import media, packing, quality


def test_media_round_trip(spark, tmp_path):
    got = media.op2_media(spark, cases.stored(spark, tmp_path)).collect()
    assert len(got) == len(cases.rows())
    texts = {r[0]: r[1] for r in cases.rows()}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = media.padded(data)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and len(payload) % 192 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        file = media.encode([data])[0]
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_media_all_differences_and_stuffing():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 192 * 50, dtype=np.uint8).tobytes(), bytes([0, 255] * 96 * 3), b"\xff" * 192):
        samples, counts, lengths, micros = media.decode(media.encode([data]))
        assert samples.tobytes() == data and counts == [len(data) // 192] and lengths == [len(data)] and micros == [40000]


def test_shots_and_clips(spark):
    calm, loud = b"a" * 192 * 6, b"~ \x00z" * 48 * 5
    df = spark.createDataFrame([(1, calm.decode() + loud.decode()), (2, None)], "doc_id long, text string")
    got = sorted(media.clips(media.encode_media(df)).collect())
    assert [tuple(r) for r in got] == [(1, 0, 0, 6, 0, 240), (1, 1, 6, 5, 240, 440), (2, 0, 0, 1, 0, 40)]


def naive_first_fit(lengths, capacity):
    free, out = [], []
    for n in lengths:
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        free += [capacity] * (k == len(free))
        out.append((k, capacity - free[k]))
        free[k] -= n
    return out


def test_first_fit_equals_the_plain_search():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 300):
        lengths = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
        assert list(zip(*packing.first_fit(lengths, 100), strict=True)) == naive_first_fit(lengths, 100)


def test_packing_holds_every_id_once(spark, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = cases.stored(spark, tmp_path)
    assert 50256 in t.encode("a <|endoftext|> b", add_special_tokens=False).ids  # the library's default: an added token's string is that token
    got = packing.op3_packing(spark, folder).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    counts = defaultdict(int)
    for row in cases.rows():
        counts[row[0]] += 1
    for doc, text in {r[0]: r[1] for r in cases.rows()}.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(a, min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc]) == sorted(want * counts[doc])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g in set(grams) if grams.count(g) > 1}
    hit = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_quality_against_brute_force(spark, tmp_path):
    texts = {r[0]: r[1] if r[1] != cases.LONG else cases.LONG[:9000] for r in cases.rows()}
    given = [(r[0], texts[r[0]], *r[2:]) for r in cases.rows()]
    got = quality.op9_host_rules(spark, cases.stored(spark, tmp_path, given)).collect()
    assert len(got) == len(given)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept is not None and not (r.kept and r.base_failed)


def test_bad_host_goes(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "# " * 30 if i % 3 == 0 else good, "bad" if i % 3 == 0 or i < 4 else f"h{i % 5}") for i in range(90)]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1].kept and not got[1].base_failed and got[40].kept and got[1].host_rate > 0.5 > got[40].host_rate


def test_empty_tables(spark, tmp_path):
    folder = cases.stored(spark, tmp_path, [])
    for f in (media.op2_media, packing.op3_packing, quality.op9_host_rules):
        assert f(spark, folder).count() == 0


def test_hosts_with_clashing_columns_and_no_name(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "# " * 30 if i % 3 else good, None if i % 2 else "s", 7) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _host int")
    ruled = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    left = {r.doc_id: r._host for r in quality.kept(docs).collect()}
    assert len(ruled) == 60 and set(left) == {i for i, r in ruled.items() if r.kept} and set(left.values()) <= {7}
