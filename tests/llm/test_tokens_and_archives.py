import hashlib
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sarani.llm.bpe import Lexicon, Vocabulary, bpe_decode, bpe_encode, compile_lexicon, encode_texts
from sarani.llm.warc import gzip_member, read_warc, record_bytes, salvage, sha1_base32, warc_round_trip, write_warc
from tests_llm_helpers import by_id

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


def load(entries):
    path = tempfile.mkdtemp() + "/lexicon.bin"
    Lexicon.save(compile_lexicon(entries), path)
    return Lexicon(path)


def test_transducer_finds_its_words_and_shares_suffixes():
    rng = random.Random(1)
    entries = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))): (i, i + 1) for i in range(800)}
    known = load(entries)
    words = list(entries) + ["", "zz", "a" * 50, "abx", "日本"]
    for w, place in zip(words, known.places(words)):
        got = tuple(known.ids[known.first[place] : known.first[place + 1]]) if place >= 0 else None
        assert got == entries.get(w)
    endings = load({f"{a}{b}ation": (1,) for a in "abcdefgh" for b in "xyz"})
    assert len(endings.ends) == 1 + 1 + 1 + 5 + 1  # one path for the shared ending, and the dead state
    assert (load({}).places(["a", ""]) == -1).all()


def test_encoding_equals_the_library(vocab, library):
    rng = random.Random(5)
    pool = list("abcdefg hijk  lmnop' qrs'tuv WXYZÀÉßñ 0123456789²½ªº\t\n\r\x0b\x0c\x00\x1c\x1f\x7f\x85\xa0!?.,-–—’“”…İıΣσςÅK日本語é̀한글ﬁ€😀👍🏽‍ 　١٢xƁƏȺ")
    pool += ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "'s", "<|", "the ", "and "]
    texts = ["".join(rng.choices(pool, k=rng.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "a" * 20000, "!" * 3000, "ab" * 5000, *(chr(c) for c in range(0x250)), *("a" + chr(c) + "b" for c in range(0x250))]
    known = load({w: vocab._merge(w) for t in texts[:500] for w in vocab.words(t) if w not in vocab.special})
    for lexicon in (known, load({})):
        for t, ids, decoded in zip(texts, *encode_texts(texts, vocab, lexicon, True)):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want, t
            assert decoded == library.decode(want, skip_special_tokens=False)


def test_words_merged_together_equal_words_merged_alone(vocab):
    rng = random.Random(8)
    pool = "abcdefghijklmnopqrstuvwxyz'0123é日€😀!?"
    words = ["".join(rng.choices(pool, k=rng.randrange(1, 70))) for _ in range(3000)] + ["<|endoftext|>", "a" * 64, "a" * 65, "é" * 32, "é" * 33]
    assert [ids.tolist() for ids in vocab.merge_all(words)] == [list(vocab.merge(w)) for w in words] and vocab.merge_all([]) == []


@pytest.mark.parametrize("size", [0, 5, 5000])
def test_bpe_job(nasty, library, size):
    encoded = bpe_encode(nasty, PATH, lexicon_words=size)
    found = by_id(encoded)
    decoded = by_id(bpe_decode(encoded, PATH))
    for r in nasty.select("doc_id", "text").collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        f = found[r.doc_id]
        assert (f.n_tokens, f.ids, decoded[r.doc_id].text) == (len(want), want, text)
        assert f.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert f.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_empty_tables_and_repeated_rows(spark, empty):
    assert bpe_encode(empty, PATH).count() == 0
    rows = [(None, "One"), (1, "one"), (1, "one"), (2, None)]
    found = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 0)]


def records(n=6):
    return [record_bytes(str(i), "response", f"http://x/{i}", b"<p>%d</p>" % i * (5 * i + 1), None) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_logs_gaps_and_recovers_later_records(packed):
    parts = [gzip_member(r) if packed else r for r in records()]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    whole = b"".join(parts)
    assert [(r["start"], r["end"], r["record_id"]) for r in salvage(whole + b"\0")] == [(a, b, str(i)) for i, (a, b) in enumerate(zip([0, *ends], ends))]
    bad = bytearray(whole)
    for at in range(ends[2] - 12, ends[2] - 8):
        bad[at] ^= 0x5A  # inside the payload of record 2
    found = list(salvage(bytes(bad)))
    assert [r["record_id"] for r in found if "gap" not in r] == ["0", "1", "3", "4", "5"]
    assert [(r["start"], r["end"]) for r in found if "gap" in r] == [(ends[1], ends[2])]
    cut = whole[7 : ends[4] + 9]  # the first record lacks its head, the last its tail
    found = list(salvage(cut))
    assert [r["record_id"] for r in found if "gap" not in r] == ["1", "2", "3", "4"]
    assert [(r["start"], r["end"]) for r in found if "gap" in r] == [(0, ends[0] - 7), (ends[4] - 7, len(cut))]
    junk = b"junk WARC/1.0 junk \x1f\x8b\x08 junk"
    found = list(salvage(parts[0] + junk + parts[1]))
    assert [r.get("record_id", "gap") for r in found] == ["0", "gap", "1"]
    assert list(salvage(b"")) == [] and [r["gap"] for r in salvage(b"nothing")] == ["no version line"]


@pytest.mark.parametrize("packed", [True, False])
def test_records_with_long_urls_are_no_gaps(packed):
    urls = ["data:," + "x" * 100_000, "u", "y WARC/1.1 " * 10_000, "z" * 3_000_000]
    plain = [record_bytes(str(i), "response", u, b"page", None) for i, u in enumerate(urls)]
    found = list(salvage(b"".join(gzip_member(r) if packed else r for r in plain)))
    assert [(r["record_id"], r["target_uri"]) for r in found] == [(str(i), u.strip()) for i, u in enumerate(urls)]
    cut = plain[0][:90_000] + b"\r\n" + plain[1]  # a header that lost its end does not take in the next record
    assert [r.get("record_id", "gap") for r in salvage(cut)] == ["gap", "1"]


def test_warc_round_trip_of_a_long_url(spark):
    rows = [(1, "u" * 100_000, "same"), (2, "v" * 100_000, "same"), (3, "w", "other")]
    found = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]


def test_reader_quarantines_a_broken_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(40)], "page_id long, url string, html string")
    write_warc(pages.coalesce(1), f"{tmp_path}/a")
    file = next((tmp_path / "a").glob("part-*"))
    data = bytearray(file.read_bytes())
    data[data.index(b"\x1f\x8b\x08", len(data) // 2) + 60] ^= 255  # inside a member, not its header
    file.write_bytes(bytes(data))
    next((tmp_path / "a").glob(".part-*.crc")).unlink()
    found = read_warc(spark, f"{tmp_path}/a").collect()
    assert len([r for r in found if r.gap is None]) == 39 and len([r for r in found if r.gap]) == 1
    assert all(r.payload == f"page {r.record_id}".encode() for r in found if r.gap is None)


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    html = [None, "", "aaa", "aaa", "long text", "long text", "é" * 3000, "WARC/1.1\r\n\r\n", "x\r\n\r\ny\n", "long text", "\x1f\x8b\x08 \0"]
    rows = [(i, None if i == 3 else f"http://x\n/{i}", h, "clash", "clash") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to string")
    found = {r.page_id: r for r in warc_round_trip(pages, least=least).collect()}
    assert len(found) == len(rows)
    for i, h in enumerate(html):
        data = (h or "").encode()
        last = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
        copy = len(data) >= least and last != i
        assert tuple(found[i]) == (i, len(data), sha1_base32(data), "revisit" if copy else "response", last if copy else None)


def test_warc_of_repeated_and_null_ids_with_other_payloads(spark):
    """Rows that share an id but not the payload, against a plain version."""
    rng = random.Random(6)
    rows = [(1, "u", "aaa"), (1, "u", "bbb"), (2, "u", "aaa"), (3, "u", "bbb")]
    rows += [(rng.choice([None, *range(10, 30)]), "u", rng.choice([None, "", "x", "yy", "z" * 50, f"own {i}"])) for i in range(150)]
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        last = largest.get(h or "")
        copy = i is not None and i != last
        want.append((i, len(h or ""), sha1_base32((h or "").encode()), "revisit" if copy else "response", last if copy else None))
    found = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("compress", [True, False])
def test_archives_hold_their_records_and_no_other_byte(spark, tmp_path, compress):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}" * 9) for i in range(40)], "page_id long, url string, html string")
    write_warc(pages.coalesce(1), f"{tmp_path}/a", compress=compress, archive_bytes=1500)
    files = list((tmp_path / "a").glob("part-*"))
    assert len(files) > 3
    for file in files:
        data = file.read_bytes()
        found = list(salvage(data))
        assert found[-1]["end"] == len(data) and all("gap" not in r for r in found)


def test_a_member_whose_length_does_not_end_in_zero(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * (1 << 24))], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/a")
    found = read_warc(spark, f"{tmp_path}/a").collect()
    assert [(r.record_id, r.payload_bytes, r.gap) for r in found] == [("1", 1 << 24, None)]


def test_warc_of_odd_rows(spark, empty):
    rows = [(None, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "same")]
    found = warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id or 0), r.record_type, r.refers_to or 0) for r in found) == [(0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "response", 0)]
    assert warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(Exception):
        warc_round_trip(empty.select(F.col("doc_id").alias("page_id"))).count()
