import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import sarani.llm.agenda as module
from sarani.llm.agenda import Pieces, characters, sp_decode, sp_encode
from sarani.llm.pair_table import NO_PAIR
from tests_llm_helpers import by_id

PATH = public_tokenizers.path("piece_bpe_32k.model")
POOL = list("abcdefghij  klmnop qrstuv WXYZÀÉß 0123456789\t\n\r\x00\x7f\x85\xa0!?.,▁▁–’İ日本語한글ﬁ😀👍🏽‍　١") + ["the ", " and", "  ", "    ", "<s>", "</s>", "<unk>", "<0x0A>", "\n\n"]


@pytest.fixture(scope="module")
def own():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(own, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(POOL, k=rng.randrange(120))) for _ in range(3000)]
    texts += ["", " ", "▁", "a" * 20_000, " " * 5000, "ab" * 4000, "日本" * 3000, "=" * 4097, *map(chr, range(0x250))]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        got = np.frombuffer(own.encode(t), "<u4").tolist()
        assert got == want, t
        assert own.decode(got) == library.decode(want)


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), 28705, rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_cuts_change_nothing(own):
    """Words merged whole equal words merged in parts, and few words held equal many."""
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices(POOL, k=150)).replace(" ", "▁")
        whole = [own.id_of[s] if s in own.id_of else -1 for s in own.merge(word)]
        parts = [own.id_of[s] if s in own.id_of else -1 for w in own.cut.findall(word) for p in own._parts(w) for s in own.merge(p)]
        assert whole == parts


def test_words_merged_together_equal_words_merged_alone(own):
    rng = random.Random(4)
    words = ["".join(rng.choices(POOL, k=rng.randrange(1, 20))).replace(" ", "▁")[: module.LONG_WORD] for _ in range(4000)]
    assert own.merge_words(words) == [own.word_ids(w) for w in words] and own.merge_words([]) == []


def test_few_held_words_change_nothing(own, monkeypatch):
    text = " ".join(f"word{i % 7}" for i in range(60))
    want = own.encode(text)
    monkeypatch.setattr(module, "HELD_WORDS", 2)
    own.held.clear()
    assert own.encode(text) == want and own.encode("other") != want
    assert len(own.held) <= 9  # the words of two chunks


def test_bytes_that_are_no_character():
    assert characters(b"\xe6\x97\xa5\xe6x\xff") == "日�x�"


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        data = f.read()
    path = tmp_path / "other.model"
    path.write_bytes(data.replace(b"\x0a\x08identity", b"\x0a\x08nmt_nfkc"))
    with pytest.raises(ValueError):
        Pieces(str(path))


def test_job(spark, nasty, library):
    df = nasty.withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    encoded = sp_encode(df, PATH, check=True)
    found, decoded = by_id(encoded), by_id(sp_decode(encoded, PATH))
    for r in nasty.select("doc_id", "text").collect():
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        text, f = library.decode(want), found[r.doc_id]
        assert (f.n_tokens, f.ids, decoded[r.doc_id].text, f.agrees) == (len(want), want, text, True)
        assert f.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert f.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables_repeated_rows_and_null_ids(spark, empty):
    assert sp_encode(empty, PATH).count() == 0 and sp_decode(sp_encode(empty, PATH), PATH).count() == 0
    rows = [(None, "One"), (1, "one"), (1, "one"), (2, None)]
    found = sp_encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, digests=False).collect()
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in found) == [(0, 3), (1, 3), (1, 3), (2, 2)]
    odd = spark.createDataFrame([(1, None), (2, [1, None, 264]), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.text for r in sp_decode(odd, PATH).collect()} == {1: "", 2: "a", 3: ""}


def test_the_check_finds_words_merged_in_another_way(spark, own, library):
    """A vocabulary without its merges is told apart from the library, word by word."""
    rng = random.Random(9)
    texts = ["".join(rng.choices(POOL, k=60)) for _ in range(400)]
    checked = Pieces(PATH)
    checked.encode_all(texts, library)
    assert checked.unlike == set() and len(checked.held) > 1000
    broken = Pieces(PATH)
    broken.pairs.rank[:] = NO_PAIR
    broken.encode_all(texts, library)
    words = {w for t in texts for w in own.words(t)}
    assert broken.unlike == {w for w in words if broken.held.get(w, broken.word_ids(w)) != own.word_ids(w)} and broken.unlike
    found = sp_encode(spark.createDataFrame([(1, "the end"), (2, "zz")], "doc_id long, text string"), PATH, check=True)
    assert [r.agrees for r in found.collect()] == [True, True]
