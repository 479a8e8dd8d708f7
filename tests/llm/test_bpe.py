"""Exact ids and texts against the tokenizers library."""
import hashlib
import os
import random
import time
import weakref

import pyarrow as pa
import pytest

from panelyard.llm import bpe, common
from tests_llm_data import odd, rows  # noqa: F401  (fixtures)

PATH = "/opt/tokenizers/word_bpe_49k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary file not present")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ODD_TEXTS = [
    "", "  ", "Hello World's don't WE'LL <|endoftext|>x<|startoftext|>", "½²Ⅷ x\x1cy\u3000z", "İstanbul ΣΑΣ ΟΔΟΣ", "e\u0301 \u0301a", "a\xa0b\u200bc", "😀👍🏽", "a1b2 'S 'RE",
    "\x00 \x07a", "한국어 漢字 ไทย العربية", "a" * 400, "rrrr rrrrr rrrrrr nrrrr arrrr", "ſ K Å ǅ ß ẞ", "||| *** ---", "<|endoftext", "x\x85y\x1fz",
]


def test_ids_and_texts_equal_the_library(reference):
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("aabcdeeefghiinorrrstt   '!?.,;:$0123éßñ中😀") for _ in range(60)) for _ in range(1500)]
    e = bpe.encoder(PATH)
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        got = e.encode(t)
        assert got.tolist() == want, t
        assert e.decode(got) == reference.decode(want, skip_special_tokens=False)


def test_memory_is_bounded_and_harmless():
    m = bpe.Memory(lambda k: k * 2, 10)
    for i in range(200):
        assert m[str(i % 23)] == str(i % 23) * 2
        assert len(m) <= 5 and len(m.older) <= 5


def test_frame_odd_rows(odd, rows, reference):
    got = bpe.encode_texts(odd.withColumnRenamed("kept", "n_tokens"), PATH)
    assert got.columns == ["doc_id", "other", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    back = {(r.doc_id, r.ids_sha256): r for r in got.collect()}
    assert got.count() == odd.count()
    for r in odd.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        h = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        g = back[r.doc_id, h]
        assert g.n_tokens == len(ids) and g.token_ids == ids
        assert g.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(rows([]), PATH).count() == 0
    texts = {r.doc_id: r.decoded for r in bpe.decode_ids(got.filter("doc_id in (4, 7)"), PATH).collect()}
    assert texts[4] == "one</w>"


def test_remembered_ids_are_packed():
    e = bpe.Encoder(PATH)
    e.encode(" ".join(ODD_TEXTS))
    assert e.words and all(type(v) is bytes and len(v) % 4 == 0 for v in [*e.words.values(), *e.memory.values()])
    assert e.fits and all(type(k) is int for k in e.fits)


def test_worker_lets_go_of_its_encoder_after_the_last_task(rows):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.encoder.cache_info().currsize] * b.num_rows, pa.int64())], names=["n"])

    data = rows([(i, f"some text {i}") for i in range(400)]).repartition(4)
    assert bpe.encode_texts(data, PATH).agg({"n_tokens": "sum"}).first()[0] > 0
    end = time.monotonic() + 60
    while (most := max(r.n for r in data.mapInArrow(held, "n long").collect())) and time.monotonic() < end:
        time.sleep(1)
    assert most == 0


def test_rows_of_several_steps_all_come(rows, reference):
    texts = {i: f"text number {i}" if i % 7 else None for i in range(2500)}
    got = bpe.encode_texts(rows(list(texts.items())).repartition(1), PATH).collect()
    assert len(got) == 2500 and all(r.token_ids == reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in got)


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    task = common.tidy(lambda batches: (seen.append(b) or b for b in batches))
    assert list(task(iter([1, 2]))) == [1, 2] and seen == [1, 2, "back"]


def test_encoder_stays_while_tasks_run():
    bpe.encoder.cache_clear()
    with bpe.lent(PATH, 100, 0.2) as e:
        with bpe.lent(PATH, 100, 0.2) as other:
            assert other is e
        time.sleep(0.6)
        assert bpe.encoder.cache_info().currsize == 1 and bpe.encoder(PATH, 100) is e
    with bpe.lent(PATH, 100, 0.2) as other:
        assert other is e
    seen = weakref.ref(e)
    del e, other
    time.sleep(2)
    assert bpe.encoder.cache_info().currsize == 0 and seen() is None
