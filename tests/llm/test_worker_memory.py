"""What a Python worker holds: word hashes by parts, one parser at a time."""

import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import hashing, language_id, packing


@pytest.mark.parametrize("size", [1, 5, 64])
def test_word_hashes_do_not_depend_on_parts(monkeypatch, size):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "é", "😀", " ", "\n", "\t ", "word", "x" * 90, " " * 150]) for _ in range(rng.randrange(30))) for _ in range(200)]
    column = pa.array([None, "", " ", *texts, "end"], pa.string())
    for fold in (False, True):
        whole = hashing.Words(column, fold).hash
        words = " ".join(t.lower() if fold else t for t in [*texts, "end"]).split()
        assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
        with monkeypatch.context() as m:
            m.setattr(hashing, "HASH_BYTES", size)
            assert np.array_equal(hashing.Words(column, fold).hash, whole)


def test_words_of_a_block_take_little_memory():
    column = pa.array([" ".join(f"word{i}" for i in range(5000))] * 90)
    hashing.Words(column, True)
    tracemalloc.start()
    words = hashing.Words(column, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 450_000 and peak < 16 * len(words.raw)


def test_a_worker_holds_one_parser():
    first = language_id.parser((("en", "the cat and the dog"), ("de", "der hund und die katze")))
    assert language_id.parser((("en", "the cat and the dog"), ("de", "der hund und die katze"))) is first
    gone = weakref.ref(first)
    del first
    language_id.parser((("en", "some other text"),))
    assert gone() is None


def test_a_parser_takes_the_place_of_a_tokenizer(monkeypatch):
    import public_tokenizers

    made, init = [], packing.WordTokenizer.__init__

    def noted(self, path):
        init(self, path)
        made.append(weakref.ref(self))

    monkeypatch.setattr(packing.WordTokenizer, "__init__", noted)
    cut = packing.pieces(public_tokenizers.path("word_bpe_49k.json"), 2048, 0)
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": ["some words"]})
    for _ in range(2):
        assert [b.num_rows for b in cut(iter([batch]))] == [1]
    assert len(made) == 1 and made[0]() is not None
    language_id.parser((("en", "yet another text"),))
    assert made[0]() is None
