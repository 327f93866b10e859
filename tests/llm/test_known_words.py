"""The words of packing: what is known already costs nothing, merges are the tokenizer's."""

import random
import time

import numpy as np

from quillmark.llm import packing


def tokenizer():
    import public_tokenizers

    return packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_known_chunks_cost_nothing():
    own = tokenizer()
    own.known |= {f"chunk{i}": b"" for i in range(800_000)}
    begin = time.process_time()
    for i in range(200):
        own.ids([f"some words {i}"])
    assert time.process_time() - begin < 2


def test_merges_of_random_words():
    own, rng = tokenizer(), random.Random(9)
    words = ["".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randrange(1, 30))) for _ in range(5000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert own.ids(words) == want
