"""Phrases of long texts, which are parsed in segments side by side, against one greedy parse."""

import random

import pyarrow as pa
import pytest

from quillmark.llm import language_id

LATIN = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def greedy(text, train):
    i = n = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


@pytest.mark.parametrize("segment", [1, 2, 7, 64])
def test_seams(monkeypatch, segment):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    rng = random.Random(segment)
    letters = LATIN + "".join(map(chr, range(0x4E00, 0x4E08)))  # more than the automata have columns
    say = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    training = {k: say(150) for k in "abc"}
    texts = [say(rng.randrange(1, 60)) for _ in range(40)] + ["", "x", *training.values()]
    for _ in range(60):  # pieces of training texts, some long, with strange letters between
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(list(training.values()))
            at = rng.randrange(len(t))
            parts.append(t[at : at + rng.randrange(1, 300)].strip() + rng.choice(["", "q", "Ж"]))
        texts.append(" ".join(" ".join(parts).split()))
    counted = language_id.CrossParser(tuple(training.items())).parse(pa.array(texts))[1]
    for text, row in zip(texts, counted, strict=True):
        assert row.tolist() == [greedy(text.lower(), t) for t in training.values()], text


def test_a_long_copy_is_one_phrase():
    rng = random.Random(3)
    train = " ".join("".join(rng.choice(LATIN[:20]) for _ in range(rng.randrange(1, 8))) for _ in range(4000))[:12_000].strip()
    parser = language_id.CrossParser((("x", train), ("y", train[::-1])))
    copies = [train[:3000].strip(), train[:9000].strip(), train[500:11_500].strip(), train[:5000].strip() + "ж" + train[5000:9000].strip()]
    assert parser.parse(pa.array(copies))[1][:, 0].tolist() == [1, 1, 1, 3]
