"""Shingles of many texts at once."""

import random

from evidentia.llm import shingles


def test_sets_of_many_texts(monkeypatch):
    """Short texts are hashed together, about STRETCH bytes at a time; their sets are those of each text alone, equal for equal
    shingles, with nothing across the border of two texts."""
    rng = random.Random(3)
    odd = [None, "", " \n\t", "a", "A b", "a b c d", "a b c d e", "a\x0bB\x0cc\x1cd é", "x" * 63, "x" * 64 + " y", "　  ", "\udc80 x", "a b c d e " * 9]
    texts = odd + ["".join(rng.choices("aAbé \n.", k=rng.choice([0, 3, 30, 300]))) for _ in range(4000)] + ["w v " * shingles.STRETCH] + odd
    rng.shuffle(texts)
    alone = [shingles.shingle_set(t) for t in texts]
    calls, plain = [], shingles._hashed
    monkeypatch.setattr(shingles, "_hashed", lambda raw: calls.append(len(raw)) or plain(raw))
    got = list(shingles.shingle_sets(texts))
    assert len(calls) <= 2 + sum(calls) / shingles.STRETCH
    assert [s.tolist() for s in got] == [s.tolist() for s in alone]
    word_for = {}
    for text, tokens in zip(texts, got):
        words = shingles.word_shingles(text)
        assert len(tokens) == len(words) and (tokens[1:] > tokens[:-1]).all()
        word_for.setdefault(tokens.tobytes(), words)
        assert word_for[tokens.tobytes()] == words
    assert len(word_for) == len({frozenset(w) for w in word_for.values()}) and list(shingles.shingle_sets([])) == []
