"""Suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import docs, rows

from tessera.llm import suffixes


def brute(made, length):
    raw = [(r[1] or "").encode() for r in made]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for r, x in zip(made, raw, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((r[0], len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def made(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: "".join(word() for _ in range(n))
    passages = [prose(length // rng.choice((2, 3, 4, 5))) for _ in range(5)] + ["ab" * length, "z" * (length + 3)]
    out = []
    for k in range(60):
        text = prose(rng.randint(0, length // 2))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + (p if rng.random() < 0.5 else p[a:b]) + text[at:]
        out.append((k, text, None, None, 0, None, None))
        if rng.random() < 0.15:
            out.append((k + 500, text, None, None, 0, None, None))
        if rng.random() < 0.15:
            t = list(text)
            t[rng.randrange(len(t)) if t else 0 : 1] = ["q"]
            out.append((k + 700, "".join(t), None, None, 0, None, None))
    return out + rows()


@pytest.mark.parametrize("seed,length,k,hot", [(1, 40, 13, 20_000), (2, 200, 64, 20_000), (3, 40, 13, 2), (4, 24, 8, 4)])
def test_dedup_is_exact(spark, seed, length, k, hot):
    some = made(seed, length)
    got = sorted((tuple(r) for r in suffixes.dedup(docs(spark, some), length=length, k=k, hot=hot).collect()), key=str)
    assert got == brute(some, length)


def test_hot_anchors_are_split_and_sorted(spark):
    """A passage in every text, with other bytes at its sides, and texts that differ in its middle."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, some = letters(130), []
    for k in range(120):
        text = passage if k % 3 else passage[:70] + rng.choice("xyz") + passage[71:]
        some.append((k, letters(rng.randint(0, 30)) + text + letters(rng.randint(0, 30)), None, None, 0, None, None))
    for hot in (1, 7, 1000):
        got = sorted((tuple(r) for r in suffixes.dedup(docs(spark, some), length=40, k=13, hot=hot).collect()), key=str)
        assert got == brute(some, 40)


def test_spans_and_empty(spark):
    some = made(5, 40)
    for r in suffixes.dedup(docs(spark, some), length=40, k=13, spans=True).collect():
        assert sum(x.end - x.start for x in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert suffixes.dedup(docs(spark, [])).count() == 0


def test_mergesort_and_extension():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    s = suffixes.Suffixes(data, 20)
    start = rng.integers(0, 2900, 500)
    segment = np.sort(rng.integers(0, 9, 500))
    order = s.sort(start, segment)
    raw = data.tobytes()
    for g in range(9):
        at = np.flatnonzero(segment == g)
        assert [raw[start[k] : start[k] + 20] for k in order[at]] == sorted(raw[start[k] : start[k] + 20] for k in at)
    i, j = rng.integers(100, 2900, 200), rng.integers(100, 2900, 200)
    for a, b, n, m in zip(i, j, s.extension(i, j, np.full(200, 20)), s.extension_back(i, j, np.full(200, 20)), strict=True):
        assert n == next((k for k in range(20) if raw[a + k] != raw[b + k]), 20)
        assert m == next((k for k in range(20) if raw[a - 1 - k] != raw[b - 1 - k]), 20)


def test_collisions_are_settled(monkeypatch):
    """With a hash that hardly tells strings apart, only equal bytes count."""
    monkeypatch.setattr(suffixes.Suffixes, "same", lambda self, i, j, n: np.ones(len(i), dtype=bool))
    context = [b"xxxxabcdyyyy", b"xxxzabcdyyyy", b"xxxxabcdyyyz"]
    got = suffixes.repeated_starts(np.array([1, 1]), context[:2], np.array([4, 4]), 8)
    assert got == [[(4, 4)], [(4, 4)]]
    got = suffixes.repeated_starts(np.array([1, 1, 1]), [b"abcdefgh", b"abcdefgx", b"zzzzzzzz"], np.array([0, 0, 0]), 8)
    assert got == [[], [], []]
