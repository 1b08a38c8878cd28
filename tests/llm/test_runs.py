import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reviewloom.llm.periodic_runs import SuffixArray, find_runs, mark_runs, op12_periodic_runs
from reviewloom.llm.words import cut_words

from .conftest import DATA


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def brute(words, shortest):
    """All runs by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - i >= max(shortest, 2 * q):
                found.setdefault((i, end - i), q)
            i = end - q + 1
    runs = sorted((s, n, q) for (s, n), q in found.items())
    assert all(smallest_period(words[s : s + n]) == q for s, n, q in runs)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def made(draw):
    kind = draw.randrange(5)
    n = draw.randint(0, 60)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return [draw.choice("abcdefgh") for _ in range(n)]
    if kind == 2:
        unit = [draw.choice("abc") for _ in range(draw.randint(1, 9))]
        return (unit * 60)[draw.randint(0, 5) : n]
    if kind == 3:
        unit = [draw.choice("abc") for _ in range(draw.randint(1, 7))]
        other = [draw.choice("abc") for _ in range(draw.randint(1, 4))]
        return unit * draw.randint(0, 5) + other * draw.randint(0, 9) + unit * draw.randint(0, 4)
    a, b = ["a"], ["a", "b"]
    for _ in range(6):
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("shortest", [1, 6, 12])
def test_runs_equal_brute_force(shortest):
    draw = random.Random(shortest)
    texts = [made(draw) for _ in range(1500)]
    codes = np.array([ord(w) - 97 for t in texts for w in t], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, length, period = find_runs(codes, text, shortest)
    first = np.cumsum([0, *map(len, texts)])
    got = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        got[text[s]].append((s - int(first[text[s]]), n, q))
    assert got == [brute(t, shortest) for t in texts]


def test_suffixes_are_in_order():
    draw = random.Random(2)
    codes = np.array([draw.choice([0, 0, 1, 2]) for _ in range(400)])
    text = np.repeat([0, 1, 2], [150, 1, 249])
    suffixes = SuffixArray(codes, text)
    listed = [(int(text[i]), codes[i : suffixes.end[i]].tolist()) for i in suffixes.order]
    assert listed == sorted(listed)
    for (ta, a), (tb, b), shared in zip(listed, listed[1:], suffixes.common()[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if ta == tb else 0
        assert shared == same


def test_words_equal_pattern():
    draw = random.Random(4)
    texts = ["".join(draw.choice(" \t\n\x0b\x0c\r\x1c\xa0aAbÉé.;x") for _ in range(draw.randint(0, 25))) for _ in range(900)]
    array = pa.array(["skipped", *texts])[1:]
    cut = cut_words(array)
    assert [w.decode() for w in cut.words.to_pylist()] == [w for t in texts for w in re.findall("[^\x20\x09-\x0d]+", t)]
    assert [cut.known[int(c)].as_py() for c in cut.codes] == cut.words.to_pylist()
    cut = cut_words(array, b" \t", b".,;:!?\n\x0b\x0c\r", lower=True)
    wanted = []
    for i, t in enumerate(texts):
        for j, piece in enumerate(re.split("[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in t))):
            wanted += [(i, j, w) for w in re.findall("[^ \t]+", piece)]
    assert [w.decode() for w in cut.words.to_pylist()] == [w for _, _, w in wanted]
    same = [a[:2] == b[:2] for a, b in zip(wanted, wanted[1:])]
    assert same == [bool(a == b) for a, b in zip(cut.piece, cut.piece[1:])]
    assert cut.text.tolist() == [i for i, _, _ in wanted]


def test_texts_are_collapsed(spark, docs_of):
    long = " ".join(f"w{i % 70}" for i in range(30_000))
    rows = [(1, None), (2, ""), (2, " \n "), (3, "a\tb  " * 6 + "c"), (3, "a b " * 6 + "c"), (None, "x " * 12), (4, "x " * 11), (5, long)]
    found = sorted(mark_runs(docs_of(rows)).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [
        (None, 12, [(0, 12, 1)], "x"),
        (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""),
        (3, 13, [(0, 12, 2)], "a b c"), (3, 13, [(0, 12, 2)], "a b c"),
        (4, 11, [], " ".join("x" * 11)),
        (5, 30_000, [(0, 30_000, 70)], " ".join(f"w{i}" for i in range(70))),
    ]
    assert mark_runs(docs_of([])).count() == 0


def test_time_does_not_grow_as_a_square():
    began = time.time()
    for codes in (np.zeros(200_000, dtype=np.int64), np.arange(200_000) % 2000, np.append(np.zeros(9_999), np.arange(9_999) % 3).astype(np.int64)):
        find_runs(codes, np.zeros(len(codes), dtype=np.int64))
    assert time.time() - began < 60


def rewritten(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")
def test_query_equals_brute_force(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op12_periodic_runs(spark, str(DATA)).collect()}
    assert len(found) == len(documents)
    for doc_id, text in documents:
        words = rewritten(doc_id, text)
        if len(words) > 900:
            continue
        runs = brute(words, 12)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = found[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in found.values()) > 10
