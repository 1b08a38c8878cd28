import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm.phrase_mining import END, frequent_prefixes, mine_phrases, phrase_counts


@pytest.mark.parametrize("depths", [1, 2, 4])
def test_sort_counts_all_prefixes(depths):
    draw = np.random.default_rng(depths)
    for n in (0, 1, 5, 3000):
        keys = draw.integers(0, 12, (n, depths)).astype(np.int32)
        ends = draw.integers(1, depths + 1, n)
        keys[np.arange(depths) >= ends[:, None]] = END
        weight = draw.integers(1, 4, n)
        wanted = Counter()
        for row, w in zip(keys.tolist(), weight.tolist()):
            for d in range(1, depths + 1):
                if row[d - 1] != END:
                    wanted[tuple(row[:d])] += w
        for least in (1, 7):
            found = {tuple(keys[p, :d].tolist()): c for d, ps, cs in frequent_prefixes(keys, weight, least) for p, c in zip(ps, cs.tolist())}
            assert found == {k: c for k, c in wanted.items() if c >= least}
        whole = {d: len(ps) for d, ps, _ in frequent_prefixes(keys, weight, 1, 7)}
        assert whole.get(depths, 0) == sum(len(k) == depths and c >= 7 for k, c in wanted.items())


def brute(rows, longest, least, inside, top):
    """All phrases by counting every stretch of words."""
    f = Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    n = Counter()
    for (lang, words), count in f.items():
        n[lang] += count if len(words) == 1 else 0
    held = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in held.items():
        longer = [
            b for (other, more), b in held.items()
            if other == lang and len(more) > len(words)
            and any(more[i : i + len(words)] == words for i in range(len(more)))
        ]
        if any(100 * b >= inside * a for b in longer):
            continue
        score, _, l, r = min(
            (1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
            for k in range(1, len(words))
        )
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    ranked, at = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def made(draw):
    words = ["new", "New", "york", "of", "the", "é", "É", "a", "b", "c\x1cd", "<z>", "zebra"]
    text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(draw.randint(0, 60)))
    return draw.choice(["en", "en", "en", "fr", None, ""]), draw.choice([text, text, text, None, "", "of the " * 12])


def table(spark, rows):
    wide = [(i, lang, text, 1, 2, "p", True, 0) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, lang string, text string, n long, size int, phrase string, hot boolean, bucket long")


@pytest.mark.parametrize("longest,least,inside,top", [(3, 10, 50, 2000), (4, 3, 60, 25), (2, 1, 50, 7)])
def test_phrases_equal_brute_force(spark, longest, least, inside, top):
    draw = random.Random(longest)
    rows = [made(draw) for _ in range(120)] + [("en", "of the new york"), ("en", "x " * 5000)]
    docs = table(spark, rows).repartition(3)
    wanted = brute(rows, longest, least, inside, top)
    for options in ({}, {"bucket_bytes": 150, "max_bytes": 0}):
        found = mine_phrases(docs, longest, least, inside, top, **options).collect()
        assert sorted(tuple(r) for r in found) == wanted


def test_hot_pairs_are_split_and_counted_whole(spark):
    rows = [("en", " ".join(f"hot pair w{(i * j) % 40}" for j in range(30))) for i in range(60)]
    counts, totals = phrase_counts(table(spark, rows).repartition(4), bucket_bytes=500)
    got = {r.phrase: r.n for r in counts.collect()}
    words = Counter(" ".join(t.split()[i : i + k]) for _, t in rows for k in (1, 2, 3) for i in range(len(t.split()) - k + 1))
    assert got == {p: n for p, n in words.items() if n >= 10} and got["hot pair"] == 1800
    assert [tuple(r) for r in totals.collect()] == [("en", 5400)]


def test_no_rows(spark):
    assert mine_phrases(table(spark, [])).collect() == []
    assert mine_phrases(table(spark, [("en", None), (None, " . ")])).collect() == []
