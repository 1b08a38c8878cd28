import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm.minhash_dedup import (
    _hashes,
    drop_near_copies,
    near_duplicates,
    parities,
    prefix_pairs,
    shingle_strings,
    similar,
    sketch,
    text_words,
    verify,
)


def corpus():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [draw.choice(words) for _ in range(150)]
    texts = [" ".join(base)]
    for edits in (1, 1, 2, 2, 2, 3, 3, 4, 5, 8) * 6:  # many copies of one text, each edited elsewhere
        other = list(base)
        for at in draw.sample(range(len(other)), edits):
            other[at] = draw.choice(words)
        texts.append(" ".join(other))
    draw.shuffle(texts)
    for _ in range(60):
        own = [draw.choice(words) for _ in range(draw.randint(1, 60))]
        texts += [" ".join(own), " ".join(own).upper() + "\n"]
    texts += ["one two", "ONE two", "two one", "", " \t", None, "a b c d e", "a b c d e f", "x " * 40_000, "x " * 50_000]
    return [*enumerate(texts)]


def brute(rows, per_cent):
    sets = [shingle_strings(t or "") for _, t in rows]
    label = list(range(len(rows)))
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            inside = len(a & sets[j])
            if inside and 100 * inside >= per_cent * (len(a) + len(sets[j]) - inside):
                links.append((i, j))
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_equals_brute_force(spark, docs_of, tmp_path):
    rows = corpus()
    docs_of(rows).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 85) and len(found) == len(rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({label for _, label in brute(rows, 80).values()})


def test_odd_rows(spark, docs_of, tmp_path):
    docs_of([(None, "a b c"), (None, "a b c"), (1, None)]).write.parquet(str(tmp_path / "d"))
    found = near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(found) == 3 and all(r.kept for r in found)
    docs_of([]).write.parquet(str(tmp_path / "e"))
    assert near_duplicates(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_sketch_estimates_and_fills():
    draw = np.random.default_rng(1)
    for shared, size in ((900, 1000), (3, 4), (1, 1)):
        hits = []
        for _ in range(20):
            common, rest = draw.integers(0, 2**63, shared), draw.integers(0, 2**63, (2, size - shared))
            a, b = (sketch(np.unique(np.concatenate([common, r]).astype(np.uint64)), 180) for r in rest)
            assert (a != np.uint64(2**64 - 1)).all()
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - shared / (2 * size - shared)) < 0.06


def edited(count, most, seed=3, size=120):
    """Copies of one text with up to ``most`` words changed, dropped or put in from a short list, and a few others."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(900)}" for _ in range(size)]
    rows = [(0, " ".join(base))]
    for i in range(1, count):
        words = list(base)
        for _ in range(draw.randint(1, most)):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 1)] = [draw.choice(("x", "y", "z"))] * draw.randint(0, 1)
        rows.append((i, " ".join(words)))
    rows += [(count + i, text) for i, text in enumerate(("a", "a b", "a b c d e f", "a b c d e f g", " ".join(base[: size // 2])))]
    return rows


@pytest.mark.parametrize("per_cent", [80, 85, 100])
def test_prefixes_lose_no_pair(spark, per_cent):
    rows = edited(220, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = docs.select(F.col("doc_id").alias("x"), (F.col("doc_id") % 50).alias("c"))
    found = {(r.x, r.r) for r in prefix_pairs(members, docs, per_cent).collect()}
    sets = [shingle_strings(text) for _, text in rows]
    apart = [(i, j) for i in range(len(rows)) for j in range(i) if i % 50 != j % 50]
    links = {(i, j) for i, j in apart if similar(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]), per_cent)}
    assert links <= found and (links or per_cent == 100)
    assert len(found) < len(links) + len(apart) / 20  # and few more
    assert prefix_pairs(members.limit(0), docs, per_cent).isEmpty()


def test_parities_never_differ_more_than_the_sets():
    known = {}
    sets = [_hashes(text_words(text), 5, known) for _, text in edited(60, 20, seed=4, size=400)]
    for a in sets:
        for b in sets:
            differ = np.unpackbits((parities(a) ^ parities(b)).view(np.uint8)).sum()
            assert differ <= len(np.setxor1d(a, b))


def test_thousands_of_edits_of_one_text(spark, tmp_path):
    rows = edited(2000, 9, seed=5, size=150)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 85)
    far = [(x, 0) for x in range(1, 2000, 100)]
    checked = verify(spark.createDataFrame(far, "x long, r long"), docs).collect()
    assert {(r.x, r.inside) for r in checked} == {
        (x, len(shingle_strings(rows[x][1]) & shingle_strings(rows[0][1]))) for x, _ in far
    }


def test_buckets_of_one_component_are_not_compared_again(spark, docs_of, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("no bucket holds two components")

    for name in ("coverage", "prefix_pairs"):
        monkeypatch.setattr(f"reviewloom.llm.minhash_dedup.{name}", never)
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, "more"])), (4, "a b c d e f g"), (5, None)]
    docs_of(rows).write.parquet(str(tmp_path / "d"))
    found = near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
