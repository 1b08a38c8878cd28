import zlib
from collections import Counter

import numpy as np
import pytest

from reviewloom.llm.bpe_lexicon import default_vocabulary
from reviewloom.llm.mixture_packing import Cutter, apportion, mix_documents, plan_windows, served

from .test_bpe import texts

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def test_served_stays_within_a_token_of_the_target():
    draw = np.random.default_rng(3)
    for queues in (1, 2, 7, 40):
        weights = apportion(64 * 128, draw.integers(1, 10_000, queues).tolist() + [1] * queues)
        total = served(weights, 128)
        entitled = np.arange(129)[:, None] * np.array(weights) / 128
        assert (np.diff(total, axis=0) >= 0).all() and (np.diff(total.sum(axis=1)) == 64).all()
        assert np.abs(entitled - total).max() < 1 and (total[-1] == weights).all()


def emptied(sizes, targets=None, capacity=16, rounds=8):
    """Mixture of each window by brute force from the pieces of one token each."""
    phases = plan_windows(sizes, capacity, targets, rounds)
    queue = np.repeat(np.arange(len(sizes)), sizes)
    place = np.concatenate([np.arange(n) for n in sizes])
    row, where, length, sequence, offset = Cutter(phases).pieces(queue, place, np.ones(len(queue), dtype=np.int64))
    assert row.tolist() == list(range(len(queue))) and (where == place).all() and (length == 1).all()
    windows = {}
    for q, w, o in zip(queue.tolist(), sequence.tolist(), offset.tolist()):
        windows.setdefault(w, []).append((o, q))
    assert sorted(windows) == list(range(len(windows)))
    for held in windows.values():
        assert sorted(o for o, _ in held) == list(range(len(held)))
    # each window takes from a queue what comes next in it
    for q in range(len(sizes)):
        assert (np.diff(sequence[queue == q]) >= 0).all()
    return [Counter(q for _, q in windows[w]) for w in sorted(windows)]


@pytest.mark.parametrize("sizes", [[1], [16], [5000, 1, 0, 333], [97] * 30, [1, 2, 3], [4000, 4000, 17]])
def test_plan_empties_all_queues(sizes):
    for targets in (None, [1] * len(sizes), [0] * len(sizes), [5, *[1] * (len(sizes) - 1)]):
        mixes = emptied(sizes, targets)
        held = [sum(mix.values()) for mix in mixes]
        full = sum(sizes) // 16
        assert held[:full] == [16] * full and all(n & (n - 1) == 0 for n in held[full:]) and sum(held) == sum(sizes)
    shares = np.array(sizes) / sum(sizes)
    for mix in emptied(sizes)[: max(0, sum(sizes) // 16 - 1)]:
        assert all(abs(mix[q] - 16 * share) < 2 for q, share in enumerate(shares))


def test_targets_hold_until_a_queue_is_empty():
    mixes = emptied([1600, 1600, 160, 50], [8, 4, 4, 0])
    # a quarter from the short queue for 40 windows, then two to one for 105, then the rest, the last queue last
    assert all(mix == {0: 8, 1: 4, 2: 4} for mix in mixes[:40])
    assert all(abs(mix[0] - 32 / 3) < 2 and mix[2] == 0 for mix in mixes[41:140])
    assert mixes[-1][3] > 0 and all(mix[3] == 0 for mix in mixes[:209])


def checked(found, rows, content):
    library = tokenizers.Tokenizer.from_str(content)
    wanted = {}
    for i, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted.setdefault((i, len(ids)), []).append(ids)
    sequences = {}
    held = Counter()
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        held[r.doc_id, r.doc_tokens] += r.length
        assert any(
            zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in wanted[r.doc_id, r.doc_tokens]
        )
    assert held == {key: sum(map(len, same)) for key, same in wanted.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts]).tolist()][:-1]
    return [sum(n for _, n in sequences[w]) for w in sorted(sequences)]


def table(spark, rows):
    wide = [(i, t, s, 1, 2, "q", 3) for i, t, s in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, key long, at long, queue string, base int")


def test_documents_are_whole(spark):
    content = default_vocabulary()
    rows = [(1, None, "a"), (2, "", None), (2, "same", None), (2, "same", None), (None, "x y", "b"), (3, "ü wort " * 20_000, "a")]
    rows += [(i, t, "hot" if i % 3 else "cold") for i, t in enumerate(texts()[:900], 10)]
    docs = table(spark, rows).repartition(5)
    for options in ({}, {"targets": {"cold": 3, "a": 1}}, {"max_bytes": 0}):
        sizes = checked(mix_documents(docs, **options).collect(), rows, content)
        total = sum(sizes)
        assert sizes[: total // 1024] == [1024] * (total // 1024)
        assert all(n & (n - 1) == 0 for n in sizes)
    assert mix_documents(table(spark, [])).count() == 0


def test_small_sources_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr("reviewloom.llm.mixture_packing.MOST_QUEUES", 3)
    rows = [(i, "word " * (i % 50), f"s{i % 17}") for i in range(300)]
    sizes = checked(mix_documents(table(spark, rows)).collect(), rows, default_vocabulary())
    assert all(n & (n - 1) == 0 for n in sizes)
