import itertools
import random
import zlib

import numpy as np
import pytest

from reviewloom.llm.packing import WordIds, best_fit_decreasing, cut_documents, lower_bound, pack_documents, pack_pieces, word_vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def content():
    pytest.importorskip("public_tokenizers")
    return word_vocabulary()


def fewest(lengths, capacity):
    """Fewest bins by trying all ways, for very small inputs."""
    best = len(lengths)
    for places in itertools.product(range(len(lengths)), repeat=len(lengths)):
        fill = [0] * len(lengths)
        for size, place in zip(lengths, places):
            fill[place] += size
        if max(fill) <= capacity:
            best = min(best, sum(f > 0 for f in fill))
    return best


def test_bound_is_below_and_packing_above_the_best():
    draw = random.Random(5)
    for _ in range(60):
        lengths = np.array([draw.randint(1, 10) for _ in range(draw.randint(1, 5))])
        bins, offsets, used = best_fit_decreasing(lengths, 10)
        assert lower_bound(lengths, 10) <= fewest(lengths.tolist(), 10) <= used
    assert lower_bound(np.array([6] * 7 + [3]), 10) == 7 and lower_bound(np.array([4] * 9), 10) == 5


def test_word_ids_equal_library(content):
    draw = random.Random(2)
    pool = "ABtheING.,.,<|ENDOFTEXT|> \n\t\r\x85\xa0　'\"sΣσςÉéé1٣²<|endoftext|>x😀́Ի!İKß"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 30))) for _ in range(4000)] + ["a <|endoftext|> b", "ΑΣ a"]
    ids, bounds = WordIds(content).encode(texts)
    wanted = tokenizers.Tokenizer.from_str(content).encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(bounds, bounds[1:], wanted))


def test_documents_are_whole(spark, docs_of, content):
    rows = [(1, None), (1, ""), (2, "word " * 5000), (None, "a b"), (None, "a b"), *((i, "xyz " * (i * 13)) for i in range(3, 120))]
    found = pack_documents(docs_of(rows), content).collect()
    library = tokenizers.Tokenizer.from_str(content)
    wanted = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        wanted += [(i or -1, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *itertools.accumulate(length for _, length in sorted(parts))]
        assert [offset for offset, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= lower_bound(np.array([w[3] for w in wanted]), 2048) + 1
    assert pack_documents(docs_of([]), content).count() == 0


def test_exchange_loses_nothing_and_saves(spark, content):
    draw = random.Random(4)
    rows = [(i, 0, 0, draw.choice([700, 650, 690, 1100, 1500, 30, 5]), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = pack_pieces(pieces, per_part=200).collect()
    assert sorted(r.doc_id for r in found) == list(range(3000))
    fill = {}
    for r in found:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    alone = best_fit_decreasing(np.array([r[3] for r in rows]), 2048)[2]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * alone + 1


def test_ids_of_odd_texts_equal_the_library(content):
    library = tokenizers.Tokenizer.from_str(content)
    library.no_truncation()
    library.no_padding()
    draw = random.Random(1)
    letters = [*"abcXYZ.,  \n\t\r'\"<>|-0129²½ªºßİıſŸÄéÅñžŽ中가🙂́ ​\x00\x85ﬁΣς", "<|endoftext|>", "</w>", "don't", "e.g.", "A.,", "x.."]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    texts += ["", " ", "\n", ".", ",", "x" * 20_000, "word. " * 5000]
    encoder = WordIds(content)
    for _ in range(2):  # the second time from what is remembered
        ids, bounds = encoder.encode(texts)
        for i, found in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == found.ids, texts[i][:80]
    assert encoder.encode([])[1].tolist() == [0]


def test_few_texts_are_encoded_at_once(spark, monkeypatch, content):
    """What a task holds besides its words follows from a part of a batch, not from the rows of the batch."""
    texts = [f"word{i % 7} and {'more ' * (i % 5)}text, {i}." for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = sorted(cut_documents(docs, content).collect())
    monkeypatch.setattr("reviewloom.llm.packing.TEXTS_AT_ONCE", 4)
    calls, longer = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    encode = WordIds.encode

    def counted(self, some):
        calls.add(1)
        longer.add(int(len(some) > 4))
        return encode(self, some)

    monkeypatch.setattr(WordIds, "encode", counted)
    assert sorted(cut_documents(docs, content).collect()) == whole
    assert (calls.value, longer.value) == (7, 0)
