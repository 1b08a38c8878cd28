import random

import pytest

from reviewloom.llm.bpe_lexicon import (
    Encoder, Lexicon, Vocabulary, compile_lexicon, decode_documents, default_vocabulary, encode_documents,
)

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = " \n\t\r\x85\xa0 　\x1c'\"sstrevemlldAé1٣²<|endoftext|>x😀́Ի." + "࢏"


@pytest.fixture(scope="module")
def content():
    pytest.importorskip("public_tokenizers")
    return default_vocabulary()


def texts():
    draw = random.Random(3)
    made = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    words = ["<|endoftext|>", "a", "the", "\n", "", "it's", "x\n", "\ty", "worldliness" * 9]
    return made + [" ".join(draw.choice(words) for _ in range(8)) for _ in range(800)]


def test_encoder_equals_library(content):
    vocabulary = Vocabulary(content)
    lexicon = Lexicon(compile_lexicon({w: vocabulary.merge(w) for w in (b" the", b"a", b" a", b" it", b"'s")}))
    some = texts()
    wanted = tokenizers.Tokenizer.from_str(content).encode_batch(some, add_special_tokens=False)
    for tool in (Encoder(vocabulary, lexicon), Encoder(vocabulary, None)):
        ids, bounds = tool.encode(some)
        assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(bounds, bounds[1:], wanted))


def test_lexicon_shares_suffixes_and_finds_exactly():
    entries = {w.encode(): (i, i + 1) for i, w in enumerate("taps tap tops top stops stop s".split())}
    lexicon = Lexicon(compile_lexicon(entries))
    assert [lexicon.ids_of(n) for n in lexicon.find(list(entries))] == [list(v) for v in entries.values()]
    assert lexicon.find([b"", b"ta", b"tapss", b"x"]).tolist() == [-1] * 4
    assert len(lexicon.ends) < 10  # a tree of these words has 13 nodes
    assert Lexicon(compile_lexicon({})).find([b"a"]).tolist() == [-1]


def test_documents_round_trip(spark, docs_of, content):
    rows = [(1, None), (2, ""), (2, "it's  a\n test <|endoftext|>"), (None, "ü " * 50_000), *enumerate(texts()[:200], 10)]
    found = decode_documents(encode_documents(docs_of(rows), content, words=50), content).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == sorted((i or 0, t or "") for i, t in rows)
    assert encode_documents(docs_of([]), content).count() == 0
    odd = spark.createDataFrame([(1, [50256, 99_999_999, -1]), (2, None), (3, [220, 447])], "doc_id long, ids array<int>")
    library = tokenizers.Tokenizer.from_str(content)
    assert [r.text for r in decode_documents(odd, content).orderBy("doc_id").collect()] == [
        "<|endoftext|>", "", library.decode([220, 447], skip_special_tokens=False),
    ]


def test_new_chunks_are_cut_together(content, monkeypatch):
    vocabulary = Vocabulary(content)
    calls = []
    cut = vocabulary.pieces
    monkeypatch.setattr(vocabulary, "pieces", lambda text: calls.append(text) or cut(text))
    some = [" ".join(f"w{i}x{j}<|endoftext|>y{'á' * (j % 3)}" for j in range(50)) for i in range(20)]
    ids, bounds = Encoder(vocabulary, None).encode(some)
    wanted = tokenizers.Tokenizer.from_str(content).encode_batch(some, add_special_tokens=False)
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(bounds, bounds[1:], wanted))
    assert len(calls) <= 1 + len(some)  # the first chunk of each text stands alone, the other 980 go together
