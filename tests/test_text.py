import random

import pytest
from pyspark.sql import functions as F

import reviewloom as rl
from reviewloom.functions.text import ngrams, rule_pos, stem, strip_punctuation, terms, tokens
from reviewloom.operators.lemmas import DOMAIN_STOP_WORDS, KEEP_POS
from reviewloom.operators.lookup import lookup_join

LEXICON = [
    ("bosses", "bos", "NOUN"), ("teams", "team", "NOUN"), ("the", "the", "DET"), ("friendly", "friendly", "ADJ"),
    ("great", "great", "ADJ"), ("'s", "'s", "PART"), ("boss", "bos", "PROPN"),
]


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("I can't, they'RE 'stop' it’s", ["i", "ca", "n't", "they", "'re", "stop", "it", "'s"]),
        ("Éte über_2 -- x.y", ["éte", "über_2", "x", "y"]),
        ("rock'n'roll o'clock", ["rock", "n", "roll", "o", "clock"]),
        (None, []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, tokens) == expected


def test_terms_need_two_characters_of_any_script(spark):
    assert one(spark, "A Été 中文字 b2_ x-ray", terms) == ["été", "中文字", "b2_", "ray"]


@pytest.mark.parametrize(
    "word, root",
    [("reviews", "review"), ("companies", "company"), ("boxes", "box"), ("boss", "boss"), ("bus", "bus"),
     ("working", "work"), ("worked", "work"), ("ring", "ring"), ("red", "red"), ("gas", "gas"), ("ties", "tie"),
     ("bosses", "boss"), ("classes", "class"), ("businesses", "business"), ("processes", "process"), ("making", "make"),
     ("loved", "love"), ("liked", "like"), ("caring", "care"), ("running", "run"), ("stopped", "stop"), ("hired", "hire"),
     ("hiring", "hire"), ("hire", "hire"), ("helped", "help"), ("trained", "train"), ("offered", "offer"),
     ("managed", "manage"), ("telling", "tell"), ("missed", "miss"), ("used", "use"), ("placed", "place"),
     ("created", "create"), ("string", "string"), ("speed", "speed"), ("need", "need"), ("improving", "improve")],
)
def test_stems(spark, word, root):
    assert one(spark, word, stem) == root


def test_parts_of_speech_and_punctuation(spark):
    words = ["the", "they", "and", "n't", "42", "quickly", "working", "famous", "desk"]
    found = [one(spark, w, rule_pos) for w in words]
    assert found == ["DET", "PRON", "CCONJ", "ADV", "NUM", "ADV", "VERB", "ADJ", "NOUN"]
    assert one(spark, "-'a.b'-", strip_punctuation) == "a.b"


def test_ngrams(spark):
    words = lambda n: lambda c: ngrams(F.split(c, " "), n)
    assert one(spark, "a b c d", words(2)) == ["a b", "b c", "c d"]
    assert one(spark, "a b c d", words(3)) == ["a b c", "b c d"]
    assert one(spark, "a", words(2)) == [] and one(spark, "a b", words(1)) == ["a", "b"]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(1, "The friendly teams, great BOSSES!", "a"), (2, None, "b"), (3, "the the", "c"), (4, "boss boss x", "d")]
    return spark.createDataFrame(rows, "doc_id long, review_text string, other string")


def test_lexicon_texts_keep_every_review_and_restore_boss(spark, reviews):
    lexicon = spark.createDataFrame(LEXICON, "token string, lemma string, pos string")
    rows = {r.doc_id: r.lemmatized_text for r in rl.lemmatize(reviews, lexicon).collect()}
    # 'bos' is a stop word, yet each such token adds one word at the end, whatever its part of speech
    assert rows == {1: "friendly team boss", 2: "", 3: "", 4: "x boss boss"}
    kept = rl.lemmatize(reviews, lexicon)
    assert set(kept.columns) == {"doc_id", "review_text", "other", "lemmatized_text"}


def test_rule_texts(reviews):
    rows = {r.doc_id: r.lemmatized_text for r in rl.lemmatize(reviews).collect()}
    assert rows == {1: "friendly team boss", 2: "", 3: "", 4: "boss boss x"}


def test_own_tagger(reviews):
    def tagger(words):
        return F.transform(words, lambda t: F.struct(F.upper(t).alias("lemma"), F.lit("NOUN").alias("pos")))

    rows = {r.doc_id: r.lemmatized_text for r in rl.lemmatize(reviews, tagger=tagger, stop_words=["BOSS"]).collect()}
    assert rows[4] == "X" and rows[3] == "THE THE"


def test_stop_words_never_survive(spark):
    rng = random.Random(1)
    words = [*DOMAIN_STOP_WORDS, "alpha", "beta", "gammas", "the", "i", "under", "2", "deltas"]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, review_text string")
    left = {w for r in rl.lemmatize(df).collect() for w in r.lemmatized_text.split()}
    assert left <= {"alpha", "beta", "gamma", "delta", "boss"} and "boss" in left
    assert set(KEEP_POS) == {"ADJ", "ADP", "ADV", "NOUN", "VERB"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_a_large_table_splits_hot_keys(spark, how):
    rng = random.Random(2)
    keys = ["hot"] * 3000 + [None] * 50 + [f"k{rng.randint(0, 3000)}" for _ in range(3000)] + ["unknown"] * 20
    facts = spark.createDataFrame(list(enumerate(keys)), "i long, key string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(3001)], "key string, v int")
    spread = lookup_join(facts, table, "key", how, max_bytes=0)
    plain = facts.join(table, "key", how)
    rows = lambda df: sorted(map(str, df.select("i", "key", "v").collect()))
    assert rows(spread) == rows(plain)
    weights = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert rows(lookup_join(facts, table, "key", how, max_bytes=0, key_rows=weights)) == rows(plain)


def test_lemmas_by_a_large_lexicon(spark, reviews, monkeypatch):
    from reviewloom.operators import lemmas

    lexicon = spark.createDataFrame(LEXICON, "token string, lemma string, pos string")
    broadcast = sorted(rl.lemma_tokens(reviews, lexicon).collect())
    monkeypatch.setattr(
        lemmas, "lookup_join", lambda *args: lookup_join(*args, max_bytes=0)
    )
    assert sorted(rl.lemma_tokens(reviews, lexicon).collect()) == broadcast
