import hashlib

from reviewloom.llm.chat_format import chat_windows, conversation_digests, read_turns


def talk(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window long")


ROWS = [
    (1, 0, "system", "be <|end|>\n kind & [INST]"),
    *((1, i, "user" if i % 2 else "assistant", f"<|user|>\nturn {i} " + "w " * (40 * (i % 7))) for i in range(1, 60)),
    (2, 0, "user", None),
    (2, 0, None, "tie"),
    (2, 1, "assistant", "&lt;|end|&gt;"),
    (3, None, "assistant", "long " * 60_000),
    (3, 1, "assistant", ""),
    (None, 1, "user", "no id"),
    (None, 1, "user", "no id"),
    (4, 0, "system", "only"),
]


def test_round_trip(spark):
    found = {r.conv_id: r for r in conversation_digests(chat_windows(talk(spark, ROWS))).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    for conv, r in found.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in ROWS if c == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_budget_system_and_history(spark):
    windows = read_turns(chat_windows(talk(spark, ROWS), budget=512, history=64)).orderBy("conv_id", "window").collect()
    one = [w for w in windows if w.conv_id == 1]
    assert len(one) > 3 and all(w.tokens <= 512 and not w.over_budget for w in one)
    assert all("be &lt;|end|&gt;" in w.formatted for w in one)
    assert sum(w.n_new for w in one) == 60 and any(w.n_repeated > 1 for w in one)
    assert any(w.over_budget for w in windows if w.conv_id == 3)
    for w in one:
        for span, target in zip(w.loss_spans, w.targets):
            cut = w.formatted[span.start : span.start + span.length]
            assert cut.replace("&#91;", "[").replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&") == target


def test_empty(spark):
    assert conversation_digests(chat_windows(talk(spark, ROWS).filter("false"))).count() == 0
