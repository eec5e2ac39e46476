import hashlib
import random

from pairgram.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, source string, level int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_hostile_texts(spark):
    random.seed(9)
    parts = [*chat.CONTROL, "\\", "\n", "\\n", "<", "/s>", "s>", "[", "INST]", "0", "1", "a", "é", "\U0001f600", "\x01", "$1", "\\s", ""]
    text = lambda n: "".join(random.choice(parts) for _ in range(random.randint(0, n)))
    rows = []
    for c in range(150):
        for t in range(random.randint(1, 5)):
            rows.append((c, t, random.choice(["user", "assistant", "system", "assistant", text(4), None]), random.choice([text(8), text(3), "plain", None])))
    formatted = chat.format_conversations(table(spark, rows))
    for r in formatted.collect():
        turns = r.formatted.split("</s>")
        assert [r.formatted[m.start:m.end] for m in r.loss_mask] == [turns[m.turn][m.at:] for m in r.loss_mask]
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for c, r in got.items():
        assert r.roundtrip_ok, c
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[c], [x for x in rows if x[0] == c]


def test_control_strings_stand_only_where_the_grammar_puts_them(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", "plain")]
    f = chat.format_conversations(table(spark, rows)).first()
    assert f.formatted.count("</s>") == 3 and f.formatted.count("[INST]") == 2 and "[/INST]" not in f.formatted
    assert f.formatted.endswith("<s>[INST]0user\nplain</s>")
    assert [f.formatted[m.start:m.end] for m in f.loss_mask] == ["<\\/s>[\\INST] ok [\\/INST]"]


def test_ties_nulls_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first"),
            (None, 0, "assistant", "x" * 100_000), (None, 1, None, None), (2, 0, "", "")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(table(spark, rows))).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.format_conversations(table(spark, []))).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s>" * (t % 3)) for t in range(30_000)]
    r = chat.read_back(chat.format_conversations(table(spark, rows))).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(rows)[1] and r.roundtrip_ok
