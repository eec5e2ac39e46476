import random

from pairgram.llm import decontaminate

from helpers import awkward, documents


def norm(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 0x7F:
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, found = norm(text), set(), set()
        for item, t in items:
            v = norm(t)
            n = min(len(v), window)
            grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} - {"None"}
        out.append((d, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def run(spark, docs, items, window=10):
    rows = decontaminate.report(documents(spark, docs), table(spark, items), window).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated)) for r in rows)


def test_every_window_length_against_brute_force(spark):
    random.seed(7)
    voc = ["a", "b", "C", "dé", "9"]
    text = lambda n: "".join(random.choice(voc) + random.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(random.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14]))) for i in range(25)] + [(3, "same id again"), (None, "b b b b b b b b b b")]
    docs = [(i, text(random.randint(0, 60))) for i in range(120)]
    docs += [(1000 + i, text(9) + (t or "") + " " + text(3)) for i, (_, t) in enumerate(items)]
    for window in (10, 4):
        assert run(spark, docs, items, window) == sorted(map(str, brute(docs, items, window)))


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = [(1, "q w e r t y u i o p a"), (2, "w e r")], [(5, "Q W-E R T Y U I O P"), (6, "nothing here")]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert run(spark, docs, items) == sorted(map(str, brute(docs, items)))


def test_awkward_rows(spark):
    rows, items = awkward(3_000), [(1, "lazy dog and runs far away from here today"), (1, "lazy dog and runs far away from here today"), (2, None), (3, " ... ")]
    assert run(spark, rows, items) == sorted(map(str, brute([r[:2] for r in rows], items)))
    docs = documents(spark, rows)
    kept = decontaminate.remove_documents(docs, table(spark, items))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert decontaminate.remove_documents(docs, table(spark, [])).count() == len(rows)
    assert decontaminate.report(documents(spark, []), table(spark, items)).count() == 0
