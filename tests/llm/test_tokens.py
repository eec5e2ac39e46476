import random

import pytest
from pairgram.llm import tokens

from helpers import awkward, documents


def reference(pieces, byte_fallback):
    """The tokenizers library with the same vocabulary over uncut texts: no training, no merges."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    low = min(s for _, s in pieces)
    extra = [(f"<0x{i:02X}>", low) for i in range(256)] if byte_fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *extra], 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.SPACE_MARK, prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


TEXTS = ["", "a", " ", "  ", "hello world", " lead", "trail ", "tab\tnew\nline", "漢字 und Bär", "\U0001f600\U0001f600 x", "▁ mark▁", "aaaaaaaaaaaaaaaa", "a" * 5000 + " b",
         "def f():\n    return 1", "a  b   c    d", "x" * 70 + "  " + "y" * 70, "   ", " ▁ a▁▁b", "one\n\n        two\t  three "]


def test_counts_equal_the_tokenizer_on_the_public_vocabulary():
    pieces, fallback = tokens.load_vocabulary()
    count, want = tokens.PieceCounter(pieces, fallback), reference(pieces, fallback)
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("abcdehiorst  é漢\n-1") for _ in range(random.randint(1, 60))) for _ in range(400)]
    assert [count.text(t) for t in texts] == [want(t) for t in texts]


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_go_to_the_piece_that_starts_first(fallback):
    random.seed(2)
    voc = sorted({"".join(random.choice("ab▁") for _ in range(random.randint(1, 4))) for _ in range(25)} - {"a"})
    pieces = [(p, -float(random.randint(1, 3))) for p in voc]
    count, want = tokens.PieceCounter(pieces, fallback), reference(pieces, fallback)
    for _ in range(600):
        t = "".join(random.choice("aabbc ") for _ in range(random.randint(1, 14)))
        assert count.text(t) == want(t), t


def test_runs_of_spaces_are_pieces():
    pieces, fallback = tokens.load_vocabulary()
    assert tokens.PieceCounter(pieces, fallback).text("def f():\n    return 1") == 9


def test_arrow_batches_equal_single_texts():
    import pyarrow as pa

    pieces, fallback = tokens.load_vocabulary()
    count = tokens.PieceCounter(pieces, fallback)
    texts = [None, *TEXTS, *TEXTS]
    assert count.texts(pa.array(texts)).tolist() == [count.text(t) for t in texts]
    whole = tokens.PieceCounter([*pieces, ("a▁b", -1.0)], fallback)
    assert not whole.cuts and count.cuts
    assert whole.texts(pa.array(texts)).tolist() == list(map(reference([*pieces, ("a▁b", -1.0)], fallback), texts))


def test_state_does_not_grow_with_a_part():
    import tracemalloc

    pieces, fallback = tokens.load_vocabulary()
    count, text = tokens.PieceCounter(pieces, fallback), "漢字" * 100_000
    tracemalloc.start()
    assert count.text(text) > 0 and not count.seen
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 10)
    c = tokens.PieceCounter([("a", -1.0), ("▁", -1.0)], True)
    assert c.text(" ".join("a" * i for i in range(1, 60))) == sum(i + 1 for i in range(1, 60)) and len(c.seen) <= 10


def test_awkward_rows(spark):
    rows = awkward(2_000)
    pieces, fallback = tokens.load_vocabulary()
    out = tokens.count_tokens(documents(spark, rows), pieces, fallback).collect()
    want = reference(pieces, fallback)
    assert sorted(str((r.doc_id, r.n_tokens)) for r in out) == sorted(str((r[0], want(r[1]))) for r in rows)
    assert tokens.count_tokens(documents(spark, []), pieces, fallback).count() == 0
