import hashlib
import zlib

from pairgram.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, f1 string, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, group=5, heads=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    built = {c: own.get(c - c % group, [])[:h[c]] + own[c][h[c]:] for c in own}
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, of in members.items():
        under = [n for n in members if n[:len(node)] == node]
        leaves = sum(not any(m[:-1] == n and m for m in under) for n in under)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in of if len(built[c]) == len(node))))
        kids = sum(1 for n in members if n and n[:-1] == node)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids, leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest(), node[-1] if node else (None, None)))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = table(spark, rows)
    nodes = trie.turns_of(trie.prefix_trie(df, **how), df)
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, (r.role, r.text))
                   for r in nodes.collect()), key=str)


def conversations():
    rows = []
    for c in range(40):
        for t in range(c % 12):
            rows.append((c * (1 if c % 7 else 3), t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < 4 else t * (c % 3)} é"))
    return rows


def test_against_rebuilt_texts(spark):
    rows = conversations()
    assert run(spark, rows) == brute(rows)


def test_other_groups_and_heads(spark):
    rows = conversations()
    assert run(spark, rows, group=3, heads=4) == brute(rows, 3, 4)


def test_a_conversation_over_many_partitions_and_copies(spark):
    rows = [(10, t, "user", f"t{t % 5}") for t in range(3000)]
    rows += [(c, t, "user", f"t{t % 5}") for c in range(50, 80) for t in range(10)]
    rows += [(500, 1, "user", "same")] * 700
    parts = trie.prefix_sums(trie.references(table(spark, rows), 1).selectExpr(
        "conv", "turn", "r1", "r2", "octet_length(text) * 1L n_bytes", "monotonically_increasing_id() tie"), trie.bases(1))
    got = {(r.conv, r.pos): (r.u1, r.u2) for r in parts.collect()}
    assert sorted(p for c, p in got if c == 10) == list(range(1, 3001)) and sorted(p for c, p in got if c == 500) == list(range(1, 701))
    # the sum up to a place is that of the same turns elsewhere
    assert all(got[(10, p)] == got[(50, p)] for p in range(1, 11))
    nodes = trie.prefix_trie(table(spark, rows))
    deepest = nodes.filter("conv_id = 10 AND n_children = 0").collect()
    assert [r.depth for r in deepest] == [3000]
    root = nodes.filter("depth = 0").first()
    assert root.n_convs == 32 and root.n_leaves == nodes.filter("n_children = 0").count()


def test_equal_references_of_different_turns_are_found_and_done_again(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(4) for t in range(3)]
    turns = trie.references(table(spark, rows), 1, bits=2)
    assert not trie.references_hold(turns) and trie.references_hold(trie.references(table(spark, rows), 1))
    nodes = trie.prefix_trie(table(spark, rows), bits=6).drop("r1", "r2", "seed").collect()
    assert sorted(map(tuple, nodes), key=str) == sorted((r[:-1] for r in brute(rows)), key=str)


def test_awkward_rows(spark):
    rows = [(1, None, None, "null turn first"), (1, 0, "user", None), (1, 1, None, None), (None, 0, "user", "no conversation"), (5, 0, "a", "bc"),
            (6, 0, "ab", "c"), (10, 0, "user", "twice"), (10, 0, "user", "twice"), (11, 7, "user", "漢" * 5000), (12, -3, "", ""), (25, 0, "user", "x" * 100_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    assert run(spark, [(3, None, None, None)]) == brute([(3, None, None, None)])
