"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

from pairgram.llm import chat, sharding

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sharding_sql(limit: int = sharding.SHARD_BYTES) -> str:
    """The shortest prefix that fits, tried at every depth (no pages: doc_id is unique in the tables)."""
    return f"""
    WITH k AS (
      SELECT doc_id, strlen(coalesce(text, '')) + 1 AS n_bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
      FROM documents),
    b AS (
      SELECT d, h >> (60 - d) AS p, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
      FROM k, (SELECT CAST(range AS INTEGER) AS d FROM range(61)) GROUP BY d, h >> (60 - d)
      HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)),
    f AS (
      SELECT k.doc_id, k.n_bytes, b.d, b.p, b.shard_bytes, b.shard_rows,
             row_number() OVER (PARTITION BY k.doc_id ORDER BY b.d) AS nr
      FROM k JOIN b ON b.p = k.h >> (60 - b.d))
    SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard,
           d AS depth, shard_bytes, shard_rows
    FROM f WHERE nr = 1"""


def warc_sql() -> str:
    return """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
    FROM f"""


def _escaped(col: str) -> str:
    out = f"replace({col}, chr(92), chr(92) || chr(92))"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}' || chr(92) || '{s[1:]}')"
    return out


def chat_sql() -> str:
    hit = " OR ".join(f"contains(text, '{s}') OR contains(role, '{s}')" for s in chat.CONTROL)
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    u AS (SELECT *, ({hit} OR contains(role, chr(10))) AS hard FROM t),
    v AS (
      SELECT *, 3 + CASE WHEN role = 'user' THEN 6 ELSE 0 END + 1 + 1 + 4
        + CASE WHEN hard THEN length(replace({_escaped('role')}, chr(10), chr(92) || 'n')) ELSE length(role) END
        + CASE WHEN hard THEN length({_escaped('text')}) ELSE length(text) END AS n
      FROM u)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(n) AS BIGINT) AS formatted_chars, true AS roundtrip_ok
    FROM v GROUP BY conv_id"""


def decontaminate_sql(window: int = 10) -> str:
    words = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), "
             r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
    g AS (
      SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(list_slice(w, s, s + least(len(w), {window}) - 1), ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS s FROM i WHERE len(w) > 0)),
    p AS (
      SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS gram
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
    h AS (SELECT DISTINCT r, s, n, item FROM p JOIN g USING (n, gram)),
    c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
    m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""


def quality_sql() -> str:
    """Base columns, references and distances from the definitions; every class by its own pattern."""
    count = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    named = {"lower": r"\p{Ll}", "space": r"[\x20\x09-\x0D]", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "symbol": r"[#*$%&|<>]",
             "punctuation": r"[.,;:!?''\"()\-]"}
    classes = ", ".join(f"{count(p)} AS c_{c}" for c, p in named.items())
    total = " + ".join(f"c_{c}" for c in named)
    unpivoted = " UNION ALL ".join(
        f"SELECT r, lang, base_failed, '{c}' AS k, {e} / greatest(length(t), 1) AS p FROM b"
        for c, e in [*((c, f"c_{c}") for c in named), ("other", f"(length(t) - ({total}))")])
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) / 2 ELSE 0 END"
    js = f"sqrt(greatest(sum({half('p', 'q')} + {half('q', 'p')}), 0))"
    return rf"""
    WITH d AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    g AS (
      SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM (
        SELECT r, i, list_slice(w, i, i + 4) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))),
    rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM g WHERE n > 1) GROUP BY r),
    l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    b0 AS (
      SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {classes}
      FROM d JOIN l USING (r) LEFT JOIN rep USING (r)),
    b AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b0),
    cl AS MATERIALIZED ({unpivoted}),
    cref AS (SELECT lang, k, avg(p) AS q FROM cl WHERE NOT base_failed GROUP BY lang, k),
    cd AS (SELECT cl.r, {js} AS class_distance FROM cl JOIN cref ON cref.k = cl.k AND cref.lang IS NOT DISTINCT FROM cl.lang GROUP BY cl.r),
    wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY lang, word),
    top AS MATERIALIZED (
      SELECT lang, word, q FROM (
        SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS q, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS nr FROM wc)
      WHERE nr <= 20),
    dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
    h0 AS MATERIALIZED (
      SELECT d.r, d.lang, top.q, coalesce(dw.n, 0) / greatest(len(d.w), 1) AS p
      FROM d JOIN top ON top.lang IS NOT DISTINCT FROM d.lang LEFT JOIN dw ON dw.r = d.r AND dw.word = top.word),
    h AS (SELECT r, p, q FROM h0 UNION ALL SELECT r, greatest(1 - sum(p), 0), 1 - sum(q) FROM h0 GROUP BY r),
    wd AS (SELECT r, {js} AS word_distance FROM h GROUP BY r)
    SELECT doc_id, n_words, word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
           round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, base_failed,
           NOT base_failed AND NOT (n_words >= 30 AND (coalesce(class_distance, 0) > 0.12 + 0.9 / sqrt(greatest(n_words, 1))
             OR coalesce(word_distance, 0) > 0.26 + 0.8 / sqrt(greatest(n_words, 1)))) AS kept
    FROM b LEFT JOIN cd USING (r) LEFT JOIN wd USING (r)"""


def suffix_sql(length: int = 200) -> str:
    """All windows of the texts' bytes, in hexadecimal digits."""
    return f"""
    WITH d AS MATERIALIZED (
      SELECT row_number() OVER () AS r, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (
      SELECT r, i, md5(substr(x, 2 * i - 1, {2 * length})) AS g
      FROM (SELECT r, x, unnest(range(1, n - {length} + 2)) AS i FROM d WHERE n >= {length})),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
    e AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM twice),
    s AS (
      SELECT r, min(i) AS a, max(i) + {length} AS b
      FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS nr FROM e) GROUP BY r, nr),
    k AS (
      SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS b FROM s
      UNION ALL SELECT r, max(b), max(n) + 1 FROM s JOIN d USING (r) GROUP BY r),
    t AS (SELECT r, string_agg(substr(x, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r),
    c AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM s GROUP BY r)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, x))) AS kept_sha256
    FROM d LEFT JOIN t USING (r) LEFT JOIN c USING (r)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    bits = (f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: list_transform(range(0, 8), "
            f"lambda k: (CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT) >> k) & 1)))")
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384), 4294967295), 4294967295)"


def resample_sql(buckets: int = 10_000) -> str:
    words = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), "
             r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    x AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d),
    y AS MATERIALIZED (SELECT unnest({words}) AS word FROM benchmark),
    v AS MATERIALIZED (SELECT word, {crc32_sql('word')} % {buckets} AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y)),
    s AS (SELECT bucket, count(*) AS n FROM x JOIN v USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM y JOIN v USING (word) GROUP BY bucket),
    g AS MATERIALIZED (
      SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM x) + {buckets}))
                                  / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM y) + {buckets})))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    c AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM x JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
    e AS (
      SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM d LEFT JOIN c USING (r)),
    f AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM e LEFT JOIN f USING (r)"""


def trie_sql(group: int = 5, heads: int = 9) -> str:
    """Rebuilt conversations as lists of turns; a subtree's nodes are those whose sequence begins with the node's."""
    return f"""
    WITH t AS (
      SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    h AS (SELECT c, own, CAST({crc32_sql('CAST(c AS VARCHAR)')} % {heads} AS BIGINT) AS h FROM t),
    b AS MATERIALIZED (
      SELECT h.c, list_concat(coalesce(t.own[1:h], []), h.own[h + 1:]) AS s FROM h LEFT JOIN t ON t.c = h.c - h.c % {group}),
    e AS MATERIALIZED (
      SELECT c, d, md5(CAST(to_json(s[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(s[1:d - 1]) AS VARCHAR)) END AS pk,
             CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS bytes, d = len(s) AS is_end
      FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
    n AS MATERIALIZED (
      SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(pk) AS pk, any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256
      FROM e GROUP BY k, d),
    ch AS (SELECT pk AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY pk, d - 1),
    x AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k, d)),
    sub AS (
      SELECT e.k, e.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens
      FROM x JOIN e ON e.c = x.conv_id AND e.d <= x.d GROUP BY e.k, e.d)
    SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
    FROM x JOIN sub USING (k, d) LEFT JOIN n p ON p.k = x.pk AND p.d = x.d - 1"""


ORACLE = {
    "op1_sharding": sharding_sql(),
    "op5_quality_rules": quality_sql(),
    "op6_suffix_array_dedup": suffix_sql(),
    "op7_warc": warc_sql(),
    "op8_chat_formatting": chat_sql(),
    "op10_benchmark_decontamination": decontaminate_sql(),
    "op11_prefix_trie": trie_sql(),
    "op12_importance_resampling": resample_sql(),
}
