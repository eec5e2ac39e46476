"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written from the operator definitions, not generated from the Spark
plans. Helpers below return SQL *expressions*; ``with_ctes`` stitches the shared
fixture CTEs in front of a final SELECT. Tables are the driver's views.
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see pairgram.functions.text).
WORD = r"[\p{L}\p{N}_]+"
SPACE = r" \t\n\r\f\x0B"
WORD_PUNCT = WORD + "|" + r"[^\p{L}\p{N}_" + SPACE + r"]+"
NON_SPACE = r"[^" + SPACE + r"]+"
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
UNACCENTED = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"
STOP_WORDS = ["the", "and", "of", "in", "to", "is", "der", "die", "und", "le", "la", "de", "el"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def sdiv(x: str, y: str) -> str:
    return f"(CASE WHEN ({y}) IS NULL OR ({y}) = 0 THEN 0.0 ELSE CAST({x} AS DOUBLE) / CAST({y} AS DOUBLE) END)"


# ---------------------------------------------------------------- text ----

def tok(s: str) -> str:
    """Lower-cased word-punct tokens."""
    return f"regexp_extract_all(lower(coalesce({s}, '')), {lit(WORD_PUNCT)})"


def tok_case(s: str) -> str:
    return f"regexp_extract_all(coalesce({s}, ''), {lit(WORD_PUNCT)})"


def words(s: str) -> str:
    return f"regexp_extract_all(coalesce({s}, ''), {lit(WORD)})"


def lower_words(s: str) -> str:
    return f"regexp_extract_all(lower(coalesce({s}, '')), {lit(WORD)})"


def alpha(s: str) -> str:
    return f"list_filter({tok(s)}, lambda t: regexp_full_match(t, '\\p{{L}}+'))"


def stem_word(w: str) -> str:
    return (f"(CASE WHEN length({w}) >= 3 AND ends_with({w}, 'ies') AND NOT ends_with({w}, 'eies') "
            f"AND NOT ends_with({w}, 'aies') THEN regexp_replace({w}, 'ies$', 'y') "
            f"WHEN length({w}) >= 3 AND ends_with({w}, 'es') AND NOT ends_with({w}, 'aes') "
            f"AND NOT ends_with({w}, 'ees') AND NOT ends_with({w}, 'oes') THEN regexp_replace({w}, 'es$', 'e') "
            f"WHEN length({w}) >= 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'us') "
            f"AND NOT ends_with({w}, 'ss') THEN regexp_replace({w}, 's$', '') ELSE {w} END)")


def stems(s: str) -> str:
    return f"list_transform({alpha(s)}, lambda w: {stem_word('w')})"


def tweet_words(s: str) -> str:
    return (f"list_transform(regexp_extract_all(coalesce({s}, ''), {lit(NON_SPACE)}), "
            f"lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g'))")


def strip_accents(s: str) -> str:
    return f"translate({s}, {lit(ACCENTED)}, {lit(UNACCENTED)})"


# -------------------------------------------------------------- n-grams ----

def bigram(a: str, join: str = "_") -> str:
    return f"(CASE WHEN len({a}) < 2 THEN {a} ELSE {windows(a, 2, join)} END)"


def trigram(a: str, join: str = "_") -> str:
    return f"(CASE WHEN len({a}) < 3 THEN {bigram(a, join)} ELSE {windows(a, 3, join)} END)"


def skip_grams(n: int, skip: int) -> str:
    """Rows of the skip grams of ``items(conv_id, turn, side, i, x, size)`` by joining places; short lists have fewer items a gram."""
    def rows(k: int, where: str) -> str:
        gram = " || '_' || ".join(f"t{j}.x" for j in range(k))
        joins = " ".join(f"JOIN items t{j} ON t{j}.conv_id = t0.conv_id AND t{j}.turn = t0.turn AND t{j}.side = t0.side "
                         f"AND t{j}.i - t{j - 1}.i BETWEEN 1 AND {skip + 1}" for j in range(1, k))
        order = ", ".join(f"t{j}.i" for j in range(k))
        return (f"SELECT t0.conv_id, t0.turn, t0.side, CAST(row_number() OVER (PARTITION BY t0.conv_id, t0.turn, t0.side ORDER BY {order}) AS INTEGER) AS pos, "
                f"{gram} AS gram FROM items t0 {joins} WHERE {where}")

    parts = [rows(k, f"t0.size = {k}") for k in range(1, n)] + [rows(n, f"t0.size >= {n}")]
    return " UNION ALL ".join(parts)


def ngram(a: str, n: int) -> str:
    return {1: a, 2: bigram(a), 3: trigram(a)}[n]


def chars(s: str, n: int) -> str:
    s = f"coalesce({s}, '')"
    return (f"(CASE WHEN length({s}) >= {n} THEN list_transform(range(1, length({s}) - {n} + 2), "
            f"lambda i: substr({s}, i, {n})) ELSE []::VARCHAR[] END)")


def windows(a: str, n: int, join: str = " ") -> str:
    if n == 1:
        return a
    parts = f" || '{join}' || ".join(f"{a}[i + {k + 1}]" for k in range(n))
    return (f"(CASE WHEN len({a}) >= {n} THEN list_transform(range(0, len({a}) - {n} + 1), lambda i: {parts}) "
            f"ELSE []::VARCHAR[] END)")


# ----------------------------------------------------------------- tags ----

def tag_sentence(s: str) -> str:
    w = "w"
    ner = f"(CASE WHEN length({w}) % 7 = 0 THEN 'B-person' WHEN length({w}) % 11 = 0 THEN 'B-geo-loc' ELSE 'O' END)"
    pos = (f"(CASE WHEN ends_with({w}, 'ing') THEN 'VBG' WHEN ends_with({w}, 'ed') THEN 'VBD' "
           f"WHEN ends_with({w}, 'tion') THEN 'NN' WHEN length({w}) <= 3 THEN 'DT' "
           f"WHEN {w} <> lower({w}) THEN 'NNP' ELSE 'JJ' END)")
    ev = f"(CASE WHEN ends_with({w}, 'ed') OR ends_with({w}, 'ing') THEN 'B-EVENT' ELSE 'O' END)"
    return (f"array_to_string(list_transform(list_filter(string_split(coalesce({s}, ''), ' '), lambda w: w <> ''), "
            f"lambda w: w || '/' || {ner} || '/' || {pos} || '/B-NP/' || {ev}), ' ')")


def tag_field(t: str, index: int, drop_o: bool = False) -> str:
    e = (f"list_transform(list_filter(string_split(coalesce({t}, ''), ' '), lambda x: x <> ''), "
         f"lambda x: string_split(lower(x), '/')[{index + 1}])")
    return f"list_filter({e}, lambda v: v <> 'o')" if drop_o else e


# ------------------------------------------------------------- fixtures ----

PAIRS = f"""pairs AS (
  SELECT b.conv_id, b.turn, a.conv_id AS trend_id, a.text AS raw_1, b.text AS raw_2,
         array_to_string({words('a.text')}, ' ') AS sent_1,
         array_to_string({words('b.text')}, ' ') AS sent_2
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

TAGGED = f"""tagged AS (
  SELECT conv_id, turn, sent_1, sent_2, {tag_sentence('sent_1')} AS tags_1, {tag_sentence('sent_2')} AS tags_2 FROM pairs)"""

VOTES = f"""votes AS (
  SELECT conv_id, turn, CAST(least(5, len(list_intersect({lower_words('sent_1')}, {lower_words('sent_2')}))) AS INTEGER) AS vote
  FROM pairs)"""

WORDS = f"""cwords AS (SELECT DISTINCT unnest({lower_words('text')}) AS word FROM conversations)"""

HYPERNYMS = WORDS + """,
hypernyms AS (
  SELECT DISTINCT child, parent FROM (
    SELECT 'w:' || word AS child, 'p3:' || substr(word, 1, 3) AS parent FROM cwords
    UNION ALL SELECT 'p3:' || substr(word, 1, 3), 'p2:' || substr(word, 1, 2) FROM cwords
    UNION ALL SELECT 'p2:' || substr(word, 1, 2), 'p1:' || substr(word, 1, 1) FROM cwords
    UNION ALL SELECT 'p1:' || substr(word, 1, 1), 'root' FROM cwords))"""

LEMMAS = """lemmas AS (
  SELECT word, 'w:' || word AS synset, 1 AS rank FROM cwords
  UNION ALL SELECT word, 'p3:' || substr(word, 1, 3), 2 FROM cwords)"""


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------- gram tables ----

def family_list(fam: str, side: int) -> str:
    """The family's list for one side, from the base lists of the ``base`` CTE."""
    kind, n = fam[:-1], int(fam[-1])
    if kind == "char":
        return chars(f"sent_{side}", n)
    if kind == "cstem":
        return chars(f"ssent_{side}", n)
    col = {"word": "tok", "stem": "stok", "pos": "pos", "ner": "ner", "event": "ev"}[kind]
    return ngram(f"{col}_{side}", n)


BASE = ("base AS MATERIALIZED (SELECT conv_id, turn, sent_1, sent_2, "
        + ", ".join(f"{tok(f'sent_{i}')} AS tok_{i}, {stems(f'sent_{i}')} AS stok_{i}, "
                    f"array_to_string({stems(f'sent_{i}')}, ' ') AS ssent_{i}, "
                    f"{tag_field(f'tags_{i}', 2)} AS pos_{i}, {tag_field(f'tags_{i}', 1, True)} AS ner_{i}, "
                    f"{tag_field(f'tags_{i}', 4, True)} AS ev_{i}" for i in (1, 2))
        + " FROM tagged)")


def gram_ctes(families) -> list[str]:
    """pairs -> tagged -> fl (family lists) -> grams -> gc -> st (sums) -> met (metrics)."""
    fl = "\n    UNION ALL ".join(
        f"SELECT conv_id, turn, '{f}' AS family, {side} AS side, {family_list(f, side)} AS lst FROM base"
        for f in families for side in (1, 2))
    digit = "regexp_full_match(gram, '[0-9]+')"
    st = f"""st AS (
  SELECT conv_id, turn, family,
    CAST(coalesce(sum(ca), 0) AS BIGINT) AS count_1, CAST(coalesce(sum(cb), 0) AS BIGINT) AS count_2,
    CAST(count_if(ca > 0) AS BIGINT) AS unique_1, CAST(count_if(cb > 0) AS BIGINT) AS unique_2,
    CAST(count_if(ca > 0 AND cb > 0) AS BIGINT) AS n_inter, CAST(count(gram) AS BIGINT) AS n_union,
    CAST(coalesce(sum(least(ca, cb)), 0) AS BIGINT) AS common,
    CAST(sum(CASE WHEN cb > 0 THEN ca ELSE 0 END) AS BIGINT) AS count_1_in_2,
    CAST(sum(CASE WHEN ca > 0 THEN cb ELSE 0 END) AS BIGINT) AS count_2_in_1,
    CAST(sum(CASE WHEN {digit} THEN ca ELSE 0 END) AS BIGINT) AS digit_count_1,
    CAST(sum(CASE WHEN {digit} THEN cb ELSE 0 END) AS BIGINT) AS digit_count_2,
    CAST(coalesce(sum(ca * cb), 0) AS BIGINT) AS dot, CAST(coalesce(sum(ca * ca), 0) AS BIGINT) AS sq_1,
    CAST(coalesce(sum(cb * cb), 0) AS BIGINT) AS sq_2
  FROM (SELECT DISTINCT conv_id, turn, family FROM fl) LEFT JOIN gc USING (conv_id, turn, family)
  GROUP BY conv_id, turn, family)"""
    p = sdiv("n_inter", "unique_1")
    r = sdiv("n_inter", "unique_2")
    dice = sdiv("2 * n_inter", "unique_1 + unique_2")
    met = f"""met AS (
  SELECT conv_id, turn, family, count_1, count_2, unique_1, unique_2,
    {r6(sdiv('unique_1', 'count_1'))} AS unique_ratio_1, {r6(sdiv('unique_2', 'count_2'))} AS unique_ratio_2,
    digit_count_1, digit_count_2,
    {r6(sdiv('digit_count_1', 'count_1'))} AS digit_ratio_1, {r6(sdiv('digit_count_2', 'count_2'))} AS digit_ratio_2,
    count_1_in_2, count_2_in_1,
    {r6(sdiv('count_1_in_2', 'count_1'))} AS ratio_1_in_2, {r6(sdiv('count_2_in_1', 'count_2'))} AS ratio_2_in_1,
    common,
    {r6(sdiv('n_inter', 'n_union'))} AS jaccard,
    {r6(dice)} AS dice,
    {r6(f"CASE WHEN unique_1 + unique_2 = 0 THEN 0.0 ELSE 1.0 - {dice} END")} AS sorensen,
    {r6(sdiv('dot', 'sqrt(sq_1) * sqrt(sq_2)'))} AS cosine,
    {r6(p)} AS precision, {r6(r)} AS recall,
    {r6(sdiv(f'2 * {p} * {r}', f'{p} + {r}'))} AS f1
  FROM st)"""
    return [
        PAIRS, TAGGED, BASE,
        f"fl AS (\n    {fl})",
        "grams AS (SELECT conv_id, turn, family, side, generate_subscripts(lst, 1) AS pos, unnest(lst) AS gram FROM fl)",
        "gc AS (SELECT conv_id, turn, family, gram, count_if(side = 1) AS ca, count_if(side = 2) AS cb "
        "FROM grams GROUP BY conv_id, turn, family, gram)",
        st, met,
    ]
