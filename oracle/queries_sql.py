"""Oracle SQL per registered query name."""

from __future__ import annotations

from oracle import duck as D

WORD = ("word1", "word2", "word3", "stem1", "stem2", "stem3")
CHAR = ("char1", "char2", "char3", "cstem1", "cstem2", "cstem3")
POS = ("pos1", "pos2", "pos3")

METRIC_COLUMNS = {
    "gram_counts": (WORD, "count_1, count_2, unique_1, unique_2, unique_ratio_1, unique_ratio_2"),
    "digit_counts": (("word1", "stem1"), "digit_count_1, digit_count_2, digit_ratio_1, digit_ratio_2"),
    "gram_containment": (WORD, "count_1_in_2, count_2_in_1, ratio_1_in_2, ratio_2_in_1"),
    "common_grams": (WORD + CHAR + POS, "common"),
    "jaccard": (WORD, "jaccard"),
    "dice": (WORD, "dice"),
    "sorensen": (WORD + CHAR + POS, "sorensen"),
    "bag_cosine": (WORD + CHAR + POS, "cosine"),
    "gram_prf": (WORD + CHAR + POS, "precision, recall, f1"),
}

ORACLE: dict[str, str] = {}

for _name, (_fams, _cols) in METRIC_COLUMNS.items():
    ORACLE[_name] = D.with_ctes(*D.gram_ctes(_fams), body=f"SELECT conv_id, turn, family, {_cols} FROM met")


# ------------------------------------------------------------------ helpers ----

def side_rows(e1: str, e2: str, value: str, src: str = "pairs") -> str:
    return (f"SELECT conv_id, turn, side, CAST(generate_subscripts(l, 1) AS INTEGER) AS pos, unnest(l) AS {value} "
            f"FROM (SELECT conv_id, turn, 1 AS side, {e1} AS l FROM {src} "
            f"UNION ALL SELECT conv_id, turn, 2 AS side, {e2} AS l FROM {src})")


def grams_with(families, body: str) -> str:
    return D.with_ctes(*D.gram_ctes(families), body=body)


def _q(*ctes, body):
    return D.with_ctes(*ctes, body=body)


# ---------------------------------------------------------------- text (T) ----

ORACLE["tokenize"] = _q(D.PAIRS, body=side_rows(D.tok("raw_1"), D.tok("raw_2"), "token"))
ORACLE["tokenize_case"] = _q(D.PAIRS, body=side_rows(D.tok_case("raw_1"), D.tok_case("raw_2"), "token"))
ORACLE["tokenize_alpha"] = _q(D.PAIRS, body=side_rows(D.alpha("raw_1"), D.alpha("raw_2"), "token"))
ORACLE["tokens_stem"] = _q(D.PAIRS, body=side_rows(D.stems("raw_1"), D.stems("raw_2"), "token"))
ORACLE["sentence_stem"] = _q(D.PAIRS, body=(
    f"SELECT conv_id, turn, array_to_string({D.stems('raw_1')}, ' ') AS stem_1, "
    f"array_to_string({D.stems('raw_2')}, ' ') AS stem_2 FROM pairs"))
ORACLE["stem_vocabulary"] = (
    f"SELECT token, {D.stem_word('token')} AS stem FROM "
    f"(SELECT DISTINCT unnest({D.alpha('text')}) AS token FROM conversations)")
ORACLE["tweet_words"] = _q(D.PAIRS, body=side_rows(D.tweet_words("raw_1"), D.tweet_words("raw_2"), "word"))

# ------------------------------------------------------------- n-grams (N) ----

_GRAM_COLS = "SELECT conv_id, turn, family, side, CAST(pos AS INTEGER) AS pos, gram FROM grams"
ORACLE["word_ngrams"] = grams_with(("word1", "word2", "word3"), _GRAM_COLS)
ORACLE["char_ngrams"] = grams_with(("char1", "char2", "char3"), _GRAM_COLS)
ORACLE["tag_ngrams"] = grams_with(("pos2", "pos3", "ner2", "ner3", "event2", "event3"), _GRAM_COLS)
_ITEMS = ("items AS MATERIALIZED (SELECT conv_id, turn, side, generate_subscripts(l, 1) AS i, unnest(l) AS x, len(l) AS size FROM ("
          f"SELECT conv_id, turn, 1 AS side, {D.tok('sent_1')} AS l FROM pairs UNION ALL SELECT conv_id, turn, 2, {D.tok('sent_2')} FROM pairs))")
ORACLE["skip_bigrams"] = _q(D.PAIRS, _ITEMS, body=D.skip_grams(2, 1))
ORACLE["skip_trigrams"] = _q(D.PAIRS, _ITEMS, body=D.skip_grams(3, 1))


def _char_set(a: str, n: int) -> str:
    return f"list_distinct(flatten(list_transform({a}, lambda w: {D.chars('w', n)})))"


def _word_set(a: str, n: int) -> str:
    return f"list_distinct({D.windows(a, n)})"


_SETS = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{name}' AS feature, {gen('tw_1', n)} AS s1, {gen('tw_2', n)} AS s2 FROM tw"
    for name, gen, n in (("C1", _char_set, 1), ("C2", _char_set, 2), ("V1", _word_set, 1), ("V2", _word_set, 2)))
ORACLE["ngram_set_features"] = _q(
    D.PAIRS,
    f"tw AS (SELECT conv_id, turn, {D.tweet_words('raw_1')} AS tw_1, {D.tweet_words('raw_2')} AS tw_2 FROM pairs)",
    f"sets AS ({_SETS})",
    "sw AS (SELECT conv_id, turn, feature, CASE WHEN len(s1) > len(s2) THEN s2 ELSE s1 END AS sm, "
    "CASE WHEN len(s1) > len(s2) THEN s1 ELSE s2 END AS lg FROM sets)",
    body="SELECT conv_id, turn, feature, CAST(len(sm) AS BIGINT) AS size_small, CAST(len(lg) AS BIGINT) AS size_large, "
         "CAST(len(list_intersect(sm, lg)) AS BIGINT) AS n_inter, "
         "CAST(len(list_distinct(list_concat(sm, lg))) AS BIGINT) AS n_union, "
         "CAST(len(list_filter(sm, lambda x: NOT list_contains(lg, x))) AS BIGINT) AS n_small_only, "
         "CAST(len(list_filter(lg, lambda x: NOT list_contains(sm, x))) AS BIGINT) AS n_large_only FROM sw")

# ------------------------------------------------------ labels (P, S, J) ----

_TEST_LABEL = "CASE WHEN vote IN (4, 5) THEN 1 WHEN vote = 3 THEN 2 ELSE 0 END"
_JUDGE = "'(' || CAST(vote AS VARCHAR) || ', ' || CAST(5 - vote AS VARCHAR) || ')'"
ORACLE["label_train"] = _q(D.PAIRS, D.VOTES, body=(
    f"SELECT conv_id, turn, judge, CASE WHEN f >= 3 THEN 1 WHEN f = 2 THEN 2 ELSE 0 END AS is_paraphrase FROM "
    f"(SELECT conv_id, turn, {_JUDGE} AS judge, CAST(regexp_extract({_JUDGE}, '^\\s*\\(\\s*(\\d+)', 1) AS INTEGER) AS f "
    f"FROM votes)"))
ORACLE["label_test"] = _q(D.PAIRS, D.VOTES, body=f"SELECT conv_id, turn, vote, {_TEST_LABEL} AS is_paraphrase FROM votes")
ORACLE["drop_ambiguous"] = _q(D.PAIRS, D.VOTES, body=(
    f"SELECT p.conv_id, p.turn, p.trend_id, {_TEST_LABEL} AS is_paraphrase FROM pairs p JOIN votes v USING (conv_id, turn) "
    f"WHERE {_TEST_LABEL} <> 2"))
ORACLE["numeric_projection"] = _q(D.PAIRS, D.VOTES, body=(
    f"SELECT p.conv_id, p.turn, p.trend_id, v.vote, {_TEST_LABEL} AS is_paraphrase FROM pairs p JOIN votes v USING (conv_id, turn)"))
ORACLE["missing_flags"] = _q(D.PAIRS, body=(
    f"SELECT conv_id, turn, CAST(len({D.tok('sent_1')}) = 0 AS INTEGER) AS missing_1, "
    f"CAST(len({D.tok('sent_2')}) = 0 AS INTEGER) AS missing_2 FROM pairs"))
ORACLE["gold_join"] = _q(D.PAIRS, D.VOTES, body=(
    "SELECT p.trend_id AS trendid, NULLIF(p.sent_1, '') AS origsent, NULLIF(p.sent_2, '') AS candsent, vote AS label, "
    "CASE WHEN vote >= 4 THEN 'true' WHEN vote = 3 THEN '----' ELSE 'false' END AS ans, "
    f"{D.r6('vote / 5.0')} AS prob FROM pairs p JOIN votes v USING (conv_id, turn)"))
ORACLE["scan_pairs"] = _q(D.PAIRS, D.TAGGED, D.VOTES, body=(
    "SELECT p.trend_id AS trendid, 'conv ' || CAST(p.trend_id AS VARCHAR) AS trendname, "
    f"NULLIF(t.sent_1, '') AS origsent, NULLIF(t.sent_2, '') AS candsent, {_JUDGE} AS judge, "
    "NULLIF(t.tags_1, '') AS origsenttag, NULLIF(t.tags_2, '') AS candsenttag "
    "FROM pairs p JOIN tagged t USING (conv_id, turn) JOIN votes v USING (conv_id, turn)"))

# -------------------------------------------------------- positions (D) ----

_SHARED = [
    "g2 AS (SELECT *, max(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, family, gram) AS on1, "
    "max(CASE WHEN side = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, family, gram) AS on2 FROM grams)",
    "g3 AS (SELECT *, CASE WHEN side = 1 THEN on2 = 1 ELSE on1 = 1 END AS shared FROM g2)",
]
ORACLE["gram_positions"] = D.with_ctes(*D.gram_ctes(WORD), *_SHARED, body=(
    "SELECT conv_id, turn, family, side, CAST(pos AS INTEGER) AS pos FROM g3 WHERE shared"))
_h = "CASE WHEN shared THEN pos END"
_ps = (f"ps AS (SELECT conv_id, turn, family, side, CAST(count(gram) AS BIGINT) AS n, "
       f"CAST(min({_h}) AS DOUBLE) AS s_min, CAST(max({_h}) AS DOUBLE) AS s_max, avg({_h}) AS s_mean, "
       f"CAST(median({_h}) AS DOUBLE) AS s_median, stddev_pop({_h}) AS s_std FROM (SELECT DISTINCT conv_id, turn, family, side FROM fl) "
       "LEFT JOIN g3 USING (conv_id, turn, family, side) GROUP BY conv_id, turn, family, side)")
_pcols = ", ".join(
    f"{D.r6(f'coalesce(s_{s}, 0.0)')} AS pos_{s}, {D.r6(D.sdiv(f'coalesce(s_{s}, 0.0)', 'n'))} AS norm_pos_{s}"
    for s in ("min", "max", "mean", "median", "std"))
ORACLE["position_stats"] = D.with_ctes(*D.gram_ctes(WORD), *_SHARED, _ps,
                                       body=f"SELECT conv_id, turn, family, side, {_pcols} FROM ps")

# ------------------------------------------------------------- tags (G) ----

ORACLE["parse_tags"] = _q(D.PAIRS, D.TAGGED, (
    "tr AS (" + side_rows("list_filter(string_split(coalesce(tags_1, ''), ' '), lambda x: x <> '')",
                          "list_filter(string_split(coalesce(tags_2, ''), ' '), lambda x: x <> '')",
                          "t", src="tagged") + ")"),
    body="SELECT conv_id, turn, side, pos, string_split(lower(t), '/')[1] AS word, string_split(lower(t), '/')[2] AS ner, "
         "string_split(lower(t), '/')[3] AS pos_tag, string_split(lower(t), '/')[4] AS chunk, "
         "string_split(lower(t), '/')[5] AS event FROM tr")
ORACLE["tag_context"] = _q(D.PAIRS, D.TAGGED, (
    f"tt AS (SELECT conv_id, turn, 1 AS side, {D.tok('sent_1')} AS toks, {D.tag_field('tags_1', 2)} AS tgs FROM tagged "
    f"UNION ALL SELECT conv_id, turn, 2, {D.tok('sent_2')}, {D.tag_field('tags_2', 2)} FROM tagged)"),
    "ti AS (SELECT conv_id, turn, side, toks, tgs, unnest(range(1, len(toks) + 1)) AS i FROM tt WHERE len(toks) = len(tgs))",
    body="SELECT conv_id, turn, side, CAST(i AS INTEGER) AS pos, toks[i] AS token, tgs[i] AS tag, "
         "CASE WHEN i > 1 THEN tgs[i - 1] ELSE 'phi' END AS left_tag, "
         "CASE WHEN i < len(tgs) THEN tgs[i + 1] ELSE 'phi' END AS right_tag FROM ti")
ORACLE["tag_similarity"] = grams_with(POS, "SELECT conv_id, turn, family, common, sorensen, cosine, precision, recall, f1 FROM met")
ORACLE["common_event"] = grams_with(("event1",), "SELECT conv_id, turn, common AS common_event FROM met")
ORACLE["common_ner"] = grams_with(("ner1",), "SELECT conv_id, turn, common AS common_ner FROM met")

# ---------------------------------------------------------- metrics (M) ----

ORACLE["binary_metrics"] = D.with_ctes(
    *D.gram_ctes(("word1",)), D.VOTES,
    f"lab AS (SELECT conv_id, turn, {_TEST_LABEL} AS label FROM votes)",
    "sc AS (SELECT l.label, CAST(coalesce(m.jaccard, 0.0) > 0.2 AS INTEGER) AS prediction "
    "FROM lab l LEFT JOIN met m USING (conv_id, turn) WHERE l.label <> 2)",
    "ct AS (SELECT CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp, "
    "CAST(count_if(label <> 1 AND prediction = 1) AS BIGINT) AS fp, "
    "CAST(count_if(label = 1 AND prediction <> 1) AS BIGINT) AS fn, "
    "CAST(count_if(label <> 1 AND prediction <> 1) AS BIGINT) AS tn FROM sc)",
    "pr AS (SELECT *, " + D.sdiv("tp", "tp + fp") + " AS p, " + D.sdiv("tp", "tp + fn") + " AS r FROM ct)",
    body="SELECT tp, fp, fn, tn, " + D.r6("p") + " AS precision, " + D.r6("r") + " AS recall, "
         + D.r6(D.sdiv("2 * p * r", "p + r")) + " AS f1, " + D.r6(D.sdiv("tp + tn", "tp + fp + fn + tn"))
         + " AS accuracy FROM pr")

# ----------------------------------------------------- corpus stats (F) ----

_STOP = "[" + ", ".join(D.lit(w) for w in D.STOP_WORDS) + "]"
_DOCS = ("docs AS (SELECT {conv_id: conv_id, turn: turn, side: 1} AS doc_id, array_to_string(" + D.stems("sent_1") + ", ' ') AS text FROM pairs "
         "UNION ALL SELECT {conv_id: conv_id, turn: turn, side: 2}, array_to_string(" + D.stems("sent_2") + ", ' ') FROM pairs)")


def _terms(src: str, name: str) -> list[str]:
    toks = (f"list_filter(regexp_extract_all({D.strip_accents('lower(coalesce(text, ' + chr(39) * 2 + '))')}, "
            f"{D.lit(D.WORD)}), lambda t: NOT list_contains({_STOP}, t))")
    return [
        f"{name}_tok AS (SELECT doc_id, {toks} AS toks FROM {src})",
        f"{name}_terms AS (SELECT doc_id, unnest(list_concat(toks, {D.windows('toks', 2)}, {D.windows('toks', 3)})) "
        f"AS term FROM {name}_tok)",
    ]


_FIT = [D.PAIRS, _DOCS, *_terms("docs", "fit"),
        "vocab AS (SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM fit_terms GROUP BY term "
        "HAVING count(DISTINCT doc_id) >= 3)",
        "ndocs AS (SELECT count(*) AS n FROM docs)",
        "idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab, ndocs)"]


def _weights(terms: str) -> list[str]:
    return [f"tf AS (SELECT doc_id, term, count(*) AS tf FROM {terms} GROUP BY doc_id, term)",
            "tw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term))"]


_WBODY = f"SELECT doc_id, term, {D.r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM tw"
ORACLE["tfidf_vocab"] = D.with_ctes(*_FIT, body="SELECT term, df FROM vocab")
ORACLE["tfidf_idf"] = D.with_ctes(*_FIT, body=f"SELECT term, {D.r6('idf')} AS idf FROM idf")
ORACLE["tfidf_weights"] = D.with_ctes(*_FIT, *_weights("fit_terms"), body=(
    f"SELECT doc_id.conv_id AS conv_id, doc_id.turn AS turn, doc_id.side AS side, term, weight FROM ({_WBODY})"))
ORACLE["tfidf_transform"] = D.with_ctes(
    *_FIT,
    "dd AS (SELECT doc_id, array_to_string(" + D.stems("text") + ", ' ') AS text FROM documents)",
    *_terms("dd", "tr"), *_weights("tr_terms"), body=_WBODY)
ORACLE["label_encode"] = D.with_ctes(D.PAIRS, body=(
    "SELECT conv_id, turn, CAST(dense_rank() OVER (ORDER BY sent_1) - 1 AS BIGINT) AS sent_1_code FROM pairs"))

_STOP_TABLE = f"stops AS (SELECT DISTINCT word FROM (SELECT unnest({D.lower_words('text')}) AS word FROM benchmark) WHERE length(word) <= 5)"
ORACLE["tfidf_stop_table"] = D.with_ctes(
    D.PAIRS, _DOCS, _STOP_TABLE,
    f"each AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all({D.strip_accents('lower(text)')}, {D.lit(D.WORD)}) AS l FROM docs))",
    "kept AS (SELECT doc_id, list(t ORDER BY i) AS toks FROM each WHERE t NOT IN (SELECT word FROM stops) GROUP BY doc_id)",
    f"terms AS (SELECT DISTINCT doc_id, unnest(list_concat(toks, {D.windows('toks', 2)}, {D.windows('toks', 3)})) AS term FROM kept)",
    body=f"SELECT term, {D.r6('ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1')} AS idf FROM terms GROUP BY term HAVING count(*) >= 3")


def _text_columns() -> dict[str, str]:
    out = {"trend": "'conv ' || trend_id"}
    for i in (1, 2):
        out |= {f"sent_{i}": f"sent_{i}", f"tags_{i}": f"tags_{i}", f"tag_{i}": f"array_to_string(pos_{i}, ' ')", f"stem_{i}": f"array_to_string(stok_{i}, ' ')"}
        out |= {f"{f}_{i}": f"array_to_string({D.family_list(f, i)}, chr(31))" for f in WORD + CHAR + POS}
    return out


ORACLE["label_encode_frame"] = D.with_ctes(
    D.PAIRS, D.TAGGED, D.BASE,
    "frame AS MATERIALIZED (SELECT conv_id, turn, " + ", ".join(f"{e} AS {c}" for c, e in _text_columns().items())
    + " FROM base JOIN (SELECT conv_id, turn, trend_id FROM pairs) USING (conv_id, turn) JOIN (SELECT conv_id, turn, tags_1, tags_2 FROM tagged) USING (conv_id, turn))",
    body="SELECT conv_id, turn, " + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS {c}_code" for c in _text_columns()) + " FROM frame")

# ------------------------------------------------- lexical network (W) ----

_FREQ = (f"freq AS (SELECT word, CAST(count(*) AS BIGINT) AS n FROM "
         f"(SELECT unnest({D.tok('text')}) AS word FROM documents) GROUP BY word)")
ORACLE["corpus_freq"] = D.with_ctes(_FREQ, body="SELECT word, n FROM freq")
ORACLE["information_content"] = D.with_ctes(
    _FREQ, "tot AS (SELECT sum(n) AS t FROM freq)",
    f"cw AS (SELECT DISTINCT unnest({D.tok('text')}) AS word FROM conversations)",
    body=f"SELECT cw.word, {D.r6('1.0 - ln(coalesce(f.n, 0) + 1) / ln(t + 1)')} AS ic "
         "FROM cw LEFT JOIN freq f USING (word), tot")

_CLOSURE = [
    D.HYPERNYMS,
    "nodes AS (SELECT child AS node FROM hypernyms UNION SELECT parent FROM hypernyms)",
    "clos(node, ancestor, dist) AS (SELECT node, node, 0 FROM nodes UNION ALL "
    "SELECT c.node, h.parent, c.dist + 1 FROM clos c JOIN hypernyms h ON c.ancestor = h.child)",
    "closure AS MATERIALIZED (SELECT node, ancestor, CAST(min(dist) AS INTEGER) AS dist FROM clos "
    "GROUP BY node, ancestor)",
]
ORACLE["hypernym_closure"] = D.with_ctes(*_CLOSURE, body="SELECT node, ancestor, dist FROM closure", recursive=True)

_WP = ("wp AS (SELECT DISTINCT w[i] AS word_1, w[i + 1] AS word_2 FROM "
       f"(SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {D.lower_words('text')} AS w FROM conversations)))")
_SENSE = [
    _WP, D.LEMMAS,
    "sp AS MATERIALIZED (SELECT wp.word_1, wp.word_2, l1.synset AS s1, l1.rank AS r1, l2.synset AS s2, l2.rank AS r2 "
    "FROM wp JOIN lemmas l1 ON l1.word = wp.word_1 JOIN lemmas l2 ON l2.word = wp.word_2)",
    "x1 AS MATERIALIZED (SELECT x.s1, x.s2, c1.ancestor, c1.dist AS d1 FROM (SELECT DISTINCT s1, s2 FROM sp) x "
    "JOIN closure c1 ON c1.node = x.s1)",
    "paths AS MATERIALIZED (SELECT x1.s1, x1.s2, min(x1.d1 + c2.dist) AS path, max(greatest(x1.d1, c2.dist)) AS h "
    "FROM x1 JOIN closure c2 ON c2.node = x1.s2 AND c2.ancestor = x1.ancestor GROUP BY x1.s1, x1.s2)",
    "best AS (SELECT * FROM (SELECT sp.word_1, sp.word_2, sp.s1, sp.s2, p.path, p.h, row_number() OVER "
    "(PARTITION BY sp.word_1, sp.word_2 ORDER BY p.path, sp.r1, sp.r2, sp.s1, sp.s2) AS rn FROM sp JOIN paths p "
    "ON p.s1 = sp.s1 AND p.s2 = sp.s2) WHERE rn = 1)",
]
ORACLE["synset_path"] = D.with_ctes(*_CLOSURE, *_SENSE, recursive=True, body=(
    f"SELECT s1, s2, path, {D.r6('1.0 / (1.0 + path)')} AS path_similarity FROM paths"))
ORACLE["best_synset_pair"] = D.with_ctes(*_CLOSURE, *_SENSE, recursive=True, body=(
    f"SELECT word_1, word_2, s1, s2, path, {D.r6('1.0 / (1.0 + path)')} AS path_similarity FROM wp LEFT JOIN best USING (word_1, word_2)"))
ORACLE["word_similarity"] = D.with_ctes(
    *_CLOSURE, *_SENSE,
    "lo AS (SELECT DISTINCT a.synset AS s1, b.synset AS s2 FROM lemmas a JOIN lemmas b ON a.word = b.word)",
    "sc AS (SELECT b.word_1, b.word_2, exp(-0.2 * CASE WHEN b.s1 = b.s2 THEN 0.0 WHEN lo.s1 IS NOT NULL THEN 1.0 "
    "ELSE CAST(b.path AS DOUBLE) END) AS lf, tanh(0.45 * b.h) AS df FROM best b "
    "LEFT JOIN lo ON lo.s1 = b.s1 AND lo.s2 = b.s2)",
    recursive=True,
    body=(f"SELECT w.word_1, w.word_2, {D.r6('coalesce(lf, 0.0)')} AS length_factor, "
          f"{D.r6('coalesce(df, 0.0)')} AS depth_factor, {D.r6('coalesce(lf, 0.0) * coalesce(df, 0.0)')} AS similarity "
          "FROM wp w LEFT JOIN sc USING (word_1, word_2)"))

# ------------------------------------------- sentence similarity (W10-W15) ----

_JOINT = [
    D.PAIRS,
    f"sw AS (SELECT conv_id, turn, side, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM ("
    f"SELECT conv_id, turn, 1 AS side, {D.lower_words('sent_1')} AS l FROM pairs UNION ALL "
    f"SELECT conv_id, turn, 2, {D.lower_words('sent_2')} FROM pairs))",
    "joint AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY at_1 NULLS LAST, at_2) AS INTEGER) AS idx "
    "FROM (SELECT conv_id, turn, word, min(i) FILTER (side = 1) AS at_1, min(i) FILTER (side = 2) AS at_2 FROM sw GROUP BY conv_id, turn, word))",
    "ew AS MATERIALIZED (SELECT conv_id, turn, word, idx, 1 AS side, at_1 IS NOT NULL AS has FROM joint "
    "UNION ALL SELECT conv_id, turn, word, idx, 2, at_2 IS NOT NULL FROM joint)",
    "ask AS MATERIALIZED (SELECT a.conv_id, a.turn, a.side, a.word, b.word AS v FROM ew a LEFT JOIN ew b "
    "ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.side = a.side AND b.has WHERE NOT a.has)",
    "wp AS MATERIALIZED (SELECT DISTINCT word AS word_1, v AS word_2 FROM ask WHERE v IS NOT NULL)",
    *_CLOSURE, *_SENSE[1:],
    "lo AS (SELECT DISTINCT a.synset AS s1, b.synset AS s2 FROM lemmas a JOIN lemmas b ON a.word = b.word)",
    "ws AS MATERIALIZED (SELECT b.word_1, b.word_2, " + D.r6("exp(-0.2 * CASE WHEN b.s1 = b.s2 THEN 0.0 WHEN lo.s1 IS NOT NULL THEN 1.0 "
    "ELSE CAST(b.path AS DOUBLE) END) * tanh(0.45 * b.h)") + " AS similarity FROM best b LEFT JOIN lo ON lo.s1 = b.s1 AND lo.s2 = b.s2)",
    "ms AS MATERIALIZED (SELECT conv_id, turn, side, word, first(v ORDER BY s DESC, v) AS sim_word, max(s) AS similarity FROM ("
    "SELECT a.*, coalesce(ws.similarity, 0.0) AS s FROM ask a LEFT JOIN ws ON ws.word_1 = a.word AND ws.word_2 = a.v WHERE a.v IS NOT NULL) "
    "GROUP BY conv_id, turn, side, word UNION ALL SELECT conv_id, turn, side, word, '', -1.0 FROM ask WHERE v IS NULL)",
]
_VECTORS = [
    _FREQ, "tot AS (SELECT sum(n) AS t FROM freq)",
    "ic AS MATERIALIZED (SELECT word, 1.0 - ln(coalesce(n, 0) + 1) / ln(t + 1) AS ic FROM (SELECT DISTINCT word FROM joint) LEFT JOIN freq USING (word), tot)",
    "sv AS MATERIALIZED (SELECT conv_id, turn, side, word, value, value * a.ic * coalesce(b.ic, 0.0) AS value_ic FROM ("
    "SELECT e.*, CASE WHEN has THEN 1.0::DOUBLE WHEN similarity > 0.2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS value, CASE WHEN has THEN word ELSE sim_word END AS stands "
    "FROM ew e LEFT JOIN ms USING (conv_id, turn, side, word)) x JOIN ic a USING (word) LEFT JOIN ic b ON b.word = x.stands)",
    "ov AS MATERIALIZED (SELECT e.conv_id, e.turn, e.side, e.word, CASE WHEN has THEN e.idx WHEN similarity > 0.4 THEN j.idx ELSE 0 END AS value FROM ew e "
    "LEFT JOIN ms m ON m.conv_id = e.conv_id AND m.turn = e.turn AND m.side = e.side AND m.word = e.word "
    "LEFT JOIN joint j ON j.conv_id = e.conv_id AND j.turn = e.turn AND j.word = m.sim_word)",
]


def _cosine(v: str) -> str:
    return D.sdiv(f"sum(a.{v} * b.{v})", f"sqrt(sum(a.{v} * a.{v})) * sqrt(sum(b.{v} * b.{v}))")


_FACING = "FROM {0} a JOIN {0} b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.word = a.word AND a.side = 1 AND b.side = 2 GROUP BY a.conv_id, a.turn"
_SEMANTIC = f"SELECT a.conv_id, a.turn, {_cosine('value')} AS semantic, {_cosine('value_ic')} AS semantic_ic " + _FACING.format("sv")
_ORDER = ("SELECT a.conv_id, a.turn, 1.0 - " + D.sdiv("sqrt(sum((a.value - b.value) ** 2))", "sqrt(sum((a.value + b.value) ** 2))")
          + " AS word_order " + _FACING.format("ov"))


def _sentence(body: str) -> str:
    return D.with_ctes(*_JOINT, *_VECTORS, body=body, recursive=True)


ORACLE["most_similar_word"] = _sentence("SELECT conv_id, turn, side, word, sim_word, CAST(similarity AS DOUBLE) AS similarity FROM ms")
ORACLE["semantic_vector"] = _sentence(f"SELECT conv_id, turn, side, word, value, {D.r6('value_ic')} AS value_ic FROM sv")
ORACLE["semantic_similarity"] = _sentence(f"SELECT conv_id, turn, {D.r6('semantic')} AS semantic, {D.r6('semantic_ic')} AS semantic_ic FROM ({_SEMANTIC})")
ORACLE["word_order_vector"] = _sentence("SELECT * FROM ov")
ORACLE["word_order_similarity"] = _sentence(f"SELECT conv_id, turn, {D.r6('word_order')} AS word_order FROM ({_ORDER})")
ORACLE["sentence_similarity"] = _sentence(
    f"SELECT conv_id, turn, {D.r6('semantic')} AS semantic, {D.r6('semantic_ic')} AS semantic_ic, {D.r6('word_order')} AS word_order, "
    f"{D.r6('0.85 * semantic + 0.15 * word_order')} AS similarity, {D.r6('0.85 * semantic_ic + 0.15 * word_order')} AS similarity_ic FROM ("
    "SELECT conv_id, turn, coalesce(semantic, 0.0) AS semantic, coalesce(semantic_ic, 0.0) AS semantic_ic, coalesce(word_order, 1.0) AS word_order "
    f"FROM pairs LEFT JOIN ({_SEMANTIC}) USING (conv_id, turn) LEFT JOIN ({_ORDER}) USING (conv_id, turn))")

ORACLE["precomputed_similarity"] = f"SELECT conv_id, turn, similarity, similarity_ic FROM ({ORACLE['sentence_similarity']})"
ORACLE["features_with_similarity"] = (
    f"SELECT conv_id, turn, jaccard, cosine, f1, similarity, similarity_ic FROM ({grams_with(('word1',), 'SELECT conv_id, turn, jaccard, cosine, f1 FROM met')}) "
    f"LEFT JOIN ({ORACLE['sentence_similarity']}) USING (conv_id, turn)")

# ------------------------------------------------- model and evaluation ----

from pairgram.plans.model_plan import dense_feature_names  # noqa: E402  (names only: a fixed spec)

_DENSE = "dense(j, name) AS (VALUES " + ", ".join(f"({i}, {D.lit(n)})" for i, n in enumerate(dense_feature_names())) + ")"
ORACLE["feature_map"] = D.with_ctes(
    *_FIT, "ix AS (SELECT term, dense_rank() OVER (ORDER BY term) - 1 AS i FROM vocab)",
    "vs AS (SELECT count(*) AS v FROM vocab)", _DENSE,
    body="SELECT CAST(i AS BIGINT) AS idx, 'tfidf_1:' || term AS name, 'q' AS q FROM ix "
         "UNION ALL SELECT CAST(i + v AS BIGINT), 'tfidf_2:' || term, 'q' FROM ix, vs "
         "UNION ALL SELECT CAST(2 * v + j AS BIGINT), name, 'q' FROM dense, vs")

from pairgram.plans import model_plan as MP  # noqa: E402  (feature names only)


def _cells(src: str, prefix: str, metrics, where: str = "true") -> str:
    """``conv_id, turn, name, value`` rows of metric columns."""
    cells = ", ".join(f"{{n: {prefix} || '{m}', v: CAST({m} AS DOUBLE)}}" for m in metrics)
    return f"SELECT conv_id, turn, c.n AS name, c.v AS value FROM (SELECT conv_id, turn, unnest([{cells}]) AS c FROM {src} WHERE {where})"


def _in(families) -> str:
    return "family IN (" + ", ".join(D.lit(f) for f in families) + ")"


_MATRIX = [
    *D.gram_ctes(MP.OVERLAP_FAMILIES + MP.TAG_COMMON),
    "wf AS (SELECT * FROM grams WHERE " + _in(WORD) + ")",
    *[c.replace("FROM grams", "FROM wf") for c in _SHARED],
    _ps.replace("FROM fl)", "FROM fl WHERE " + _in(WORD) + ")"),
    f"pst AS (SELECT conv_id, turn, family, side, {_pcols} FROM ps)",
    "lab AS MATERIALIZED (SELECT doc_id AS conv_id, max(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)",
    f"mf AS (SELECT conv_id, turn, len({D.tok('sent_1')}) = 0 AS missing_1, len({D.tok('sent_2')}) = 0 AS missing_2 FROM pairs)",
    *_FIT[1:], *_weights("fit_terms"), f"wt AS (SELECT doc_id, term, weight FROM ({_WBODY}))",
    "ix AS MATERIALIZED (SELECT term, dense_rank() OVER (ORDER BY term) - 1 AS i FROM vocab)",
    "vs AS (SELECT count(*) AS v FROM vocab)", _DENSE,
    "dc AS MATERIALIZED (" + " UNION ALL ".join([
        _cells("met", "family || '_'", MP.OVERLAP_METRICS, _in(MP.OVERLAP_FAMILIES)),
        _cells("met", "family || '_'", MP.DIGIT_METRICS, _in(MP.DIGIT_FAMILIES)),
        _cells("met", "family || '_'", ["common"], _in(MP.TAG_COMMON)),
        _cells("pst", "family || '_' || side || '_'", MP.POSITION_METRICS),
        _cells("mf", "''", ["missing_1", "missing_2"])]) + ")",
    "mx AS MATERIALIZED (SELECT e.* FROM ("
    "SELECT conv_id, turn, CAST(2 * v + j AS BIGINT) AS idx, value FROM dc JOIN dense USING (name), vs "
    "UNION ALL SELECT doc_id.conv_id, doc_id.turn, CAST(i + (doc_id.side - 1) * v AS BIGINT), weight FROM wt JOIN ix USING (term), vs) e "
    "JOIN lab USING (conv_id) WHERE value <> 0)",
]
ORACLE["feature_matrix"] = D.with_ctes(*_MATRIX, body="SELECT conv_id, turn, idx, value FROM mx")
# an edit distance is zero where both lists are equal, and only there
ORACLE["assemble"] = D.with_ctes(
    *_MATRIX, "eq AS (SELECT x.conv_id, x.turn, count(*) AS n FROM fl x JOIN fl y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.family = y.family "
    f"AND x.side = 1 AND y.side = 2 WHERE x.lst <> y.lst AND x.{_in(MP.EDIT_FAMILIES)} GROUP BY x.conv_id, x.turn)",
    "nz AS (SELECT conv_id, turn, count(*) AS n FROM mx GROUP BY conv_id, turn)",
    body="SELECT p.conv_id, p.turn, CAST(l.label AS INTEGER) AS label, CAST(2 * v + (SELECT count(*) FROM dense) AS INTEGER) AS n_features, "
         "CAST(coalesce(nz.n, 0) + coalesce(eq.n, 0) AS INTEGER) AS nnz FROM pairs p JOIN lab l USING (conv_id) "
         "LEFT JOIN nz USING (conv_id, turn) LEFT JOIN eq USING (conv_id, turn), vs")

# ------------------------------------------------------------- streaming ----

ORACLE["stream_turn_features"] = (
    f"SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_tokens, "
    f"CAST(len(list_filter(t, lambda x: regexp_full_match(x, '\\p{{L}}+'))) AS BIGINT) AS n_alpha, "
    f"CAST(len(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+'))) AS BIGINT) AS n_digit, "
    f"CAST(len(list_distinct({D.chars('text', 3)})) AS BIGINT) AS n_char3 "
    f"FROM (SELECT conv_id, turn, text, {D.tok('text')} AS t FROM conversations)")

# ------------------------------------------------------ edit distance (E) ----

_BIG = 1 << 32


def edit_distance_sql(families) -> str:
    """Levenshtein over the longest optimal alignment, one row of the table per step.

    A cell is v = distance * 2^32 - alignment length, so its minimum is the least
    distance and then the longest alignment; an edit adds 2^32 - 1, a match -1. The
    insert step along a row is a running minimum of v less its offset.
    """
    k = _BIG - 1
    return D.with_ctes(
        *D.gram_ctes(families)[:4],
        """ab AS MATERIALIZED (
  SELECT row_number() OVER () AS id, x.conv_id, x.turn, x.family,
    list_transform(CASE WHEN len(x.lst) <= len(y.lst) THEN x.lst ELSE y.lst END, lambda g: hash(g)) AS a,
    list_transform(CASE WHEN len(x.lst) <= len(y.lst) THEN y.lst ELSE x.lst END, lambda g: hash(g)) AS b
  FROM fl x JOIN fl y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.family = y.family AND x.side = 1 AND y.side = 2)""",
        "open AS MATERIALIZED (SELECT id, a, b, len(a) AS n, len(b) AS m FROM ab WHERE a <> b AND len(a) > 0)",
        f"""dp(id, i, j, v) AS (
  SELECT id, 0, j, j * {k}::BIGINT FROM (SELECT id, unnest(range(0, m + 1)) AS j FROM open)
  UNION ALL
  SELECT id, i + 1, j, min(t - j * {k}) OVER (PARTITION BY id ORDER BY j) + j * {k} FROM (
    SELECT d.id, d.i, d.j, CASE WHEN d.j = 0 THEN (d.i + 1) * {k}::BIGINT ELSE least(d.v + {k},
      lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + CASE WHEN o.a[d.i + 1] = o.b[d.j] THEN -1 ELSE {k} END) END AS t
    FROM dp d JOIN open o USING (id) WHERE d.i < o.n))""",
        f"ends AS (SELECT id, v, (v + {k}) // {_BIG} AS d FROM dp JOIN open USING (id) WHERE i = n AND j = m)",
        recursive=True,
        body=("SELECT conv_id, turn, family, CASE WHEN a = b THEN 0.0 WHEN len(a) = 0 THEN 1.0 "
              f"ELSE {D.r6(f'd / CAST(d * {_BIG} - v AS DOUBLE)')} END AS levenshtein FROM ab LEFT JOIN ends USING (id)"))


ORACLE["edit_distance_word"] = edit_distance_sql(WORD)
ORACLE["edit_distance_tag"] = edit_distance_sql(POS)
