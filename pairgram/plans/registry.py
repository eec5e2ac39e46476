"""Named queries, one per operator of the inventory; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgram.keys import PAIR
from pairgram.functions import ngrams as ng
from pairgram.functions import porter2
from pairgram.functions import text as tx
from pairgram.functions.safe import r6
from pairgram.joins import join_unique
from pairgram.operators import grams as G
from pairgram.operators import labels as L
from pairgram.operators import tags as T
from pairgram.operators.distance import edit_distance
from pairgram.operators.metrics import binary_metrics
from pairgram.operators.overlap import ngram_set_features, overlap_metrics, pair_gram_stats
from pairgram.operators.positions import gram_positions, position_stats
from pairgram.plans import features as FP
from pairgram.session import checkpointed, shared_dir, stored
from pairgram.sources import fixtures as fx
from pairgram.sources import precomputed as PC
from pairgram.sources import tsv

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


for _group in FP.FAMILIES_FOR:
    QUERIES[_group] = FP.metric_query(_group)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FP.tagged_pairs(spark, sf_dir)


def _side_rows(pairs: DataFrame, arr_1, arr_2, value: str) -> DataFrame:
    """``conv_id, turn, side, pos, <value>`` from one array per side (pos is 1-based)."""
    sides = F.array(F.struct(F.lit(1).alias("side"), arr_1.alias("a")),
                    F.struct(F.lit(2).alias("side"), arr_2.alias("a")))
    return (pairs.select(*PAIR, F.inline(sides))
            .select(*PAIR, "side", F.posexplode_outer("a").alias("p0", value))
            .filter(F.col("p0").isNotNull())
            .select(*PAIR, "side", (F.col("p0") + 1).alias("pos"), value))


# ------------------------------------------------------------ text (T) ----

@query
def tokenize(spark, sf_dir):
    """T1 on the raw turns (punctuation runs are tokens)."""
    p = _pairs(spark, sf_dir)
    return _side_rows(p, tx.word_punct_tokens("raw_1"), tx.word_punct_tokens("raw_2"), "token")


@query
def tokenize_case(spark, sf_dir):
    """Tokens with their case kept."""
    p = _pairs(spark, sf_dir)
    return _side_rows(p, tx.word_punct_tokens("raw_1", lower=False), tx.word_punct_tokens("raw_2", lower=False), "token")


@query
def tokenize_alpha(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return _side_rows(p, tx.alpha_tokens("raw_1"), tx.alpha_tokens("raw_2"), "token")


@query
def tokens_stem(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return _side_rows(p, tx.stemmed_alpha_tokens("raw_1"), tx.stemmed_alpha_tokens("raw_2"), "token")


@query
def sentence_stem(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select(*PAIR, tx.stemmed_sentence("raw_1").alias("stem_1"),
                    tx.stemmed_sentence("raw_2").alias("stem_2"))


@query
def stem_vocabulary(spark, sf_dir):
    """T5 as a vocabulary job: distinct alphabetic tokens, stemmed once each."""
    conv = fx.read_table(spark, sf_dir, "conversations", ["text"])
    vocab = conv.select(F.explode_outer(tx.alpha_tokens("text")).alias("token")).filter("token IS NOT NULL").distinct()
    return vocab.select("token", tx.s_stem(F.col("token")).alias("stem"))


@query
def tokens_porter2(spark, sf_dir):
    """T5 with the Porter2 stemmer: the vocabulary is stemmed once and joined back to the tokens."""
    rows = checkpointed(tokenize_alpha(spark, sf_dir))
    return join_unique(rows, checkpointed(porter2.stem_table(rows)), ["token"]).select(*PAIR, "side", "pos", F.col("stem").alias("token"))


@query
def tweet_words(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return _side_rows(p, tx.tweet_words("raw_1"), tx.tweet_words("raw_2"), "word")


# --------------------------------------------------------- n-grams (N) ----

def _gram_rows(families):
    def run(spark, sf_dir):
        return G.gram_table(_pairs(spark, sf_dir), families)
    return run


QUERIES["word_ngrams"] = _gram_rows(("word1", "word2", "word3"))
QUERIES["char_ngrams"] = _gram_rows(("char1", "char2", "char3"))
QUERIES["tag_ngrams"] = _gram_rows(("pos2", "pos3", "ner2", "ner3", "event2", "event3"))


def _tokens(spark, sf_dir):
    """Token lists materialised as columns, so n-gram lambdas read them instead of
    re-running the tokeniser per element."""
    return _pairs(spark, sf_dir).select(*PAIR, tx.word_punct_tokens("sent_1").alias("t1"),
                                        tx.word_punct_tokens("sent_2").alias("t2"))


@query
def skip_bigrams(spark, sf_dir):
    p = _tokens(spark, sf_dir)
    return _side_rows(p, ng.bigrams(F.col("t1"), skip=1), ng.bigrams(F.col("t2"), skip=1), "gram")


@query
def skip_trigrams(spark, sf_dir):
    p = _tokens(spark, sf_dir)
    return _side_rows(p, ng.trigrams(F.col("t1"), skip=1), ng.trigrams(F.col("t2"), skip=1), "gram")


# Generators take a column of tweet words (materialised once per side).
NGRAM_SET_GENERATORS = {
    "C1": lambda w: ng.char_ngram_set(w, 1),
    "C2": lambda w: ng.char_ngram_set(w, 2),
    "V1": lambda w: ng.word_ngram_set(w, 1),
    "V2": lambda w: ng.word_ngram_set(w, 2),
}


QUERIES["ngram_set_features"] = lambda spark, sf_dir: ngram_set_features(
    _pairs(spark, sf_dir).select(*PAIR, tx.tweet_words("raw_1").alias("tw_1"),
                                 tx.tweet_words("raw_2").alias("tw_2")),
    NGRAM_SET_GENERATORS, text_cols=("tw_1", "tw_2"))


# ------------------------------------------------------ labels (P, S, J) ----

def _labelled(spark, sf_dir):
    return fx.with_vote(fx.conversation_pairs(spark, sf_dir))


@query
def label_train(spark, sf_dir):
    v = _labelled(spark, sf_dir).withColumn("judge", fx.judge_string(F.col("vote")))
    return v.select(*PAIR, "judge", L.train_label(F.col("judge")).alias("is_paraphrase"))


@query
def label_test(spark, sf_dir):
    v = _labelled(spark, sf_dir)
    return v.select(*PAIR, "vote", L.test_label(F.col("vote")).alias("is_paraphrase"))


@query
def drop_ambiguous(spark, sf_dir):
    v = _labelled(spark, sf_dir).withColumn("is_paraphrase", L.test_label(F.col("vote")))
    return L.drop_ambiguous(v).select(*PAIR, "trend_id", "is_paraphrase")


@query
def numeric_projection(spark, sf_dir):
    v = (_labelled(spark, sf_dir).withColumn("judge", fx.judge_string(F.col("vote")))
         .withColumn("is_paraphrase", L.test_label(F.col("vote"))))
    return L.numeric_projection(v)


@query
def missing_flags(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select(*PAIR, *L.missing_flags(tx.word_punct_tokens("sent_1"), tx.word_punct_tokens("sent_2")))


def _files(spark, sf_dir):
    """The pairs as a test file and a gold file with the same line order; returns their paths."""
    rows = fx.with_vote(_pairs(spark, sf_dir))
    ordered = checkpointed(rows.repartitionByRange(*PAIR).sortWithinPartitions(*PAIR))
    test, gold = shared_dir(spark, "test_pairs"), shared_dir(spark, "gold")
    tsv.write_tsv(ordered.select(
        F.col("trend_id").alias("trendid"), F.concat(F.lit("conv "), F.col("trend_id").cast("string")).alias("trendname"),
        F.col("sent_1").alias("origsent"), F.col("sent_2").alias("candsent"), F.col("vote").alias("label"),
        F.col("tags_1").alias("origsenttag"), F.col("tags_2").alias("candsenttag")), test)
    tsv.write_tsv(fx.gold(ordered).select("ans", "prob"), gold)
    return test, gold


@query
def gold_join(spark, sf_dir):
    """J1 on files: the gold file has no key but its line number."""
    test, gold = _files(spark, sf_dir)
    pairs = tsv.read_indexed(spark, test, tsv.TEST_SCHEMA)
    labels = tsv.read_indexed(spark, gold, tsv.GOLD_SCHEMA)
    return L.join_gold(pairs, labels, ["row_idx"]).select(
        "trendid", "origsent", "candsent", "label", "ans", r6(F.col("prob")).alias("prob"))


@query
def scan_pairs(spark, sf_dir):
    """Write the derived pairs in the reference's 7-column TSV layout to the
    shared folder, then read them back with the explicit schema."""
    rows = fx.with_vote(_pairs(spark, sf_dir)).select(
        F.col("trend_id").alias("trendid"),
        F.concat(F.lit("conv "), F.col("trend_id").cast("string")).alias("trendname"),
        F.col("sent_1").alias("origsent"), F.col("sent_2").alias("candsent"),
        fx.judge_string(F.col("vote")).alias("judge"),
        F.col("tags_1").alias("origsenttag"), F.col("tags_2").alias("candsenttag"))
    path = shared_dir(spark, "scan_pairs")
    tsv.write_tsv(rows, path)
    return tsv.read_train_pairs(spark, path)


# -------------------------------------------------------- positions (D) ----

@query
def gram_positions_q(spark, sf_dir):
    return gram_positions(G.gram_table(_pairs(spark, sf_dir), G.WORD_FAMILIES))


QUERIES["gram_positions"] = QUERIES.pop("gram_positions_q")


@query
def position_stats_q(spark, sf_dir):
    return position_stats(G.gram_table(_pairs(spark, sf_dir), G.WORD_FAMILIES, keep_empty=True))


QUERIES["position_stats"] = QUERIES.pop("position_stats_q")


# ---------------------------------------------------- edit distance (E) ----

QUERIES["edit_distance_word"] = lambda spark, sf_dir: edit_distance(_pairs(spark, sf_dir), G.WORD_FAMILIES)
QUERIES["edit_distance_char"] = lambda spark, sf_dir: edit_distance(_pairs(spark, sf_dir), G.CHAR_FAMILIES)
QUERIES["edit_distance_tag"] = lambda spark, sf_dir: edit_distance(_pairs(spark, sf_dir), G.POS_FAMILIES)


# ------------------------------------------------------------- tags (G) ----

@query
def parse_tags(spark, sf_dir):
    return T.tag_rows(_pairs(spark, sf_dir))


@query
def tag_context(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(*PAIR, "tags_1", "tags_2",
                                     tx.word_punct_tokens("sent_1").alias("tok_1"),
                                     tx.word_punct_tokens("sent_2").alias("tok_2"))
    return T.tag_context(p)


def _family_metrics(spark, sf_dir, families):
    gc = G.gram_counts(G.gram_table(_pairs(spark, sf_dir), families, keep_empty=True))
    return overlap_metrics(pair_gram_stats(gc))


@query
def tag_similarity(spark, sf_dir):
    m = _family_metrics(spark, sf_dir, G.POS_FAMILIES)
    return m.select(*PAIR, "family", "common", "sorensen", "cosine", "precision", "recall", "f1")


@query
def common_event(spark, sf_dir):
    m = _family_metrics(spark, sf_dir, ("event1",))
    return m.select(*PAIR, F.col("common").alias("common_event"))


@query
def common_ner(spark, sf_dir):
    m = _family_metrics(spark, sf_dir, ("ner1",))
    return m.select(*PAIR, F.col("common").alias("common_ner"))


# ---------------------------------------------------------- metrics (M) ----

JACCARD_THRESHOLD = 0.2


@query
def binary_metrics_q(spark, sf_dir):
    """M5/M6 on the test-label rule, predicting 1 when word-unigram Jaccard > 0.2."""
    p = _pairs(spark, sf_dir)
    lab = p.select(*PAIR, L.test_label(fx.vote_expr()).alias("label"))
    jac = overlap_metrics(pair_gram_stats(G.gram_counts(G.gram_table(p, ("word1",))))).select(*PAIR, "jaccard")
    scored = (L.drop_ambiguous(lab, "label").join(jac, list(PAIR), "left")
              .select("label", (F.coalesce(F.col("jaccard"), F.lit(0.0)) > JACCARD_THRESHOLD)
                      .cast("int").alias("prediction")))
    return binary_metrics(scored)


QUERIES["binary_metrics"] = QUERIES.pop("binary_metrics_q")


# ----------------------------------------------------- corpus stats (F) ----

from pairgram.operators import encode as ENC  # noqa: E402
from pairgram.operators import lexnet as W  # noqa: E402
from pairgram.operators import tfidf as TF  # noqa: E402


def fit_documents(spark, sf_dir):
    """Each side of each pair is one document: doc_id = (conv_id, turn, side),
    text = the stemmed sentence (T4)."""
    p = fx.conversation_pairs(spark, sf_dir)
    sides = F.array(*[F.struct(F.struct(*PAIR, F.lit(i).alias("side")).alias("doc_id"), F.col(f"sent_{i}").alias("s")) for i in (1, 2)])
    return p.select(F.inline(sides)).select("doc_id", tx.stemmed_sentence(F.col("s")).alias("text"))


def tfidf_model():
    return TF.TfidfModel(fx.STOP_WORDS, min_df=3)


def fitted_tfidf(spark, sf_dir):
    return tfidf_model().fit(fit_documents(spark, sf_dir))


@query
def tfidf_vocab(spark, sf_dir):
    return fitted_tfidf(spark, sf_dir).vocab


@query
def tfidf_idf(spark, sf_dir):
    return fitted_tfidf(spark, sf_dir).idf.select("term", r6(F.col("idf")).alias("idf"))


@query
def tfidf_weights(spark, sf_dir):
    w = tfidf_model().fit_transform(fit_documents(spark, sf_dir))
    return w.select("doc_id.*", "term", "weight")


@query
def tfidf_transform(spark, sf_dir):
    """the vocabulary fitted on conversation pairs applied to the documents table."""
    model = fitted_tfidf(spark, sf_dir)
    docs = fx.read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        "doc_id", tx.stemmed_sentence(F.col("text")).alias("text"))
    return model.transform(docs)


@query
def label_encode(spark, sf_dir):
    """0-based code of each sentence by sorted distinct value."""
    p = fx.conversation_pairs(spark, sf_dir).select(*PAIR, "sent_1")
    return ENC.LabelEncoder("sent_1").fit(p).transform(p).select(*PAIR, "sent_1_code")


def _stop_table(spark, sf_dir):
    """A stop table derived from the corpus: the words of the benchmark texts with at most five letters."""
    items = fx.read_table(spark, sf_dir, "benchmark", ["text"])
    return items.select(F.explode_outer(fx.lower_words("text")).alias("word")).filter("length(word) <= 5").distinct()


@query
def tfidf_stop_table(spark, sf_dir):
    """The idf table fitted without the words of a stop table."""
    model = TF.TfidfModel(_stop_table(spark, sf_dir), min_df=3).fit(fit_documents(spark, sf_dir))
    return model.idf.select("term", r6(F.col("idf")).alias("idf"))


def text_frame(spark, sf_dir):
    """The text columns of the feature frame by name: sentences, tags and every gram list as text."""
    pairs = _pairs(spark, sf_dir)
    base = G.with_base_arrays(pairs, G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES)
    both = pairs.join(base, list(PAIR))
    families = [f for f in G.WORD_FAMILIES + G.CHAR_FAMILIES + G.POS_FAMILIES]
    columns = {"trend": F.concat(F.lit("conv "), F.col("trend_id").cast("string"))}
    for side in (1, 2):
        columns |= {f"sent_{side}": F.col(f"sent_{side}"), f"tags_{side}": F.col(f"tags_{side}"),
                    f"tag_{side}": F.array_join(f"pos_{side}", " "), f"stem_{side}": F.array_join(f"stok_{side}", " ")}
        columns |= {f"{f}_{side}": F.array_join(G.family_array(f, side), "\x1f") for f in families}
    return both.select(*PAIR, *[c.alias(n) for n, c in columns.items()]), list(columns)


@query
def label_encode_frame(spark, sf_dir):
    """the codes of all 39 text columns."""
    frame, columns = text_frame(spark, sf_dir)
    return ENC.FrameEncoder(columns).fit(frame).transform(frame, list(PAIR))


# ------------------------------------------------- lexical network (W) ----

@query
def corpus_freq(spark, sf_dir):
    return W.corpus_freq(fx.read_table(spark, sf_dir, "documents", ["text"]))


@query
def information_content(spark, sf_dir):
    freq = checkpointed(W.corpus_freq(fx.read_table(spark, sf_dir, "documents", ["text"])))
    total = W.corpus_total(freq)
    conv = fx.read_table(spark, sf_dir, "conversations", ["text"])
    words = conv.select(F.explode_outer(tx.word_punct_tokens("text")).alias("word")).filter("word IS NOT NULL").distinct()
    return W.information_content(words, freq, total).select("word", r6(F.col("ic")).alias("ic"))


def _taxonomy(spark, sf_dir):
    return fx.hypernyms(spark, sf_dir), fx.lemmas(spark, sf_dir)


@query
def hypernym_closure(spark, sf_dir):
    edges, _ = _taxonomy(spark, sf_dir)
    return W.hypernym_closure(edges)


def _word_pairs(spark, sf_dir):
    return W.adjacent_word_pairs(fx.read_table(spark, sf_dir, "conversations", ["text"]))


@query
def synset_path(spark, sf_dir):
    edges, lemmas = _taxonomy(spark, sf_dir)
    sp = W.sense_pairs(_word_pairs(spark, sf_dir), lemmas)
    return W.synset_path(sp, W.hypernym_closure(edges)).select(
        "s1", "s2", "path", r6(F.col("path_similarity")).alias("path_similarity"))


@query
def best_synset_pair(spark, sf_dir):
    edges, lemmas = _taxonomy(spark, sf_dir)
    best = W.best_synset_pair(_word_pairs(spark, sf_dir), lemmas, W.hypernym_closure(edges))
    return best.select("word_1", "word_2", "s1", "s2", "path", r6(F.col("path_similarity")).alias("path_similarity"))


@query
def word_similarity(spark, sf_dir):
    edges, lemmas = _taxonomy(spark, sf_dir)
    return W.word_similarity(_word_pairs(spark, sf_dir), lemmas, W.hypernym_closure(edges))


# ------------------------------------------- sentence similarity (W10-W15) ----

from pairgram.operators import sentsim as SS  # noqa: E402


def _joint(spark, sf_dir):
    """Joint words of the pairs, their most similar words, and the taxonomy behind them."""
    edges, lemmas = _taxonomy(spark, sf_dir)
    joint = stored(SS.joint_words(_pairs(spark, sf_dir)), "joint")
    return joint, SS.most_similar_word(joint, checkpointed(lemmas), W.hypernym_closure(edges))


def _corpus(spark, sf_dir):
    freq = checkpointed(W.corpus_freq(fx.read_table(spark, sf_dir, "documents", ["text"])))
    return freq, W.corpus_total(freq)


@query
def most_similar_word(spark, sf_dir):
    return _joint(spark, sf_dir)[1]


def _semantic_vector(spark, sf_dir):
    joint, similar = _joint(spark, sf_dir)
    words = checkpointed(joint.select("word").distinct())
    return SS.semantic_vector(joint, similar, W.information_content(words, *_corpus(spark, sf_dir)))


@query
def semantic_vector(spark, sf_dir):
    return _semantic_vector(spark, sf_dir).withColumn("value_ic", r6(F.col("value_ic")))


@query
def semantic_similarity(spark, sf_dir):
    return SS.semantic_similarity(_semantic_vector(spark, sf_dir)).select(*PAIR, *[r6(F.col(c)).alias(c) for c in ("semantic", "semantic_ic")])


@query
def word_order_vector(spark, sf_dir):
    return SS.word_order_vector(*_joint(spark, sf_dir))


@query
def word_order_similarity(spark, sf_dir):
    return SS.word_order_similarity(SS.word_order_vector(*_joint(spark, sf_dir))).withColumn("word_order", r6(F.col("word_order")))


def similarity_table(spark, sf_dir):
    """W15 of every pair."""
    edges, lemmas = _taxonomy(spark, sf_dir)
    return SS.sentence_similarity(_pairs(spark, sf_dir), checkpointed(lemmas), W.hypernym_closure(edges), *_corpus(spark, sf_dir))


@query
def sentence_similarity(spark, sf_dir):
    found = similarity_table(spark, sf_dir)
    return found.select(*PAIR, *[r6(F.col(c)).alias(c) for c in found.columns[2:]])


@query
def precomputed_similarity(spark, sf_dir):
    """Sentence similarities written as a file and read back."""
    found = similarity_table(spark, sf_dir)
    path = shared_dir(spark, "similarity")
    PC.write_similarity(found.select(*PAIR, *[r6(F.col(c)).alias(c) for c in ("similarity", "similarity_ic")]), path)
    return PC.read_similarity(spark, path)


@query
def features_with_similarity(spark, sf_dir):
    """Word overlap features with the precomputed similarities beside them."""
    table = PC.bucketed(precomputed_similarity(spark, sf_dir), "pair_similarity")
    features = _family_metrics(spark, sf_dir, ("word1",)).select(*PAIR, "jaccard", "cosine", "f1")
    return PC.attach_similarity(features, table)


# ------------------------------------------------- model and evaluation ----

from pairgram.plans import model_plan as MP  # noqa: E402

QUERIES["features_wide"] = MP.q_features_wide
QUERIES["assemble"] = MP.q_assemble
QUERIES["feature_matrix"] = MP.q_feature_matrix
QUERIES["feature_map"] = MP.q_feature_map
QUERIES["gbt_predict"] = MP.q_gbt_predict
QUERIES["gbt_regress"] = MP.q_gbt_regress
QUERIES["split_importance"] = MP.q_split_importance


# ------------------------------------------------------------- streaming ----

from pairgram.streaming.turns import stream_turn_features  # noqa: E402

QUERIES["stream_turn_features"] = stream_turn_features
