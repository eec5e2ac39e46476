"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
position of a word; dynamic programming carries, per position, the best score and
the number of pieces on that path. No segmentation is built.

Tie and unknown rules are those of the usual unigram tokeniser: among paths of
equal score to a position the one whose last piece starts first stays; a
character without a piece of its own may be an unknown one, scored UNKNOWN below
the lowest piece, and counts as its UTF-8 bytes (byte fallback) or as one piece.
A run of unknown characters is one unknown piece when there is no byte fallback.

Words: spaces become the marker character and the text begins with one. Where no piece holds
a marker after another character, a text's best path is that of its parts cut before
each first marker of a run: a part is counted by itself, and parts that occur often
once. Other vocabularies, and those without the marker as a piece, are searched over whole texts.

Memory: Arrow splits a slice of bounded bytes into parts and numbers the distinct ones; a table of bounded size keeps
counts of parts of at most CACHED characters; the search itself keeps scores for as many
positions as the longest piece has characters, whatever the length of a part.

Defined cases: null and empty texts have no tokens; a very long text or a text without spaces is searched
with the same state as a short one. Repeated rows are counted each for itself. Input columns may have
any name; an input column named as the result is replaced. Work is per row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgram.llm.common import slices

SPACE_MARK = "▁"
UNKNOWN = 10.0
#: Parts whose counts a task keeps, and their longest length in characters.
CACHE = 200_000
CACHED = 64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PARTS = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|^[^{SPACE_MARK}]+")


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the normal pieces of a sentencepiece file, and whether it has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids], any(map(model.is_byte, range(model.get_piece_size())))


class PieceCounter:
    """Counts pieces; holds the automaton and a bounded table of counts."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.match = ahocorasick.Automaton()
        for piece, score in pieces:
            self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.bytes = byte_fallback
        #: whether no piece, and no run of unknown characters, goes over a cut
        self.cuts = SPACE_MARK in self.single and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p, _ in pieces)
        self.seen: dict[str, int] = {}

    def part(self, part: str) -> int:
        if len(part) > CACHED:
            return self._count(part)
        known = self.seen.get(part)
        if known is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            known = self.seen[part] = self._count(part)
        return known

    def _count(self, part: str) -> int:
        """Viterbi from left to right; position p has its state at p modulo the ring's size."""
        ring = self.longest + 1
        score, count, after_unknown = [0.0] * ring, [0] * ring, [False] * ring
        single, as_bytes, unknown = self.single, self.bytes, self.unknown
        hits = self.match.iter(part)
        at, hit = next(hits, (-1, None))
        for i, c in enumerate(part):
            best, pieces, is_unknown = None, 0, False
            while at == i:  # longest piece first: of equal scores the path whose last piece starts first stays
                start = (i + 1 - hit[0]) % ring
                s = score[start] + hit[1]
                if best is None or s > best:
                    best, pieces = s, count[start] + 1
                at, hit = next(hits, (-1, None))
            if c not in single:
                last = i % ring
                s = score[last] + unknown
                if best is None or s > best:
                    best, is_unknown = s, True
                    pieces = count[last] + (len(c.encode()) if as_bytes else int(not after_unknown[last]))
            slot = (i + 1) % ring
            score[slot], count[slot], after_unknown[slot] = best, pieces, is_unknown
        return count[len(part) % ring]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE_MARK)
        if not marked.startswith(SPACE_MARK):
            marked = SPACE_MARK + marked
        return sum(self.part(m.group()) for m in PARTS.finditer(marked)) if self.cuts else self._count(marked)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Counts of all texts: distinct parts once; texts with runs of spaces or a marker of their own one by one."""
        out = np.zeros(len(texts), dtype=np.int64)
        split = pc.split_pattern(texts, " ")
        parts, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(texts), dtype=bool) if self.cuts else np.ones(len(texts), dtype=bool)
        odd[owner[pc.equal(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)]] = True
        odd |= pc.fill_null(pc.match_substring(texts, SPACE_MARK), False).to_numpy(zero_copy_only=False)
        plain = ~odd[owner]
        owner = owner[plain]
        coded = pc.dictionary_encode(parts.filter(pa.array(plain)))
        counts = np.array([self.part(SPACE_MARK + p) for p in coded.dictionary.to_pylist()], dtype=np.int64)
        if len(owner):
            out += np.bincount(owner, weights=counts[coded.indices.to_numpy()], minlength=len(texts)).astype(np.int64)
        for i in np.flatnonzero(odd):
            out[i] = self.text(texts[i].as_py())
        return out


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool,
                 text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of docs plus ``out`` (long). The vocabulary, a few MB at most, is sent to the tasks once."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, byte_fallback))

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(*shared.value)
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *map(counter.texts, slices(batch))]))

    return docs.withColumn(out, counts(F.col(f"`{text}`").cast("string")))
