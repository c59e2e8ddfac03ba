"""Token counts under a unigram vocabulary, without making the tokens.

Aho-Corasick finds every vocabulary piece that ends at each place of a word; dynamic programming
carries the best score and how many pieces it has. Ties follow the tokenizer: of equal scores the
piece that starts first stays, a character that no piece matches alone scores the least score
less 10 where nothing longer reaches, neighbouring unknown characters fuse, and unknown text is
spelled in byte pieces. No piece of the vocabulary reaches from another character into a space, so
words (a run of "▁" and what follows it) are counted apart, once, and remembered in a table of
bounded size; under a vocabulary with such pieces whole texts are walked.

None of the public vocabularies is a unigram model, and none may be trained here, so the pieces of
piece_bpe_32k.model are used with log-probabilities by Zipf's law from their rank. Counts are
equal to those of the tokenizers library's Unigram model over the same pieces.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; an empty
table gives an empty result; very long texts and words take memory in proportion to their length;
other input columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SPACE_MARK = "▁"
#: A run of spaces and what follows it.
WORD = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*")
UNKNOWN_PENALTY = 10.0
#: The memory of words, in characters (an entry counts ENTRY_CHARS more); longer words than CACHE_WORD are not remembered.
CACHE_CHARS, ENTRY_CHARS, CACHE_WORD = 1 << 25, 120, 256


def zipf_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file, in id order, with log-probabilities of their rank under Zipf's law."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not sp.is_control(i)]
    total = math.log(sum(1 / r for r in range(1, len(names) + 1)))
    return [(p, -math.log(r) - total) for r, p in enumerate(names, 1)]


class Counting:
    """Best piece count of a text under a unigram vocabulary with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for p, score in pieces:
            self.found.add_word(p, (len(p), score))
        self.found.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # a text may be cut before a run of spaces only if no piece reaches over that point
        self.whole = any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p, _ in pieces) or all(p != SPACE_MARK for p, _ in pieces)
        self.known: dict[str, tuple[int, float]] = {}
        self.held = 0

    def word(self, w: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation."""
        n, worst = len(w), -math.inf
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, match in self.found.iter(w):
            ends[last].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for i, matches in enumerate(ends):
            top, many, size = worst, 0, 0
            if len(matches) > 1:
                matches.sort(reverse=True)  # the earliest start first: a later one must be strictly better
            for size, score in matches:
                total = best[i + 1 - size] + score
                if total > top:
                    top, many = total, count[i + 1 - size] + 1
            if size != 1:  # no piece is this character alone
                total = best[i] + self.unknown
                if total > top:
                    top, many = total, count[i] + len(w[i].encode("utf-8", "surrogatepass"))
            best[i + 1], count[i + 1] = top, many
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        marked = text.replace(" ", SPACE_MARK)
        if not marked:
            return 0, 0.0
        if not marked.startswith(SPACE_MARK):
            marked = SPACE_MARK + marked
        if self.whole:
            return self.word(marked)
        # words without their first mark; a split will do where no two marks meet
        words = [w[1:] for w in WORD.findall(marked)] if SPACE_MARK * 2 in marked else marked.split(SPACE_MARK)[1:]
        many, total = 0, 0.0
        for w, k in Counter(words).items():
            if (got := self.known.get(w)) is None:
                if self.held > CACHE_CHARS:
                    self.known.clear()
                    self.held = 0
                got = self.word(SPACE_MARK + w)
                if len(w) <= CACHE_WORD:
                    self.known[w] = got
                    self.held += len(w) + ENTRY_CHARS
            many += k * got[0]
            total += k * got[1]
        return many, total


@lru_cache(maxsize=2)
def _counting(path: str) -> Counting:
    return Counting(zipf_pieces(path))


def token_counts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens and score (the best segmentation's log-probability)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counting(path)
        for b in batches:
            got = [c.text(x.as_py() or "") for x in b.column("__text")]
            cols = {k: b.column(k) for k in keep}
            cols["n_tokens"] = pa.array(np.array([g[0] for g in got], np.int64))
            cols["score"] = pa.array(np.array([g[1] for g in got], np.float64))
            yield pa.RecordBatch.from_pydict(cols)

    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(count, schema)


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
