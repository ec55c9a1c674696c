"""Token counts under a unigram model, by a dynamic programme shared along a trie of pre-tokens.

The distinct pre-tokens of a batch are the leaves of a trie. A depth-first walk over it (the sorted
pre-tokens, each continuing from the prefix it shares with the one before) computes the best forward
score of every trie node once: the best split of the prefix into vocabulary pieces, by the sum of their
log-probabilities, fewer pieces winning a tie. The number of pieces at a terminal node is stored with
the pre-token, and a text's count is the sum over its pre-tokens.

A pre-token is a run of characters that are not white space, after a word mark. Characters that no
single-character piece covers may fall back to one token per UTF-8 byte.

Defined cases: a null or empty text, or one of white space only, has no words and no tokens; repeated
rows get equal counts; other columns pass through, and a result column whose name is taken gets
underscores before it. Texts are counted whole, however long; a very long word costs memory in
proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Recent, _slices
from .common import kept, spare_name

MARK = "▁"
#: Log-probability of one fallback byte.
BYTE_SCORE = -20.0
STRANGER = object()
COLUMNS = ("n_words", "n_tokens", "n_fallback")


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece model with log-probabilities that follow Zipf's law over their rank.

    The public model gives ranks only, so the law 1 / (rank + 1) stands for the frequencies.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 1) for r in range(len(kept))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(kept)}


class Counter:
    """A vocabulary of pieces with the counts of the pre-tokens met lately."""

    def __init__(self, pieces: dict[str, float]):
        # Every suffix of a piece, with its score if it is a piece: a walk to the left ends at the first stranger.
        self.tails: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(1, len(p))}
        self.tails.update(pieces)
        self.known = Recent()  # pre-token -> tokens + fallback tokens << 32

    def count_all(self, words: list[str]) -> None:
        get, new = self.tails.get, self.known.new
        # By trie node on the path to the word before: score, tokens, fallback tokens.
        score, tokens, spare = [0.0], [0], [0]
        before = ""
        for word in sorted(words):
            full = MARK + word
            shared, most = 0, min(len(full), len(before))
            while shared < most and full[shared] == before[shared]:
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :], spare[shared + 1 :]
            for i in range(shared + 1, len(full) + 1):
                best = tokens_here = spare_here = None
                for j in range(i - 1, -1, -1):
                    p = get(full[j:i], STRANGER)
                    if p is STRANGER:
                        break
                    if p is not None:
                        found = score[j] + p
                        if best is None or found > best or found == best and tokens[j] + 1 < tokens_here:
                            best, tokens_here, spare_here = found, tokens[j] + 1, spare[j]
                if get(full[i - 1]) is None:  # no piece of its own: bytes are the way out
                    n = len(full[i - 1].encode("utf-8", "replace"))
                    found = score[i - 1] + n * BYTE_SCORE
                    if best is None or found > best:
                        best, tokens_here, spare_here = found, tokens[i - 1] + n, spare[i - 1] + n
                score.append(best)
                tokens.append(tokens_here)
                spare.append(spare_here)
            before = full
            new[word] = tokens[-1] | spare[-1] << 32

    def count_batch(self, texts: list[str]) -> list[tuple[int, int, int]]:
        cut = [t.split() for t in texts]
        if missing := self.known.missing({w for ws in cut for w in ws}):
            self.count_all(missing)
        known, out = self.known.new.__getitem__, []
        for ws in cut:
            n = sum(map(known, ws))
            out.append((len(ws), n & 0xFFFFFFFF, n >> 32))
        return out


def counter(path: str) -> Counter:
    return kept(f"unigram {path}", lambda: Counter(load_pieces(path)))


def count_column(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with n_words, n_tokens and n_fallback (the tokens that are single bytes). A narrow map."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COLUMNS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = counter(model)
        for batch in batches:
            rows = [r for ts in _slices([t or "" for t in batch]) for r in held.count_batch(ts)]
            yield pd.DataFrame(rows, columns=list(COLUMNS), dtype="int64")

    held = spare_name(docs, "unigram")
    out = docs.withColumn(held, run(F.col(text)))
    for c in COLUMNS:
        out = out.withColumn(spare_name(docs, c), F.col(f"{held}.{c}"))
    return out.drop(held)
