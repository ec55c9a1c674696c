"""Fingerprints of documents by context-triggered piecewise hashing.

A rolling hash of the last seven code points decides, from the content alone, where pieces end; each piece
gives one character of a signature, so that an edit changes the characters of the pieces it touches and
no others. A piece ends where the rolling hash is divisible by the block size 2^level, so the
boundaries of a level are among those of the level below, and short texts are told apart by code points. The level is the least with at most 64 pieces,
and the fingerprint "block size:signature:signature of the next level" can be compared with those
of the same, half or double block size (Kornblum, "Identifying almost identical files using context
triggered piecewise hashing", 2006; hashes and score here are our own).

Likeness is 1 - (insertions + deletions) / (characters of both), by the longest common subsequence of two
signatures of one block size, the better of two where two can be compared; it is 0 where they share no
run of six characters (of half the shorter signature, if less), and 1 for equal fingerprints.

All hashes are worked out in blocks of code points, so that a very long text costs a byte for each
code point besides itself, and no level is tried twice: one pass counts the boundaries of every level.

A document's neighbour is found without a join: the rows are sorted by id over all partitions, each
task streams through its own, and only the rows at the borders between partitions, two for each, are
met afterwards. Texts are shuffled once.

Defined cases: a null text is empty; the empty text has the fingerprint "1::" (no pieces). Null ids come
before all others; rows of one id are in order of their texts' hashes, then of the texts. The row after the last is the
first, which may be the same row. No rows, no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

WINDOW, MOST_PIECES, RUN = 7, 64, 6
#: Code points hashed at a time.
BLOCK = 1 << 18
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WORD = 2**64
#: Odd multipliers: of the rolling hash, of the pieces' hash, and of mixing.
ROLL, PIECE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9
UNPIECE = pow(PIECE, -1, WORD)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


ROLL_POWERS, PIECE_POWERS = powers(ROLL, WINDOW), powers(PIECE, BLOCK)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def levels(text: str) -> np.ndarray:
    """For each code point the highest level at which a piece ends after it."""
    out = np.zeros(len(text), np.int8)
    for start in range(0, len(text), BLOCK):
        before = min(start, WINDOW - 1)
        x = mixed(code_points(text[start - before : start + BLOCK]) + np.uint64(1))
        padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), x])
        rolled = np.zeros(len(x), np.uint64)
        for k in range(WINDOW):
            rolled += padded[WINDOW - 1 - k : len(padded) - k] * ROLL_POWERS[k]
        value = (mixed(rolled) >> np.uint64(32))[before:] | np.uint64(1 << 32)
        low = value & (~value + np.uint64(1))
        out[start : start + len(low)] = np.log2(low.astype(np.float64))
    return out


def piece_sums(text: str, ends: np.ndarray) -> list[int]:
    """Sum of mixed code points times PIECE^position, modulo 2^64, up to each of the ends and to the text's end."""
    out, total = [], 0
    for start in range(0, len(text), BLOCK):
        x = mixed(code_points(text[start : start + BLOCK]) + np.uint64(1))
        sums = np.cumsum(x * PIECE_POWERS[: len(x)], dtype=np.uint64)
        scale = pow(PIECE, start, WORD)
        own = ends[(ends >= start) & (ends < start + len(x))] - start
        out += [(total + scale * s) % WORD for s in sums[own].tolist()]
        total = (total + scale * int(sums[-1])) % WORD
    return [*out, total]


def character(sum_before: int, sum_after: int, start: int) -> str:
    """The character of a piece: its sum as if it began the text, mixed to six bits."""
    x = (sum_after - sum_before) * pow(UNPIECE, start, WORD) % WORD
    x = (x ^ (x >> 31)) * MIX % WORD
    return CHARACTERS[x >> 58]


def signature(starts: list[int], sums: list[int]) -> str:
    return "".join(character(a, b, s) for s, a, b in zip(starts, [0, *sums], sums, strict=False))


def fingerprint(text: str | None) -> str:
    text = text or ""
    if not text:
        return "1::"
    level = levels(text)
    # A boundary after the last code point makes no further piece.
    inner = level[:-1]
    counts = np.bincount(inner, minlength=1)
    above = np.cumsum(counts[::-1])[::-1]  # boundaries of each level and all above
    own = int(np.argmax(above < MOST_PIECES)) if (above < MOST_PIECES).any() else len(above)
    ends = np.flatnonzero(inner >= own)
    sums = piece_sums(text, ends)
    starts = [0, *(ends + 1).tolist()]
    high = [i for i, e in enumerate(ends.tolist()) if inner[e] > own]
    coarse = signature([0, *(starts[i + 1] for i in high)], [*(sums[i] for i in high), sums[-1]])
    return f"{1 << own}:{signature(starts, sums)}:{coarse}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a's positions as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = v & places.get(c, 0)
        v = (v + m | v - m) & full
    return len(a) - v.bit_count()


def signature_likeness(a: str, b: str) -> float:
    run = min(RUN, (min(len(a), len(b)) + 1) // 2)
    if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness (0 to 1) of two fingerprints; 0 where their block sizes differ by more than a factor of two."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = ((int(s), f, c) for s, f, c in (a.split(":"), b.split(":")))
    if x == y:
        return max(signature_likeness(x1, y1), signature_likeness(x2, y2))
    if x == 2 * y:
        return signature_likeness(x1, y2)
    return signature_likeness(x2, y1) if y == 2 * x else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the next one's opening, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
#: A partition's border rows come with their text: edge is 1 for its first row, 2 for its last, 3 for both.
EDGES = OUT + ", edge int, part int, text string"


def compared(doc: int | None, text: str, own: str, after: str, next_own: str) -> tuple:
    other = edited(text, after)
    print_of = own if other == text else fingerprint(other)
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, own, print_of, likeness(own, print_of), likeness(own, next_own)


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: "Int64" for c in ("doc_id", "n_chars", "edge", "part") if c in columns})


def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream through a sorted partition: every row that has its next, and the border rows with their texts."""
    held: tuple | None = None  # (id, text, fingerprint, whether it is the first) of the last row
    names, part = [*COLUMNS, "edge", "part", "text"], TaskContext.get().partitionId()
    border = lambda row, edge: (row[0], len(row[1]), None, row[2], None, None, None, edge, part, row[1])
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            doc, text = None if pd.isna(doc) else int(doc), text or ""
            now = (doc, text, fingerprint(text), held is None)
            if held is not None:
                if held[3]:
                    out.append(border(held, 1))
                out.append((*compared(*held[:3], text, now[2]), 0, part, None))
            held = now
        yield frame(out, names)
    if held is not None:
        yield frame([border(held, 3 if held[3] else 2)], names)


def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last rows of partitions with the rows that follow them."""
    for b in batches:
        ids = [None if pd.isna(d) else int(d) for d in b["doc_id"]]
        yield frame([compared(*x) for x in zip(ids, b["text"], b["fingerprint"], b["after"], b["after_print"], strict=True)], COLUMNS)


def with_next(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # Of the order only ids and hashes are sampled for the ranges; the texts break ties within a partition.
    streams = durable(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInPandas(neighbours, EDGES), "fingerprints")
    borders = streams.where("edge > 0")
    # One number for each partition that has rows.
    parts = sorted(r.part for r in borders.where("edge <> 2").select("part").collect())
    if not parts:
        return streams.select(*COLUMNS)
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after_part int")
    last = borders.where("edge >= 2").select("part", "doc_id", "text", "fingerprint")
    first = borders.where("edge <> 2").select(F.col("part").alias("after_part"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    pairs = last.join(F.broadcast(follows), "part").join(first, "after_part").drop("part", "after_part")
    return streams.where("edge = 0").select(*COLUMNS).unionByName(pairs.mapInPandas(met, OUT))
