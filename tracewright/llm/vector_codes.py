"""Compression of vectors to product codes, entries found by annular norm pruning.

A vector's integer components, floor(scale * x) (scale a power of two), are cut into parts; each part position has a codebook of
up to 256 entries, and a part's code is its nearest entry. The codebooks start as the parts of the vectors
with the smallest ids and move by rounds of Lloyd's rule, entry = floor(mean of its parts).

The nearest entry is found exactly: entries are sorted by norm, and as | |x| - |c| | <= |x - c|, an entry
as near as the best so far has its norm within that distance of the part's norm. Each part starts with
the entries next to it by norm; then the interval of norms still allowed is found by binary search, both
ends included (an equally near entry of lower index wins), and the entries in it are evaluated exactly,
the interval being found again as the best distance falls.

A round is one scan: a task keeps count and sum of the parts of each entry, and these few thousand
numbers are all that is shuffled. The codebooks (256 entries of one vector's width) are all the driver holds.

Defined cases: a vector that is null, or holds a null or a component that is not finite, is left out (no
row). Vectors count as if zeros followed up to a multiple of the number of parts and to the longest one's
length; the empty vector is all zeros. Null ids come after all others in the choice of the first entries, and rows
of one id in order of their vectors; each repeated row counts. With fewer than 256 vectors the codebooks
are as small. No vectors, no rows. Components of any size are evaluated exactly, in Python's integers
where doubles do not hold them; an error or a sum of errors that doesn't fit a long is null. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Entries next to a part by norm that are evaluated before the first search of its interval.
NEXT = 8
#: Entries of an interval evaluated between two searches.
STEP = 16
#: Sums leave a task as digits of so many bits, so that sums of any size add up in longs.
DIGIT = 40
#: So many labels are broadcast at most (a label and a sum each); beyond it the labels are joined.
MOST_LABELS = 100_000
LONG = 2**63
SUMS = "part int, entry int, place int, digit int, total long"
CODED = "vec_id long, label string, code string, error long"


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite double."""
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


def doubles_hold(width: int) -> float:
    """Components below this have distances that doubles hold exactly."""
    return (2.0**53 / max(1, width)) ** 0.5 / 2


class Codebook:
    """One part position's entries, sorted by norm for the search."""

    def __init__(self, entries: list[list[int]], width: int):
        self.limit = doubles_hold(width)
        self.entries = entries
        norms = np.array([sum(float(c) ** 2 for c in e) ** 0.5 for e in entries])
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.large = np.array([any(abs(c) >= self.limit for c in entries[i]) for i in self.order], bool)
        self.values = np.zeros((len(entries), width))
        for row, i in enumerate(self.order):
            if not self.large[row]:
                self.values[row] = entries[i]

    def annulus(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of entries whose norm is within the best distance of the part's, ends included (rounding amply allowed for)."""
        reach = np.sqrt(best)
        reach += 1e-9 * (norm + reach) + 1e-9
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row, rows and distances within doubles_hold."""
        n, m = len(x), len(self.norms)
        norm = np.sqrt((x**2).sum(axis=1))
        best, index = np.full(n, np.inf), np.full(n, m, np.int64)
        at = np.searchsorted(self.norms, norm)

        def evaluate(rows: np.ndarray, entry: np.ndarray) -> None:
            """Take the entries (one a row) that are nearer, or as near and of lower index."""
            d = ((x[rows] - self.values[entry]) ** 2).sum(axis=1)
            d[self.large[entry]] = np.inf
            own = self.order[entry]
            better = (d < best[rows]) | (d == best[rows]) & (own < index[rows])
            taken = rows[better]
            best[taken], index[taken] = d[better], own[better]

        every = np.arange(n)
        for k in range(-(NEXT // 2), NEXT - NEXT // 2):
            evaluate(every, np.clip(at + k, 0, m - 1))
        squares = (self.values**2).sum(axis=1)
        for start in range(0, m, STEP):
            low, high = self.annulus(norm, best)
            rows = np.flatnonzero((low < start + STEP) & (high > start))
            if not len(rows):
                continue
            some = slice(start, min(start + STEP, m))
            d = (x[rows] ** 2).sum(axis=1)[:, None] + squares[some][None] - 2 * (x[rows] @ self.values[some].T)
            place = np.arange(some.start, some.stop)[None]
            d[(place < low[rows][:, None]) | (place >= high[rows][:, None]) | self.large[some][None]] = np.inf
            own = np.where(d == d.min(axis=1)[:, None], self.order[some][None], m)
            pick = own.min(axis=1)
            near = d.min(axis=1)
            better = (near < best[rows]) | (near == best[rows]) & (pick < index[rows])
            best[rows[better]], index[rows[better]] = near[better], pick[better]
        return index, best

    def nearest_of(self, x: list[int], index: int = -1, best: int | None = None) -> tuple[int, int]:
        """The same for one part of any size, in Python's integers; index and best are what is found already."""
        norm = sum(float(c) ** 2 for c in x) ** 0.5
        for row in np.argsort(np.abs(self.norms - norm), kind="stable").tolist():
            # Entries come in order of the gap between the norms: the first beyond the best distance ends the annulus.
            gap = abs(self.norms[row] - norm) - 1e-9 * (norm + self.norms[row]) - 1e-9
            if best is not None and gap > 0 and gap > float(best) ** 0.5 * (1 + 1e-9):
                break
            own = int(self.order[row])
            d = sum((a - b) ** 2 for a, b in zip(x, self.entries[own], strict=True))
            if best is None or (d, own) < (best, index):
                index, best = own, d
        return index, best


def assign(book: Codebook, x: np.ndarray, exact: dict[int, list[int]]) -> tuple[np.ndarray, list[int]]:
    """Nearest entry and squared distance of each row; exact has the rows whose components doubles don't hold."""
    if book.large.all():
        index, distance = np.zeros(len(x), np.int64), [-1] * len(x)
        some = range(len(x))
    else:
        index, best = book.nearest(x)
        distance = best.astype(np.int64).tolist()
        some = sorted(exact)
        if book.large.any():
            # A large entry can be nearest only where its norm is within reach.
            norm = np.sqrt((x**2).sum(axis=1))
            least = book.norms[book.large].min()
            some = sorted({*exact, *np.flatnonzero(norm + np.sqrt(best) * (1 + 1e-9) + 1 >= least).tolist()})
    for i in some:
        index[i], distance[i] = book.nearest_of(exact.get(i) or [int(c) for c in x[i]])
    return index, distance


def parts_of(vectors: pd.Series, scale: int, parts: int, width: int) -> list[tuple[np.ndarray, dict[int, list[int]]]]:
    """For each part position its rows as doubles, and those rows exactly that doubles don't hold (zeros in the first)."""
    limit = doubles_hold(width)
    x = np.zeros((len(vectors), parts * width))
    exact: list[dict[int, list[int]]] = [{} for _ in range(parts)]
    for i, v in enumerate(vectors):
        own = np.floor(np.asarray(v, np.float64) * scale) if len(v) else np.zeros(0)
        if len(own) and not np.abs(own).max() < limit:
            full = [whole(c, scale) for c in v] + [0] * (parts * width - len(v))
            for p in range(parts):
                mine = full[p * width : (p + 1) * width]
                if any(abs(c) >= limit for c in mine):
                    exact[p][i] = mine
                else:
                    x[i, p * width : (p + 1) * width] = mine
        else:
            x[i, : len(own)] = own
    return [(x[:, p * width : (p + 1) * width], exact[p]) for p in range(parts)]


def digits(total: int) -> list[int]:
    """total as digits of base 2^DIGIT from the least; the last holds the sign."""
    out = []
    while not -(2**DIGIT) < total < 2**DIGIT:
        out.append(total & (2**DIGIT - 1))
        total >>= DIGIT
    return [*out, total]


def usable(vectors: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), x.alias("x"))


def moved(rows: DataFrame, books: list[list[list[int]]], scale: int, width: int) -> list[list[list[int]]]:
    """One round: every entry becomes the mean of its parts, rounded down; an entry without parts stays."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [Codebook(b, width) for b in held.value]
        counts = [np.zeros(len(b), np.int64) for b in held.value]
        sums = [[[0] * width for _ in b] for b in held.value]
        for batch in batches:
            for p, (x, exact) in enumerate(parts_of(batch["x"], scale, len(tables), width)):
                index, _ = assign(tables[p], x, exact)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                own = np.zeros((len(counts[p]), width), np.int64)
                np.add.at(own, index, x.astype(np.int64))
                for e in np.unique(index).tolist():
                    sums[p][e] = [a + b for a, b in zip(sums[p][e], own[e].tolist(), strict=True)]
                for i, part in exact.items():
                    e = int(index[i])
                    sums[p][e] = [a + b for a, b in zip(sums[p][e], part, strict=True)]
        out = [(p, e, -1, 0, int(n)) for p, own in enumerate(counts) for e, n in enumerate(own) if n]
        out += [(p, e, i, k, d) for p, e, *_ in list(out) for i, total in enumerate(sums[p][e]) for k, d in enumerate(digits(total))]
        yield pd.DataFrame(out, columns=["part", "entry", "place", "digit", "total"])

    found = rows.select("x").mapInPandas(summed, SUMS).groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total")).collect()
    held.unpersist()
    totals: dict[tuple[int, int, int], int] = {}
    for r in found:
        key = (r.part, r.entry, r.place)
        totals[key] = totals.get(key, 0) + (r.total << (DIGIT * r.digit))
    return [
        [[totals[p, e, i] // totals[p, e, -1] for i in range(width)] if (p, e, -1) in totals else entry for e, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def coded(rows: DataFrame, books: list[list[list[int]]], scale: int, width: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and squared error of every vector."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [Codebook(b, width) for b in held.value]
        for batch in batches:
            codes, errors = [""] * len(batch), [0] * len(batch)
            for p, (x, exact) in enumerate(parts_of(batch["x"], scale, len(tables), width)):
                index, distance = assign(tables[p], x, exact)
                codes = [c + f"{i:02x}" for c, i in zip(codes, index.tolist(), strict=True)]
                errors = [a + b for a, b in zip(errors, distance, strict=True)]
            fits = [e if e < LONG else None for e in errors]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "code": codes, "error": pd.Series(fits, dtype="Int64")})

    return rows.mapInPandas(code, CODED)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error of every vector; the codebooks: parts of entries of integers)."""
    rows = usable(vectors, id_col, vector, label)
    longest = rows.agg(F.max(F.size("x")).alias("n")).first().n
    if longest is None:
        return rows.sparkSession.createDataFrame([], CODED), [[] for _ in range(parts)]
    width = max(1, -(-longest // parts))
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    full = [[whole(c, scale) for c in r.x] + [0] * (parts * width - len(r.x)) for r in first]
    books = [[v[p * width : (p + 1) * width] for v in full] for p in range(parts)]
    for _ in range(rounds):
        books = moved(rows, books, scale, width)
    return coded(rows, books, scale, width), books


def books_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def digests(vectors: DataFrame) -> DataFrame:
    """The codes with the error of each label and a digest of the codebooks."""
    codes, books = compress(vectors)
    codes = durable(codes, "codes")
    fits = F.count("error") == F.count("*")
    labels = durable(codes.groupBy("label").agg(F.when(fits, F.try_sum("error")).alias("label_error")).select(F.col("label").alias("of"), "label_error"), "labels")
    small = labels.count() <= MOST_LABELS
    out = codes.join(F.broadcast(labels) if small else labels, codes["label"].eqNullSafe(labels["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
