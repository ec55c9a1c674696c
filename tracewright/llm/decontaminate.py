"""Benchmark decontamination: a BM25 index of test items that every training passage queries.

The items are the indexed documents, the passages are the queries. An item's impacts are divided by the
score it gives its own text, so one threshold serves items of every length. Items are indexed by length
class (up to 64 words, 128, 256 and so on); for each class a text is cut into overlapping passages twice
the class's length, so what one item is searched with doesn't depend on the others. Block-max WAND finds
all items that score the threshold or more:

1. for all passages of many texts at once, bounds are summed: first each term's greatest impact; then, for
   the blocks of items that one of the passage's weightier terms is posted in, the terms' block maxima.
   Blocks below the threshold hold no hit and are skipped whole;
2. for what is left, cursors over the posting lists move by WAND's pivot rule, with a second look at the
   block maxima before an item is scored.

A hit counts as a leak if, in the words around the passage, both the item's question and its answer are
found: OVERLAP or more of the word pairs of each, so that a few changed words don't hide an item. A table
without such columns takes the first half of an item's words as the question and the rest as the answer.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

Defined cases: a null or empty text has no leaks; items with a null id, a null text or no words are
left out; equal items under several ids are each found; repeated rows get equal results; an empty
benchmark finds nothing; no documents, no rows; other columns pass through, and a result column whose
name is taken gets underscores before it. Texts are read whole, in overlapping passages. An item is
found within the words of one passage and half a passage around it: parts further apart are no leak.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, let_go, spare_name

#: Bytes of item text in one index; a larger benchmark is split over several indexes. An index takes 20 times its text at most
#: (every word new: a dictionary entry of some 100 bytes, a posting and a block's maximum of 24), so 80 MB.
INDEX_BYTES = 4_000_000
BLOCK = 4
#: Words of the shortest class of items.
SHORTEST = 64
#: Share of an item's own score that a passage must give it.
THRESHOLD = 0.7
#: Words whose passages are bounded together, and pairs of passages and blocks.
BATCH_WORDS, BATCH_PAIRS = 100_000, 2_000_000
#: Words of the n-grams, and the share of them, that must be found of question and answer.
GRAM, OVERLAP = 2, 0.6
K1, B = 1.2, 0.75
LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
LEAKS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,passage_start:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Statistics:
    """What BM25 needs to know of all items, however many indexes they are dealt into."""

    def __init__(self):
        self.items, self.words = 0, 0
        self.found_in: Counter[bytes] = Counter()

    def add(self, items: list[tuple[int, list[bytes], list[bytes]]]) -> Statistics:
        for _, q, a in items:
            if size := len(q) + len(a):
                self.items, self.words = self.items + 1, self.words + size
                self.found_in.update({*q, *a})
        return self


def segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(keys)] if len(starts) else starts


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For slices of an array: which slice each element belongs to, and its place in the array."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


class Shelf:
    """Posting lists with block maxima over the items (id, question words, answer words) of one length class.

    Postings and block maxima are flat arrays: those of term t lie from start[t] to start[t + 1], by item and
    by block; a block has an entry only for the terms posted in it.
    """

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], longest: int, threshold: float, whole: Statistics):
        # Items of like length stand together, so that a block's maxima are close to its items' impacts.
        self.items, self.threshold, self.passage = sorted(items, key=lambda x: (len(x[1]) + len(x[2]), x[0])), threshold, 2 * longest
        n, mean, found_in = whole.items, whole.words / max(1, whole.items), whole.found_in
        self.terms: dict[bytes, int] = {}
        posted: list[tuple[int, int, float]] = []
        for i, (_, q, a) in enumerate(self.items):
            impact = {}
            for t, tf in Counter(q + a).items():
                idf = math.log(1 + (n - found_in[t] + 0.5) / (found_in[t] + 0.5))
                impact[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(q) + len(a)) / mean))
            own = sum(impact.values())
            posted += [(self.terms.setdefault(t, len(self.terms) + 1), i, x / own) for t, x in impact.items()]
        posted.sort()
        term, item, impact = (np.array(x) for x in zip(*posted, strict=True))
        edge = np.arange(len(self.terms) + 2)
        self.start = np.searchsorted(term, edge).tolist()
        self.item_at, self.impact = array("i", item.tolist()), array("d", impact.tolist())
        self.blocks = -(-len(self.items) // BLOCK)
        key = term.astype(np.int64) * self.blocks + item // BLOCK
        first, _ = segments(key)
        self.block_key, self.block_max = key[first], np.maximum.reduceat(impact, first)
        self.block_keys, self.block_maxes = array("q", self.block_key.tolist()), array("d", self.block_max.tolist())
        self.block_start = np.searchsorted(self.block_key, edge * self.blocks)
        self.most = np.r_[0.0, np.maximum.reduceat(impact, np.array(self.start[1:-1]))]

    def passages(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, start, distinct terms) of the passages some block of which may reach the threshold."""
        width, sizes = self.passage, np.array([len(t) for t in texts])
        ids = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        found = np.flatnonzero(ids)
        text = np.repeat(np.arange(len(texts)), sizes)[found]
        at = found - (np.cumsum(sizes) - sizes)[text]
        terms = ids[found]
        key = text * np.int64(len(self.terms) + 1) + terms
        order = np.argsort(key, kind="stable")
        before = np.full(len(at), -1)
        same = key[order[1:]] == key[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        tiles = sizes // width + 1
        base = np.cumsum(tiles) - tiles
        for shift in (0, width // 2):
            local = (at - shift) // width
            first = np.flatnonzero((before < local * width + shift) & (at >= shift))
            tile, held = (base[text] + local)[first], terms[first]
            starts, ends = segments(tile)
            if not len(starts):
                continue
            keep = np.add.reduceat(self.most[held], starts) >= self.threshold - 1e-6
            inside = np.repeat(keep, ends - starts)
            first, tile, held = first[inside], tile[inside], held[inside]
            starts, ends = segments(tile)
            meets = np.r_[0, np.cumsum(self.block_start[held + 1] - self.block_start[held])[ends - 1]] if len(ends) else []
            lo = 0
            while lo < len(starts):
                # Passages that meet so many blocks at most, but one at least.
                hi = max(lo + 1, int(np.searchsorted(meets, meets[lo] + BATCH_PAIRS, "right")) - 1)
                own = slice(starts[lo], ends[hi - 1])
                for k in self.bounded(held[own], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]):
                    at_first = first[starts[lo + k]]
                    yield int(text[at_first]), int(local[at_first]) * width + shift, held[starts[lo + k] : ends[lo + k]]
                lo = hi

    def bounded(self, held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        """Which passages (slices of the terms held) have a block whose maxima sum to the threshold."""
        floor = self.threshold - 1e-6
        passage = np.repeat(np.arange(len(starts)), ends - starts)
        # A passage's terms by their greatest impact, the weightiest last; those before `light` sum to less than the
        # threshold, so that no item gets there without one of the others.
        order = np.lexsort((self.most[held], passage))
        held = held[order]
        total = np.cumsum(self.most[held])
        total -= np.r_[0.0, total][starts][passage]
        light = total < floor
        rest = np.bincount(passage[light], self.most[held[light]], len(starts))
        heavy = np.flatnonzero(~light)
        of, place = spread(self.block_start[held[heavy]], self.block_start[held[heavy] + 1] - self.block_start[held[heavy]])
        pair = passage[heavy][of] * np.int64(self.blocks) + self.block_key[place] % self.blocks
        pairs, which = np.unique(pair, return_inverse=True)
        bound = np.bincount(which, self.block_max[place], len(pairs))
        ours = bound + rest[pairs // self.blocks] >= floor
        pairs, bound = pairs[ours], bound[ours]
        # The light terms' own maxima in the blocks that are left.
        owner = pairs // self.blocks
        counts = np.bincount(passage[light], minlength=len(starts))
        lookups = np.r_[0, np.cumsum(counts[owner])]
        lo = 0
        while lo < len(pairs):
            hi = max(lo + 1, int(np.searchsorted(lookups, lookups[lo] + BATCH_PAIRS, "right")) - 1)
            of, place = spread(starts[owner[lo:hi]], counts[owner[lo:hi]])  # light terms come first in a passage
            wanted = held[place].astype(np.int64) * self.blocks + pairs[lo:hi][of] % self.blocks
            spot = np.minimum(np.searchsorted(self.block_key, wanted), len(self.block_key) - 1)
            bound[lo:hi] += np.bincount(of, np.where(self.block_key[spot] == wanted, self.block_max[spot], 0.0), hi - lo)
            lo = hi
        return np.unique(owner[bound >= floor]).tolist()

    def wand(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of all items that score the threshold or more for these distinct terms."""
        terms = terms.tolist()
        place = [self.start[t] for t in terms]
        end = [self.start[t + 1] for t in terms]
        most = self.most[terms].tolist()
        live = list(range(len(terms)))
        out, floor = [], self.threshold - 1e-9
        items, impact = self.item_at, self.impact
        item_of = lambda k: items[place[k]]

        def greatest(k: int, block: int) -> float:
            key = terms[k] * self.blocks + block
            at = bisect_left(self.block_keys, key)
            return self.block_maxes[at] if at < len(self.block_keys) and self.block_keys[at] == key else 0.0

        while live:
            live.sort(key=item_of)
            total, pivot = 0.0, -1
            for n, k in enumerate(live):
                total += most[k]
                if total >= floor - 1e-6:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = item_of(live[pivot])
            while pivot + 1 < len(live) and item_of(live[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK
            if sum(greatest(k, block) for k in live[: pivot + 1]) < floor - 1e-6:
                # No item of this block before the next cursor's item can get there.
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    goal = min(goal, item_of(live[pivot + 1]))
                goal = max(goal, item + 1)
                for k in live[: pivot + 1]:
                    place[k] = bisect_left(items, goal, place[k], end[k])
            elif item_of(live[0]) == item:
                score = sum(impact[place[k]] for k in live[: pivot + 1])
                if score >= floor:
                    out.append((item, score))
                for k in live[: pivot + 1]:
                    place[k] += 1
            else:
                for k in live[:pivot]:
                    place[k] = bisect_left(items, item, place[k], end[k])
            live = [k for k in live if place[k] < end[k]]
        return out

    def leaks(self, words: list[list[bytes]]) -> list[list[dict]]:
        """The items found in each text, a list of words."""
        get = self.terms.get
        hits: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for i, start, terms in self.passages([np.fromiter([get(w, 0) for w in ws], np.int32, len(ws)) for ws in words]):
            for item, score in self.wand(terms):
                hits[i, item].append((start, score))
        found: list[list[dict]] = [[] for _ in words]
        for (i, item), places in hits.items():
            if leak := self.verified(words[i], item, places):
                found[i].append(leak)
        return found

    def verified(self, words: list[bytes], item: int, places: list[tuple[int, float]]) -> dict | None:
        name, question, answer = self.items[item]
        best = (-1.0, 0.0, 0.0, 0)
        for start, _ in places:
            near = words[max(0, start - self.passage // 2) : start + self.passage * 3 // 2]
            q, a = (self.overlap(part, near) for part in (question, answer))
            best = max(best, (min(q, a), q, a, -start))
        if best[0] < OVERLAP:
            return None
        score = max(s for _, s in places)
        return {"item_id": name, "score": score, "question_overlap": best[1], "answer_overlap": best[2], "passage_start": -best[3]}

    @staticmethod
    def overlap(part: list[bytes], near: list[bytes]) -> float:
        if not part:
            return 1.0
        n = min(GRAM, len(part))
        wanted = grams(part, n)
        return len(wanted & grams(near, n)) / len(wanted)


class Index:
    """Items on a shelf for each length class."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], threshold: float = THRESHOLD, whole: Statistics | None = None):
        whole = whole or Statistics().add(items)
        classes: dict[int, list[tuple[int, list[bytes], list[bytes]]]] = defaultdict(list)
        for x in items:
            if size := len(x[1]) + len(x[2]):
                classes[max(SHORTEST, 1 << (size - 1).bit_length())].append(x)
        self.shelves = [Shelf(held, longest, threshold, whole) for longest, held in sorted(classes.items())]

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """The items found in each text, by id."""
        out: list[list[dict]] = []
        held: list[list[bytes]] = []
        n = 0
        for k, t in enumerate(texts):
            held.append(words_of(t))
            n += len(held[-1])
            if n >= BATCH_WORDS or k == len(texts) - 1:
                found: list[list[dict]] = [[] for _ in held]
                for shelf in self.shelves:
                    for own, more in zip(found, shelf.leaks(held), strict=True):
                        own += more
                out += [sorted(x, key=lambda x: x["item_id"]) for x in found]
                held, n = [], 0
        return out


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    words = words_of(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def finder(index: Broadcast):
    @F.pandas_udf(LEAKS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        for batch in batches:
            yield pd.Series(index.value.leaks(list(batch)))

    # Else the optimiser would repeat it in the filter that an explode of its result brings along.
    return find.asNondeterministic()


class Passes:
    """A benchmark as indexes of bounded size, built and sent to the executors one at a time.

    benchmark has item_id and either text or question and answer. Its size is measured first; each index holds
    INDEX_BYTES at most, and a larger benchmark takes several passes over the texts. A pass ends before the next
    index is sent: a task has one Python worker with one index, and the driver one index at a time.
    """

    def __init__(self, benchmark: DataFrame):
        self.spark = benchmark.sparkSession
        self.parts = ("question", "answer") if {"question", "answer"} <= set(benchmark.columns) else ("text",)
        whole = F.concat_ws(" ", *[F.col(c) for c in self.parts])
        self.items = benchmark.where(F.col("item_id").isNotNull() & (whole != "")).select(F.col("item_id").cast("long"), *self.parts)
        size = self.items.agg(F.sum(F.octet_length(whole))).first()[0] or 0
        self.turns = -(-size // INDEX_BYTES)
        self.whole: Statistics | None = None
        if self.turns > 1:
            # The statistics are those of all items, so that an item's score doesn't depend on the number of indexes.
            self.whole = Statistics()
            for k in range(self.turns):
                self.whole.add(self.part(k))

    def part(self, k: int) -> list[tuple[int, list[bytes], list[bytes]]]:
        part = self.items.where(F.pmod(F.xxhash64("item_id", *self.parts), F.lit(self.turns)) == k) if self.turns > 1 else self.items
        split = (lambda r: (words_of(r[1]), words_of(r[2]))) if len(self.parts) == 2 else (lambda r: halves(r[1]))
        return [(r[0], *split(r)) for r in part.distinct().collect()]

    def over(self, take: Callable[[int, Callable[[Column], Column]], DataFrame], what: str) -> Iterator[DataFrame]:
        """What `take` makes of each pass and its find function; of several passes each is written, and its index released, before the next."""
        for k in range(self.turns):
            index = self.spark.sparkContext.broadcast(Index(self.part(k), whole=self.whole))
            made = take(k, finder(index))
            if self.turns == 1:
                yield made
            else:
                made = durable(made, what)
                index.destroy()
                yield made


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document and item found in it: the documents' columns but the text, then the find."""
    held = spare_name(docs, "leak")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]

    def found(_: int, find: Callable[[Column], Column]) -> DataFrame:
        return docs.withColumn(held, find(F.col(text))).select(*rest, F.explode(held).alias(held))

    out = None
    for each in Passes(benchmark).over(found, "leaks"):
        out = each if out is None else out.unionByName(each)
    if out is None:
        out = docs.select(*rest, F.explode(F.array().cast(LEAKS)).alias(held))
    for c in ("item_id", "score", "question_overlap", "answer_overlap", "passage_start"):
        out = out.withColumn(spare_name(docs, c), F.col(f"{held}.{c}"))
    return out.drop(held)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, unchanged, in which no item was found. With several passes each reads what the one before kept."""
    held = spare_name(docs, "leak")
    kept = docs

    def clean(_: int, find: Callable[[Column], Column]) -> DataFrame:
        return kept.withColumn(held, find(F.col(text))).where(F.size(held) == 0).drop(held)

    for after in Passes(benchmark).over(clean, "clean"):
        if kept is not docs:
            discard(kept)
        kept = after
    return kept
