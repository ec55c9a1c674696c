"""N-gram Jaccard join with a count-vector R-tree, and the groups of near duplicates it links.

A document is the set of its hashed word shingles; equal sets are one class from the start, so copies
are never compared. Classes are compared in three steps:

1. Partition. Two sets of sizes a and b with Jaccard similarity s or more differ in at most
   D = (a + b)(1 - s)/(1 + s) shingles. In a band of sizes the shingles are dealt by hash into more
   than D groups, of which at most D differ: classes that share no group's content in a band need no
   look. A class speaks for its own band and, if a partner may be there, for the next. Groups that are
   empty in a set prove nothing; a class with so many empty groups that an equal one need not have
   content also publishes its empty groups. Of all these keys a class need only publish D + 1, in an
   order that all classes share: the rarest in the corpus first, empty groups last. Two similar classes
   differ in D groups at most, so the first key in which they agree is among the first D + 1 of both.
   What many documents share (a passage, a notice) is thereby left out, and a class whose first D + 1
   keys are its own alone meets nobody. The argument is exact: no bucket is capped.
   Classes that share content, directly or through others, form a cluster.
2. R-tree. Within a cluster each class is a point, the counts of its shingles in 64 groups. The points
   are packed into an R-tree (sorted by size and principal spread, leaves of 32 under one level of
   boxes). Summed coordinate minima bound the overlap: first against a box's upper corner, then against
   each point. A cluster of more than BLOCK classes or BLOCK_SHINGLES shingles is the tree's upper level
   in tables: its classes are seated in blocks by size class, and a probe meets only blocks whose sizes
   can be similar to its own. A few pivots of each cluster probe first, then the classes that no pivot
   tied to the cluster's main component. Pairs already linked through others are not tested again; what
   is tested is exact.
3. Verify. Surviving pairs are compared by the sizes of the sets' intersection and union, in integers.

The links give the components. Hashes of shingles and sets have 64 and 128 bits.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; a null id is no document's
representative, and component_id is then the least non-null id of its component (null if there is
none); rows that repeat an id are documents each; other columns pass through, and a result column whose
name is taken gets underscores before it; no documents, no rows. Texts are read whole.

What is written for later steps is slim (ids, hashes, counts) but for one frame, the sets of the classes
that have someone to meet. Keys are never written: they are made again from the texts where they are
needed. Nothing but rows that end a loop and the bits that mark shared keys comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, durable, let_go, spare_name
from .components import components

#: Coordinates of a point, points of a leaf, classes and shingles of a block, pivots of a cluster that has several blocks.
COORDINATES, LEAF, BLOCK, BLOCK_SHINGLES, PIVOTS = 64, 32, 2048, 4_000_000, 16
#: Ratio of the bounds of a size class of a large cluster's blocks.
SIZE_STEP = 1.1
#: Ways in which the rows of one cluster are dealt where they meet a row about the cluster.
SALTS = 16
#: Ratio of the bounds of a band of set sizes.
BAND = 1.5
#: Bytes of a text whose words are hashed at a time, and bytes of the longest word that the table of places holds.
PIECE, LONGEST = 1 << 18, 64
#: Numbers of documents from which a shared key counts as more frequent, and the bits of the table for each of
#: them: eight a shared key, within these bounds (4 to 32 MB for all, in each Python worker).
FREQUENT = (2, 8, 64, 1024)
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 26
#: Documents whose sets a worker holds at a time.
SLICE = 500


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of a public one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACES = b" \t\n\r\x0b\x0c"
BREAK = re.compile(b"[%s]" % SPACES)
#: Whether a byte belongs to a word.
IN_WORD = ~np.isin(np.arange(256), list(SPACES))
#: A number for each byte at each place of a word.
PLACES = mixed(np.arange(1, 256 * LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashes_of_words(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a piece of text, in order: the sum of what each byte counts at its place."""
    held = np.frombuffer(text, np.uint8)
    word = np.zeros(len(held) + 2, bool)
    word[1:-1] = IN_WORD[held]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sizes, out = ends - starts, np.zeros(len(starts), np.uint64)
    short = sizes <= LONGEST
    for i in np.flatnonzero(~short).tolist():
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
        word[starts[i] + 1 : ends[i] + 1] = False
    sizes = sizes[short]
    if len(sizes):
        first = np.cumsum(sizes) - sizes
        held = held[word[1:-1]]
        place = np.arange(len(held)) - np.repeat(first, sizes)
        out[short] = np.add.reduceat(PLACES[(place << 8) + held], first)
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """hashes_of_words of a whole text, a piece at a time, cut before white space."""
    out, low = [np.zeros(0, np.uint64)], 0
    while low < len(text):
        cut = BREAK.search(text, low + PIECE) if len(text) - low > PIECE else None
        high = cut.start() if cut else len(text)
        out.append(hashes_of_words(text[low:high]))
        low = high
    return np.concatenate(out)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted set of hashed k-word shingles. Words: runs without ASCII white space, A-Z lower-cased."""
    h = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def fingerprint(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


class Geometry:
    """Bands and groups for one similarity, given as num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        top = [4]
        while top[-1] < 1 << 40:
            top.append(max(top[-1] + 1, math.floor(top[-1] * BAND)))
        self.top = np.array(top)  # greatest size of each band

    def differ(self, both: int) -> int:
        """Most shingles in which two similar sets of so many shingles together can differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def groups(self, band: int) -> int:
        d = self.differ(2 * int(self.top[band]))
        return d + 1 + (2 + d // 8 if d else 0)

    def keys(self, s: np.ndarray, rank: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Hashes of (band, group, content): all, or with a rank for each key (0: nobody else has it) what a set need publish."""
        n = len(s)
        band = int(np.searchsorted(self.top, n))
        bands = [band]
        if self.largest_partner(n) > self.top[band]:
            bands.append(band + 1)
        out = []
        for b in bands:
            m = self.groups(b)
            most = min(self.largest_partner(n), int(self.top[b]))
            d = self.differ(n + most)
            if not d:
                continue  # only an equal set is similar
            g = mixed(s + np.uint64(b)) % np.uint64(m)
            order = np.argsort(g.astype(np.uint16 if m <= 1 << 16 else np.int64), kind="stable")  # two bytes are sorted by radix
            g, x = g[order].astype(np.int64), mixed(s[order])
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            held, own = g[edges], self.named(np.add.reduceat(x, edges), g[edges], b)
            empty = np.zeros(0, np.int64)
            if len(held) <= d:  # an equal group need not have content
                empty = np.setdiff1d(np.arange(m), held)
                empty = np.sort(self.named(np.zeros(len(empty), np.uint64), empty, b))
            if rank is None:
                out += [own, empty]
                continue
            often = rank(own)
            first = np.lexsort((own, often))[: d + 1]
            out += [own[first][often[first] > 0], empty[: d + 1 - len(first)]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    @staticmethod
    def named(content: np.ndarray, group: np.ndarray, band: int) -> np.ndarray:
        return mixed(content + mixed(group.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band))).view(np.int64)


def point(s: np.ndarray) -> np.ndarray:
    return np.bincount((s >> np.uint64(7)).astype(np.int64) % COORDINATES, minlength=COORDINATES)


class Tree:
    """A packed two-level R-tree over points: boxes' upper corners over leaves of points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:1] if len(points) else np.zeros(1, int)
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * max(1, math.isqrt(max(1, len(sizes) // LEAF))))
        self.order = np.lexsort((points[:, spread[0]], slab)) if len(points) else np.zeros(0, int)
        self.points = points[self.order]
        self.sizes = sizes[self.order]
        starts = np.arange(0, len(points), LEAF)
        self.corner = np.maximum.reduceat(self.points, starts, axis=0) if len(points) else self.points
        self.least = np.minimum.reduceat(self.sizes, starts) if len(points) else sizes
        self.most = np.maximum.reduceat(self.sizes, starts) if len(points) else sizes

    def candidates(self, p: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Positions of the points whose bound lets them be similar to a set of n shingles at p."""
        # inter * den >= num * union, with union = n + size - inter
        bound = np.minimum(self.corner, p).sum(axis=1)
        fit = (bound * (den + num) >= num * (n + self.least)) & (self.most * den >= num * n) & (n * den >= num * self.least)
        leaves = np.flatnonzero(fit)
        if not len(leaves):
            return leaves
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        bound = np.minimum(self.points[at], p).sum(axis=1)
        return self.order[at[bound * (den + num) >= num * (n + self.sizes[at])]]


def links_in_group(members: list[np.ndarray], probes: list[np.ndarray], member_ids: list[bytes], probe_ids: list[bytes], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """A spanning set of the links between probes and members."""
    place = {i: k for k, i in enumerate(dict.fromkeys([*member_ids, *probe_ids]))}
    root = list(range(len(place)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    points = np.array([point(s) for s in members]).reshape(len(members), COORDINATES)
    tree = Tree(points, np.array([len(s) for s in members], np.int64))
    own = [place[i] for i in member_ids]
    out = []
    for i, s in zip(probe_ids, probes, strict=True):
        me = place[i]
        for k in tree.candidates(point(s), len(s), num, den).tolist():
            if find(own[k]) == find(me):
                continue
            other = members[k]
            inter = int(np.isin(s, other, assume_unique=True, kind="sort").sum()) if len(s) > 64 else len(np.intersect1d(s, other, assume_unique=True))
            if inter * den >= num * (len(s) + len(other) - inter):
                root[find(own[k])] = find(me)
                out.append((i, member_ids[k]))
    return out


def ranks(shared: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Of an array of keys, how frequent each is: 0 for what no two classes share, else by FREQUENT.

    A table of bits for each frequency, shared by the keys that fall on one place; its size follows the
    number of shared keys within bounds. Any order serves the argument, so what the table confuses costs
    time, not links.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * shared.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    levels = F.filter(F.array(*[F.lit(x) for x in FREQUENT]), lambda x: x <= F.col("often"))
    marks = shared.select(F.explode(levels).alias("level"), F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    table = np.zeros((len(FREQUENT), bits // 8), np.uint8)
    for r in marks.groupBy("level", "part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # the table's size at most
        table[FREQUENT.index(r.level), r.part << 12 : (r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    held = shared.sparkSession.sparkContext.broadcast(table)

    def rank(keys: np.ndarray) -> np.ndarray:
        at = keys & (bits - 1)
        return (held.value[:, at >> 3] >> (at & 7).astype(np.uint8) & 1).sum(axis=0)

    return rank


def salted(rows: DataFrame, about: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """rows joined with one row about each of their keys, of which one may hold most rows: they are dealt SALTS ways."""
    own = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    return own.join(about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how).drop("salt")


def hash_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with n_shingles and component_id."""
    out, _ = rooted_groups(docs, shingle, similarity, id_col, text)
    return out.drop(spare_name(docs, "root"))


def rooted_groups(docs: DataFrame, shingle: int, similarity: tuple[int, int], id_col: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """similar_groups with the component's own key, root: ids may repeat, so that components may share a least id.

    The second result are the written frames that the first reads.
    """
    num, den = similarity
    geometry = Geometry(num, den)

    def slices(batches: Iterator[pd.Series]) -> Iterator[list[np.ndarray]]:
        let_go()
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                yield [shingles(t, shingle) for t in batch.iloc[lo : lo + SLICE]]

    @F.pandas_udf("n long, fp binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for held in slices(batches):
            yield pd.DataFrame({"n": [len(s) for s in held], "fp": [fingerprint(s) if len(s) else None for s in held]})

    mark = spare_name(docs, "shingled")
    rest = [c for c in docs.columns if c != text]
    # A text is known by a hash of 128 bits; any text of a class stands for it. Ids may be null or repeat.
    made = docs.withColumn(mark, sets(F.col(text))).withColumn(mark, F.struct(f"{mark}.*", hash_of(F.col(text)).alias("of")))
    rows = durable(made.select(*[F.col(f"`{c}`") for c in rest], mark), "shingled")
    n, fp = F.col(f"{mark}.n"), F.col(f"{mark}.fp")
    # Classes of equal sets.
    classes = durable(rows.where(n > 0).groupBy(fp.alias("fp")).agg(F.min(id_col).alias("low_id"), F.min(f"{mark}.of").alias("of"), F.max(n).alias("n")), "classes")

    # Step 1: keys that several classes publish tie these classes to the least of them. Here a class goes by
    # a 64-bit hash: should two classes share one, they are compared with each other's partners as well.
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The keys of a slice of documents, each once: what many publish shrinks before it is shuffled."""
        for held in slices(batch["text"] for batch in batches):
            held = [s for s in held if len(s)]
            keys = [geometry.keys(s) for s in held]
            key = np.concatenate([*keys, np.zeros(0, np.int64)])
            of = np.repeat(np.array([np.frombuffer(fingerprint(s)[:8], np.int64)[0] for s in held], np.int64), [len(k) for k in keys])
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(key)] if len(key) else starts
            yield pd.DataFrame({"key": key[starts], "low": of[starts], "high": of[ends - 1], "often": ends - starts})

    def published(rank: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        @F.pandas_udf("fp binary, keys array<long>")
        def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for held in slices(batches):
                yield pd.DataFrame({"fp": [fingerprint(s) for s in held], "keys": [geometry.keys(s, rank) if len(s) else [] for s in held]})

        # Not deterministic as far as the optimiser knows: else it would be repeated in inferred filters.
        made = docs.select(keys.asNondeterministic()(F.col(text)).alias("made"))
        return made.select(F.xxhash64("made.fp").alias("c"), F.explode("made.keys").alias("key"))

    # Nearly all keys are met once: they go to their partitions first, for maps of them all would only fill memory.
    pairs = docs.select(F.col(text).alias("text")).mapInPandas(counted, "key long, low long, high long, often long").repartition("key")
    shared = pairs.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("often").alias("often")).where("low < high")
    shared = durable(shared.select("key", "often"), "shared")
    told = durable(published(ranks(shared)), "told")
    discard(shared)
    ties = durable(told.join(told.groupBy("key").agg(F.min("c").alias("low")), "key").where("c <> low").select("c", "low").distinct(), "ties")
    discard(told)
    clusters = components(ties, "c", "low").withColumnRenamed("root", "cluster")
    discard(ties)

    # The classes that have someone to meet, and where they are compared: slim rows.
    chosen = durable(clusters.join(classes, clusters["node"] == F.xxhash64(classes["fp"])).select("fp", "cluster", "of", "n"), "chosen")
    discard(clusters)
    places, boxes = seats(chosen, num, den)

    # Their sets, made again from one text each.
    @F.pandas_udf("fp binary, s binary")
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for held in slices(batches):
            yield pd.DataFrame({"fp": [fingerprint(s) for s in held], "s": [s.tobytes() for s in held]})

    # Other texts go before the shuffle (what the table lets through wrongly finds no partner), and rows that
    # repeat a text are one before they are joined: the join meets each class with one row.
    known = ranks(places.select(F.col("of.a").alias("key"), F.lit(FREQUENT[0]).alias("often")))

    @F.pandas_udf("boolean")
    def wanted(hashes: pd.Series) -> pd.Series:
        return pd.Series(known(hashes.to_numpy(np.int64)) > 0)

    texts = docs.select(hash_of(F.col(text)).alias("of"), F.col(text).alias("text")).where(wanted(F.col("of.a"))).groupBy("of").agg(F.first("text").alias("text"))
    slim = [c for c in places.columns if c != "of"]
    near = texts.join(places, "of").select(*slim, again.asNondeterministic()("text").alias("made"))
    near = durable(near.where("made.fp = fp").select(*slim, "made.s"), "near")
    for frame in (chosen, places):
        discard(frame)
    links = compare(near, boxes, num, den)
    discard(near)
    discard(boxes)

    found = components(links, "a", "b")
    discard(links)
    lowest = classes.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = lowest.groupBy("root").agg(F.min("low_id").alias("component"))
    of_class = durable(lowest.join(least, "root").select(F.col("fp").alias("class_fp"), F.col("root").alias("class_root"), "component"), "of-class")
    for frame in (found, classes):
        discard(frame)
    out = rows.join(of_class, fp == F.col("class_fp"), "left")
    component = F.when(n > 0, F.col("component")).otherwise(F.col(id_col))
    out = out.select(*[F.col(f"`{c}`") for c in rest], n.alias(spare_name(docs, "n_shingles")), component.alias(spare_name(docs, "component_id")), F.col("class_root").alias(spare_name(docs, "root")))
    return out, [rows, of_class]


def dealt(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Blocks for rows (cluster, z, n): a row for each size class, (cluster, z, block, parts, from_z, to_z).

    Small classes of neighbouring sizes share a block, a large one takes several (block to block + parts - 1).
    from_z and to_z bound the size classes that hold sizes similar to any of the class.
    """
    weight = 2 * F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sizes = rows.groupBy("cluster", "z").agg(weight.alias("weight"), F.min("n").alias("least"), F.max("n").alias("most"))
    # A few hundred size classes a cluster, whatever it holds.
    before = F.sum("weight").over(W.partitionBy("cluster").orderBy("z").rowsBetween(W.unboundedPreceding, -1))
    block = F.floor(F.coalesce(before, F.lit(0.0))) * (1 << 20)
    return sizes.select(
        "cluster", "z", block.alias("block"), F.ceil("weight").alias("parts"),
        size_class(F.ceil(F.col("least") * num / den)).alias("from_z"), size_class(F.floor(F.col("most") * den / num)).alias("to_z"),
    )


def part_of(salt: int) -> Column:
    return F.col("block") + F.pmod(F.xxhash64(F.lit(salt), "fp"), F.col("parts"))


def targets(of: DataFrame, to: DataFrame) -> DataFrame:
    """(cluster, z, met): for each size class of `of`, the blocks of `to` that hold similar sizes."""
    reach = of.select("cluster", "z", F.explode(F.sequence("from_z", "to_z")).alias("other"))
    there = to.select("cluster", F.col("z").alias("other"), F.explode(F.sequence(F.col("block"), F.col("block") + F.col("parts") - 1)).alias("met"))
    return reach.join(there, ["cluster", "other"]).groupBy("cluster", "z").agg(F.collect_set("met").alias("met"))


def seats(chosen: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """chosen (fp, cluster, of, n) with z (size class), large, block and pivot, and the boxes of large clusters."""
    total = chosen.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = total.where((F.col("members") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)).select("cluster", F.lit(True).alias("large"))
    marked = salted(chosen, large, "cluster", how="left").withColumns({"large": F.coalesce("large", F.lit(False)), "z": size_class(F.col("n"))})
    boxes = durable(dealt(marked.where("large"), num, den), "boxes")
    held = salted(marked, boxes.select("cluster", "z", "block", "parts"), "cluster", "z", how="left")
    slot = F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(PIVOTS))
    pivots = marked.where("large").groupBy("cluster", slot.alias("slot")).agg(F.min("fp").alias("fp")).select("cluster", "fp", F.lit(True).alias("pivot"))
    held = held.withColumn("block", F.coalesce(part_of(3), F.lit(0).cast("long"))).drop("parts").join(pivots, ["cluster", "fp"], "left")
    return durable(held.withColumn("pivot", F.coalesce("pivot", F.lit(False))), "places"), boxes


def compare(near: DataFrame, boxes: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning links (a, b) of the similar pairs within each cluster, written."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        role = part["role"].to_numpy()
        s = [np.frombuffer(b, np.uint64) for b in part["s"]]
        fps = list(part["fp"])
        pick = lambda xs, bit: [x for x, r in zip(xs, role, strict=True) if r & bit]
        found = links_in_group(pick(s, 1), pick(s, 2), pick(fps, 1), pick(fps, 2), num, den)
        return pd.DataFrame(found, columns=["a", "b"])

    def searched(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cluster", "block", "turn").applyInPandas(run, "a binary, b binary")

    def columns(block, turn, role: int) -> list:
        return ["cluster", block.alias("block"), turn.alias("turn"), "fp", "s", F.lit(role).alias("role")]

    member, probe, both, none = 1, 2, 3, F.lit(0).cast("long")
    whole = near.where("not large").select(*columns(F.col("block"), none, both))
    if boxes.isEmpty():
        return durable(searched(whole), "links")

    # The pivots of each large cluster probe the blocks that hold similar sizes.
    large = near.where("large")
    met = large.where("pivot").join(targets(boxes, boxes), ["cluster", "z"]).select(*columns(F.explode("met"), none, probe))
    first = durable(searched(whole.unionByName(large.select(*columns(F.col("block"), none, member))).unionByName(met)), "links")

    # What the pivots tied to a cluster's main component needs no search among itself.
    root = components(first, "a", "b")
    slim = large.select("fp", "cluster", "z", "n")
    labelled = slim.join(root, slim["fp"] == root["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    main = labelled.groupBy("cluster", "root").agg(F.count("*").alias("count")).groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    loose = durable(salted(labelled, main, "cluster").where("root <> main").select("fp", "cluster", "z", "n"), "loose")
    discard(root)
    turns = durable(dealt(loose, num, den), "turns")
    out = first
    if not turns.isEmpty():
        own = salted(loose, turns.select("cluster", "z", "block", "parts"), "cluster", "z").select("cluster", "z", "fp", part_of(7).alias("turn"))
        own = salted(own, targets(turns, boxes), "cluster", "z").select("fp", "turn", "met")
        probes = large.select("cluster", "fp", "s").join(own, "fp").select(*columns(F.explode("met"), F.col("turn"), probe))
        asked = salted(large, targets(boxes, turns), "cluster", "z").select(*columns(F.col("block"), F.explode("met"), member))
        out = durable(first.unionByName(searched(asked.unionByName(probes))), "links")
        discard(first)
    for frame in (loose, turns):
        discard(frame)
    return out


def first_of_groups(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, unchanged, that have the least id of their group; those without words or id stay.

    A group keeps one row. Of rows with its least id but different texts that is the one with the least
    text hash; a row with that id in another group is judged there.
    """
    mark, root = "text_hash", "root"
    hashed = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias(mark))
    found, frames = rooted_groups(hashed, shingle, similarity, "id", "text")
    rows = found.where("id is not null").groupBy("id", mark).agg(F.min(root).alias(root), F.count("*").alias("n"))
    first = rows.where(F.col(root).isNotNull()).groupBy(root).agg(F.min(F.struct("id", mark, "n")).alias("row")).select("row.*")
    keep = first.unionByName(rows.where(F.col(root).isNull()).select("id", mark, F.lit(1).cast("long").alias("n")))
    keep = durable(keep.select(F.col("id").alias("keep_id"), F.col(mark).alias("keep_hash"), "n"), "kept")
    for frame in frames:
        discard(frame)
    same = (F.col(f"`{id_col}`") == F.col("keep_id")) & (F.xxhash64(text) == F.col("keep_hash"))
    held = docs.join(keep, same, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    again = keep.where("n > 1")
    if again.isEmpty():
        return held
    one = docs.join(again, same, "left_semi").groupBy(F.col(id_col).alias("keep_id"), F.xxhash64(text).alias("keep_hash")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return held.join(again, same, "left_anti").unionByName(one.select("row.*"))
