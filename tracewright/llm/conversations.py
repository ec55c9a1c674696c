"""Prefix trie of conversations by distributed radix partitioning of dictionary-encoded turns.

Turns (role and text) are encoded as whole numbers by a dictionary of their SHA-256 digests: texts stay
where they are read. A conversation is a sequence of numbers, kept in blocks of 64 turns. The trie grows
from the root by rounds. A bucket holds the conversations below one node; in a round its first and last
sequence in order tell how far all of them agree, that whole run of nodes is emitted at once, and the
bucket is dealt into new ones by the next turn (most significant digit first). A bucket of one
conversation is a plain chain, emitted from its length alone. A bucket that is small enough is finished
by one task, which sorts it with multikey quicksort and emits its nodes as it recurses. So a round is
needed only where more than LOCAL conversations part from one another (or for 64 shared turns), never
for each depth, and a hot first turn is dealt again until its parts are small.

What a node sums over its subtree comes back the same way: finished buckets report the totals of their
top node, and the rounds are gone through once more from the last, each one slim join.

A conversation's turns are placed by sorted partitions (operators.ranks), dictionary entries and buckets
that hold more than a thousandth of all rows (so, a thousand at most) meet their rows by broadcast, all
others by a shuffle: neither a hot conversation nor a hot turn nor a hot prefix gathers in one task. The
ids that end at a node are packed in sorted partitions before one task hashes them in order.

Defined cases: rows with a null conv_id belong to no conversation; a null turn comes first; turns of one
number are in order of role, then of the text's digest, and repeated rows are turns each; a null role or
text is empty. Conversations without turns are members of the root only. No conversations, no nodes. c % 100
has the sign of c. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import positions
from .common import durable

#: Turns of a block; the openings that conversations take over from others are shorter than SHARED.
BLOCK, SHARED = 64, 6
#: Most conversations, and most of their turns, of a bucket that one task finishes.
LOCAL, LOCAL_TURNS = 128, 1 << 20
#: A key with more than one of so many rows is hot.
HOT = 1000
#: Nodes of one chain that a row unfolds into; ids packed into one text.
PIECE, PACK = 4096, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

TURN = "struct<id:bigint,n:int>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def meet(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with the table of their keys, n rows for each: the hot ones (at most HOT) by broadcast."""
    hot = F.broadcast(keyed.where(F.col(n) * HOT > total))
    cold = keyed.where(F.col(n) * HOT <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def encoded(turns: DataFrame) -> tuple[DataFrame, int]:
    """conv_id, position (from 1) and the turn's number and code points; and how many rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length comes first: no two turns make one string.
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("n"))
    placed = positions(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]).drop("turn", "role")
    words = durable(rows.groupBy("digest").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    total = words.agg(F.sum("times")).first()[0] or 0
    return meet(placed, words, "digest", "times", total).select("conv_id", "position", F.struct("id", "n").alias("turn")), total


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n_turns) and their blocks (conv_id, block, turns), openings taken over."""
    placed = placed.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 6)
    listed = lambda turn: F.transform(F.array_sort(F.collect_list(F.struct("at", turn))), lambda x: x["turn"])
    heads = placed.where(f"conv_id % 100 = 0 and position < {SHARED}").withColumn("at", F.col("position")).groupBy("conv_id").agg(listed("turn").alias("opening"))
    own = placed.where("position > h").withColumn("at", F.col("position") - F.col("h") - 1)
    blocks = own.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(listed("turn").alias("turns"))
    counts = placed.groupBy("conv_id").agg(F.first("h").alias("h"), F.greatest(F.lit(0), F.count("*") - F.first("h")).alias("own"))
    from_root = counts.join(heads.withColumnRenamed("conv_id", "root"), (F.col("conv_id") - F.col("conv_id") % 100) == F.col("root"), "left")
    opening = F.slice(F.coalesce("opening", F.array().cast(f"array<{TURN}>")), F.lit(1), F.col("h").cast("int"))
    opened = from_root.select("conv_id", "own", opening.alias("opening"))
    first = blocks.where("block = 0").select("conv_id", "turns")
    zero = opened.join(first, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("block"), F.concat("opening", F.coalesce("turns", F.array().cast(f"array<{TURN}>"))).alias("turns"), (F.size("opening") + F.col("own")).alias("n_turns"))
    zero = durable(zero, "openings")
    later = durable(blocks.where("block > 0"), "blocks")
    return zero, later


def agreement(low: Column, high: Column) -> Column:
    """Length of the common opening of two arrays."""
    same = F.zip_with(low, high, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def bucket_of(parent: Column, turn: Column) -> Column:
    """A name of the bucket below a node: a digest of the path of turns."""
    return F.md5(F.concat_ws("/", parent, turn["id"].cast("string")))


def multikey(rows: list[tuple[int, list[tuple[int, int]]]], above: int, parent: int | None) -> Iterator[tuple]:
    """Nodes of conversations (id, turns below `above`) that all begin with one turn, by multikey quicksort.

    The first node is the common one; sums are complete. Nodes are made on the way down and totalled on the
    way up, on a stack of our own.
    """
    nodes: list[list] = []  # [conv, depth, parent conv, convs, children, leaves, saved, ends, index of the node above]
    work = [(rows, 0, -1, parent)]
    while work:
        group, at, up, over = work.pop()
        # Three-way partition by the turn at this depth; all of group have one.
        pivot = group[len(group) // 2][1][at][0]
        less = [x for x in group if x[1][at][0] < pivot]
        more = [x for x in group if x[1][at][0] > pivot]
        same = [x for x in group if x[1][at][0] == pivot]
        work += [(part, at, up, over) for part in (less, more) if part]
        least, length = min(x[0] for x in same), same[0][1][at][1]
        ends = sorted(x[0] for x in same if len(x[1]) == at + 1)
        nodes.append([least, above + at + 1, over, len(same), 0, 0, (len(same) - 1) * length, ends, up])
        below = [x for x in same if len(x[1]) > at + 1]
        if below:
            work.append((below, at + 1, len(nodes) - 1, least))
    for node in reversed(nodes):
        node[5] = node[5] or 1  # a leaf is one
        if node[8] >= 0:
            over = nodes[node[8]]
            over[4], over[5], over[6] = over[4] + 1, over[5] + node[5], over[6] + node[6]
    for least, depth, over, n, children, leaves, saved, ends, _ in nodes:
        yield least, depth, over, n, children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def finished(buckets: DataFrame) -> DataFrame:
    """Nodes of small buckets: rows (bucket, up, parent, above, conv_id, block, turns); a bucket's top node carries `up`."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, name, rest = {}, None, None

        def out() -> list[tuple]:
            if name is None:
                return []
            _, up, parent, above = name
            rows = list(multikey(list(held.items()), above, parent))
            return [(*r, up if k == 0 else None) for k, r in enumerate(rows)]

        for batch in batches:
            made = []
            parents = [None if pd.isna(x) else int(x) for x in batch["parent"]]
            for bucket, up, parent, above, conv, turns in zip(batch["bucket"], batch["up"], parents, batch["above"], batch["conv_id"], batch["turns"], strict=True):
                if name is None or name[0] != bucket:
                    made += out()
                    held, name = {}, (bucket, up, parent, int(above))
                held.setdefault(int(conv), []).extend((t["id"], t["n"]) for t in turns)
            if made:
                yield frame(made)
        if rest := out():
            yield frame(rest)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*NODE_NAMES, "up"]).astype({"parent_conv_id": "Int64"})

    columns = ["bucket", "up", "parent", "above", "conv_id", "block", "turns"]
    return buckets.select(columns).repartition("bucket").sortWithinPartitions("bucket", "conv_id", "block").mapInPandas(finish, NODE + ", up string")


def chains(alone: DataFrame) -> DataFrame:
    """Nodes of buckets of one conversation, from its length alone: rows (up, parent, above, conv_id, n_turns)."""
    starts = alone.withColumn("start", F.explode(F.sequence(F.col("above") + 1, F.col("n_turns"), F.lit(PIECE).cast("long"))))
    long = starts.where("n_turns - above > " + str(PIECE)).repartition("conv_id", "start")
    starts = starts.where("n_turns - above <= " + str(PIECE)).unionByName(long)
    each = starts.withColumn("depth", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (PIECE - 1), F.col("n_turns")))))
    last = F.col("depth") == F.col("n_turns")
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("above") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """bucket and the SHA-256 of its conv_ids in order, comma-joined: packed in sorted partitions, then hashed pack by pack."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, ids = None, []
        for batch in batches:
            out = []
            for bucket, conv in zip(batch["bucket"], batch["conv_id"].tolist(), strict=True):
                if ids and (bucket != name or len(ids) >= PACK):
                    out.append((name, ids[0], ",".join(map(str, ids))))
                    ids = []
                name = bucket
                ids.append(conv)
            if out:
                yield pd.DataFrame(out, columns=["bucket", "first", "ids"])
        if ids:
            yield pd.DataFrame([(name, ids[0], ",".join(map(str, ids)))], columns=["bucket", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            out = []
            for bucket, ids in zip(batch["bucket"], batch["ids"], strict=True):
                if bucket != name:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = bucket, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["bucket", "ends"])
        if state:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["bucket", "ends"])

    packed = ends.select("bucket", "conv_id").repartitionByRange("bucket", "conv_id").sortWithinPartitions("bucket", "conv_id").mapInPandas(pack, "bucket string, first long, ids string")
    return packed.repartition("bucket").sortWithinPartitions("bucket", "first").mapInPandas(hashed, "bucket string, ends string")


ROOT = ""


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations."""
    spark = turns.sparkSession
    placed, _ = encoded(turns)
    openings, later = rebuilt(placed)
    whole = openings.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not whole.n:
        return spark.createDataFrame([], NODE)
    root = spark.createDataFrame([(ROOT, None, None, 0, int(whole.least), int(whole.n), 0)], "bucket string, up string, parent long, above long, least long, n long, run long").withColumn("turns", F.array().cast(f"array<{TURN}>"))
    # Members of the buckets of a round: what lies below `above` turns that all of a bucket share. parent: least member of the node above.
    active = openings.where("n_turns > 0").select(
        bucket_of(F.lit(ROOT), F.col("turns")[0]).alias("bucket"), F.lit(ROOT).alias("up"), F.lit(int(whole.least)).alias("parent"), F.lit(0).cast("long").alias("above"),
        "conv_id", "n_turns", "block", "turns",
    )  # fmt: skip  turns: those of the block from `above` on
    active = durable(active, "active")
    ends = openings.where("n_turns = 0").select(F.lit(ROOT).alias("bucket"), "conv_id")
    runs, nodes, tops = [root], [], []
    while True:
        here = active.groupBy("bucket", "up", "parent", "above").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sum(F.col("n_turns") - F.col("above")).alias("work"),
            F.min("turns").alias("low"), F.max("turns").alias("high"),
        )
        run = agreement(F.col("low"), F.col("high"))
        alone, small = F.col("n") == 1, (F.col("n") > 1) & (F.col("n") <= LOCAL) & (F.col("work") <= LOCAL_TURNS)
        kind = F.when(alone, 1).when(small, 2).otherwise(3)
        here = durable(here.select("bucket", "up", "parent", "above", "n", "least", kind.alias("kind"), run.cast("long").alias("run"), F.when(kind == 3, F.slice("low", F.lit(1), run)).alias("turns")), "buckets")
        told = here.groupBy("kind").agg(F.sum("n").alias("n")).collect()
        members = {r.kind: r.n for r in told}
        level = []
        dealt = meet(active, here.select("bucket", "n", "least", "kind", "run"), "bucket", "n", sum(members.values())) if len(members) > 1 or 3 in members else active.withColumn("kind", F.lit(next(iter(members), 0)))
        if len(members) > 1 or 3 in members:
            dealt = durable(dealt, "dealt")
        if members.get(1):
            nodes.append(chains(dealt.where("kind = 1")))
            level.append(here.where("kind = 1").select("up", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
        if members.get(2):
            some = dealt.where("kind = 2").select("bucket", "up", "parent", "above", "conv_id", "n_turns", "block", "turns")
            go_on = some.where(F.col("above") + F.size("turns") < F.col("n_turns")).drop("turns").withColumnRenamed("block", "seen")
            more = go_on.join(later, "conv_id").where("block > seen").drop("seen")
            done = durable(finished(some.unionByName(more.select(some.columns))), "nodes")
            nodes.append(done.drop("up"))
            level.append(done.where("up is not null").select("up", "n_leaves", F.col("saved_tokens").alias("saved")))
        tops.append(level)
        if not members.get(3):
            break
        runs.append(here.where("kind = 3").select("bucket", "up", "parent", "above", "least", "n", "run", "turns"))
        large = dealt.where("kind = 3").withColumn("reached", F.col("above") + F.col("run"))
        ends = ends.unionByName(large.where("n_turns = reached").select("bucket", "conv_id"))
        go_on = large.where("n_turns > reached")
        inside = go_on.where(F.size("turns") > F.col("run")).withColumn("turns", F.slice("turns", (F.col("run") + 1).cast("int"), F.greatest(F.lit(1), F.size("turns"))))
        beyond = go_on.where(F.size("turns") <= F.col("run")).drop("turns").withColumn("block", F.col("block") + 1).join(later, ["conv_id", "block"])
        after = inside.unionByName(beyond.select(inside.columns))
        active = durable(after.select(bucket_of(F.col("bucket"), F.col("turns")[0]).alias("bucket"), F.col("bucket").alias("up"), F.col("least").alias("parent"), F.col("reached").alias("above"), "conv_id", "n_turns", "block", "turns"), "active")
    hashes = ends_digests(ends)
    # From the last round back to the root: the totals of each run's top node go to the run above.
    below = tops[-1]
    for k in reversed(range(len(runs))):
        gathered = below[0] if below else None
        for t in below[1:]:
            gathered = gathered.unionByName(t)
        if gathered is None:
            gathered = spark.createDataFrame([], "up string, n_leaves long, saved long")
        sums = gathered.groupBy("up").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")).withColumnRenamed("up", "of")
        zero = F.lit(0).cast("long")
        repeated = lambda column: F.aggregate(column, zero, lambda total, t: total + t["n"]) * (F.col("n") - 1)
        own = runs[k].join(sums, F.col("bucket") == F.col("of"), "left").select(
            *runs[k].columns, F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("under")
        )
        own = durable(own, "runs")
        each = own.join(hashes.withColumnRenamed("bucket", "at"), F.col("bucket") == F.col("at"), "left").withColumn("i", F.explode(F.sequence(F.when(F.col("bucket") == ROOT, 0).otherwise(1).cast("long"), F.col("run"))))
        last = F.col("i") == F.col("run")
        from_here = F.slice("turns", F.greatest(F.lit(1), F.col("i").cast("int")), F.greatest(F.lit(1), F.size("turns")))
        nodes.append(each.select(
            F.col("least").alias("conv_id"), (F.col("above") + F.col("i")).alias("depth"), F.when(F.col("i") <= 1, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            (F.col("under") + repeated(from_here)).alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
        ))
        if k:
            below = [*tops[k - 1], own.select("up", "n_leaves", (F.col("under") + repeated(F.col("turns"))).alias("saved"))]
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    return out.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in NODE.split(", ")))
