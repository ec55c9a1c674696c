"""Quality classification by co-training over two views of a document.

One classifier reads the text's content (hashed byte pairs and the shares of kinds of characters), the
other its metadata alone (source, language and stated length). Both are logistic models.
They start from labelled rows; in each round each labels the unlabelled rows it is surest of, and the
other learns from them. At the end each view is calibrated on labelled rows kept out of training, and
the calibrated log-odds are combined, weighted on the same rows, to score all documents.

The labelled rows are a bounded sample (train's parameter labelled, LABELLED rows unless told otherwise:
those with the smallest hashed ids, so the same rows on every run; of rows that repeat an id, one). The unlabelled rows are all the others: each round scores every document whole in a
distributed map, and only the ADDED surest ones of each view come to the driver.

Defined cases: a null or empty text has the features of an empty text and is scored like any other;
null metadata count as their own value; labels that are null, or for unknown documents, are left out; a
document with several labels counts once, with the greatest; without labels of both kinds every document
scores 0.5 and is kept; repeated rows get equal scores; other columns pass through, and a result column
whose name is taken gets underscores before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let_go, spare_name

#: Labelled rows of the training sample.
LABELLED = 3000
ROUNDS, ADDED = 4, 200
#: Parts of a side's unlabelled rows that are ranked apart, before the best of each are ranked together.
SALTS = 64
PAIRS = 512
STEPS = 120
#: Documents scoring less are rejected.
KEEP = 0.4
META = ("source", "lang", "n_chars")
META_WIDTH = 64

KIND = np.zeros(256, np.int64)
for _c in range(256):
    KIND[_c] = (
        1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c >= 128
        else 5 if _c in (32, 9) else 6 if _c in (10, 13) else 7 if _c in b".,;:'\"?()-" else 8 if _c in b"!" else 9
    )
CONTENT_WIDTH = PAIRS + 10 + 4


def content_features(text: str | None) -> np.ndarray:
    """Shares of hashed byte pairs and of kinds of characters, mean word length, repetition of lines."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(CONTENT_WIDTH, np.float32)
    if not len(raw):
        out[-1] = 1
        return out
    kinds = np.bincount(KIND[raw], minlength=10) / len(raw)
    if len(raw) > 1:
        pairs = np.bincount((raw[:-1].astype(np.int64) * 257 + raw[1:]) * 2654435761 % 4294967296 >> 23, minlength=PAIRS)
        out[:PAIRS] = np.sqrt(pairs / (len(raw) - 1))
    out[PAIRS : PAIRS + 10] = np.sqrt(kinds)
    words = max(1, int((raw == 32).sum() + (raw == 10).sum()) + 1)
    lines = (text or "").split("\n")
    out[-4] = min(4.0, len(raw) / words / 8)
    out[-3] = len(set(lines)) / len(lines)
    out[-2] = min(3.0, np.log1p(len(raw)) / 4)
    return out


def meta_features(source: object, lang: object, n_chars: object) -> np.ndarray:
    """Hashed source, language and both together, and the stated length: its logarithm and its size class."""
    out = np.zeros(META_WIDTH, np.float32)
    n = float(n_chars) if n_chars is not None and n_chars == n_chars else -1.0
    length = int(np.log2(max(1.0, n))) if n >= 0 else None
    for name, value in (("source", source), ("lang", lang), ("both", f"{source} {lang}"), ("length", length)):
        out[zlib.crc32(f"{name}={value}".encode()) % (META_WIDTH - 2)] += 1
    out[-2] = np.log1p(max(0.0, n)) / 4
    out[-1] = n < 0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic model by Nesterov's gradient steps from zero."""
    x = np.c_[x, np.ones(len(x), x.dtype)].astype(np.float32)
    w = np.zeros(x.shape[1])
    ahead, total = w.copy(), weight.sum()
    rate = 4 * total / max(1e-9, float((weight[:, None] * x * x).sum()))
    for t in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (weight * (p - y)) / total + ridge * ahead)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)


#: From the models of both views, the rows each may not take (by key), and how many good and bad ones to take:
#: for each view the unlabelled rows it is surest of, as (key, label, (content, meta)).
Surest = Callable[[list[np.ndarray], list[set[int]], int, int], list[list[tuple[int, float, tuple[np.ndarray, np.ndarray]]]]]


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Surest) -> dict | None:
    """The two classifiers and their calibrated combination; None without labels of both kinds."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 0  # for calibration
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    views = [content[~held], meta[~held]]
    truth = y[~held].astype(float)
    balance = np.where(truth == 1, 0.5 / truth.mean(), 0.5 / (1 - truth.mean()))
    # What each classifier learns from: the labelled rows, then what the other one is sure of.
    extra: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]
    good = max(1, int(ADDED * truth.mean()))
    models: list[np.ndarray] = []
    for turn in range(ROUNDS + 1):
        models = []
        for k in (0, 1):
            rows = list(extra[k].values())
            x = np.r_[views[k], np.stack([v for _, v in rows])] if rows else views[k]
            labels = np.r_[truth, [label for label, _ in rows]]
            models.append(fit_logistic(x, labels, np.r_[balance, np.full(len(rows), 0.5)]))
        if turn == ROUNDS:
            break
        found = surest(models, [set(extra[1]), set(extra[0])], good, max(1, ADDED - good))
        for k in (0, 1):
            extra[1 - k] |= {key: (label, both[1 - k]) for key, label, both in found[k]}
        if not any(found):
            break
    rows = held if held.any() else np.ones(len(y), bool)
    z = np.c_[logit(models[0], content[rows]), logit(models[1], meta[rows])]
    seen = y[rows].astype(float)
    # Platt's calibration of each view, then the weights of the two calibrated views.
    scale = [fit_logistic(z[:, [k]], seen, np.ones(len(seen)), 1e-3) for k in (0, 1)]
    both = np.c_[logit(scale[0], z[:, [0]]), logit(scale[1], z[:, [1]])]
    return {"models": models, "scale": scale, "mix": fit_logistic(both, seen, np.ones(len(seen)), 1e-3)}


def score(model: dict | None, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Probability of good quality, and that of each view: three columns."""
    if model is None:
        return np.full((len(content), 3), 0.5)
    each = [logit(s, logit(m, x)[:, None]) for m, s, x in zip(model["models"], model["scale"], (content, meta), strict=True)]
    z = np.c_[logit(model["mix"], np.c_[each[0], each[1]]), each[0], each[1]]
    return 1 / (1 + np.exp(-z))


def features(texts: list, metas: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    content = np.stack([content_features(t) for t in texts]) if texts else np.zeros((0, CONTENT_WIDTH), np.float32)
    meta = np.stack([meta_features(*m) for m in metas]) if texts else np.zeros((0, META_WIDTH), np.float32)
    return content, meta


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict | None:
    """Fit on so many labelled rows at most and all unlabelled ones.

    docs: doc_id, text, source, lang, n_chars; labels: doc_id, quality.
    """
    spark = docs.sparkSession
    cols = ["doc_id", "text", *META]

    @F.pandas_udf("content binary, meta binary")
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            c, m = features(list(b["text"]), list(zip(*[b[x] for x in META], strict=True)))
            yield pd.DataFrame({"content": [r.tobytes() for r in c], "meta": [r.tobytes() for r in m]})

    def sample(ids: DataFrame, n: int) -> list:
        """The rows with the n smallest hashed ids. Only ids are sorted; texts are read for the chosen."""
        chosen = [r.doc_id for r in ids.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).distinct().orderBy("h").limit(n).select("doc_id").collect()]
        if not chosen:
            return []
        # Bounded by n: a broadcast of ids.
        small = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long"))
        rows = docs.select(*cols).join(small, "doc_id", "left_semi")
        got = rows.select("doc_id", F.xxhash64(*cols).alias("row"), vectors(F.struct("text", *META)).alias("v"))
        got = got.groupBy("doc_id").agg(F.min_by("v", "row").alias("v")).select("doc_id", "v.*").collect()
        place = {i: k for k, i in enumerate(chosen)}
        return sorted(got, key=lambda r: place[r.doc_id])

    ids = docs.select("doc_id").where("doc_id is not null")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = ids.join(known, "doc_id")
    learned = sample(marked, labelled)
    if not learned:
        return None
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in learned], "doc_id long"))
    truth = {r.doc_id: r.quality for r in known.join(wanted, "doc_id", "left_semi").collect()}
    arrays = lambda r: (np.frombuffer(r.content, np.float32), np.frombuffer(r.meta, np.float32))
    content, meta = (np.stack(x) for x in zip(*map(arrays, learned), strict=True))

    # Equal rows are one; rows of one id that differ are documents each.
    key = F.xxhash64("doc_id", "text", *META)
    every = docs.select(key.alias("key"), *cols)

    def surest(models: list[np.ndarray], taken: list[set[int]], good: int, bad: int) -> list[list]:
        sent = spark.sparkContext.broadcast(models)

        @F.pandas_udf("z0 double, z1 double")
        def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            let_go()
            for b in batches:
                parts = []
                for lo in range(0, len(b), 1000):
                    own = b.iloc[lo : lo + 1000]
                    both = features(list(own["text"]), list(zip(*[own[x] for x in META], strict=True)))
                    parts.append(np.stack([logit(m, x) for m, x in zip(sent.value, both, strict=True)], axis=1))
                yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 2)), columns=["z0", "z1"])

        # Only keys and log-odds are joined and ranked; the texts stay where they are.
        z = every.select("key", "doc_id", logits(F.struct("text", *META)).alias("z")).select("key", "doc_id", "z.*")
        z = z.join(known.select("doc_id"), "doc_id", "left_anti")
        views = F.array(*[F.struct(F.lit(k).alias("view"), F.col(f"z{k}").cast("double").alias("z")) for k in (0, 1)])
        sure = z.select("key", F.explode(views).alias("v")).select("key", "v.*").where("abs(z) > 2")
        for k in (0, 1):
            if taken[k]:
                sure = sure.where((F.col("view") != k) | ~F.col("key").isin(list(taken[k])))
        sure = sure.groupBy("view", "key").agg(F.max("z").alias("z")).withColumn("good", F.col("z") > 0)
        # The surest of each of SALTS parts, then of these: no task sorts a whole side.
        order = (F.abs("z").desc(), F.col("key"))
        part = W.partitionBy("view", "good", F.pmod(F.col("key"), F.lit(SALTS))).orderBy(*order)
        most = F.when(F.col("good"), good).otherwise(bad)
        some = sure.withColumn("place", F.row_number().over(part)).where(f"place <= {ADDED}")
        ranked = some.withColumn("place", F.row_number().over(W.partitionBy("view", "good").orderBy(*order)))
        chosen = ranked.where(F.col("place") <= most).where(f"place <= {ADDED}").collect()
        if not chosen:
            return [[], []]
        rows = every.where(F.col("key").isin(list({r.key for r in chosen}))).select("key", vectors(F.struct("text", *META)).alias("v")).groupBy("key").agg(F.first("v").alias("v")).select("key", "v.*")
        own = {r.key: arrays(r) for r in rows.collect()}
        chosen.sort(key=lambda r: (r.view, not r.good, r.place))
        return [[(r.key, float(r.good), own[r.key]) for r in chosen if r.view == k] for k in (0, 1)]

    return co_train(content, meta, np.array([int(truth[r.doc_id] > 0) for r in learned]), surest)


def score_column(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with quality, content_quality and meta_quality (0 to 1) and keep. A narrow map."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("quality double, content_quality double, meta_quality double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            parts = []
            for lo in range(0, len(b), 1000):
                own = b.iloc[lo : lo + 1000]
                parts.append(score(held.value, *features(list(own["text"]), list(zip(*[own[x] for x in META], strict=True)))))
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3)), columns=["quality", "content_quality", "meta_quality"])

    name = spare_name(docs, "scored")
    out = docs.withColumn(name, run(F.struct("text", *META)))
    for c in ("quality", "content_quality", "meta_quality"):
        out = out.withColumn(spare_name(docs, c), F.col(f"{name}.{c}"))
    return out.withColumn(spare_name(docs, "keep"), F.col(f"{name}.quality") >= KEEP).drop(name)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, unchanged, that the classifier doesn't reject."""
    out = score_column(docs, train(docs, labels))
    return out.where(F.col(spare_name(docs, "keep"))).select(*[F.col(f"`{c}`") for c in docs.columns])
