"""Secret scans: fixed patterns, and character Markov models for what they miss. DataFrame functions only.

Three kinds of span come from patterns (leftmost non-overlapping matches, then a length test). The
fourth, `random`, comes from two first-order character Markov models, one of random strings and one of
ordinary identifiers, fitted to labelled samples: a run of token characters is a secret if the mean
log-likelihood ratio of its character pairs reaches a threshold, and it touches no span of a pattern.

Offsets are code points, ends exclusive. They come from the lengths of the matches and of what
stands between them, so that no text is walked in Python.

Defined cases: a null text is the empty text and has no spans; the hash of no spans is that of the
empty string; equal starts are ordered by kind (assign, access, hex, random); repeated rows get equal
results; no documents, no rows; other columns pass through, and a result column whose name is taken gets
underscores before it. Texts are scanned whole. Work grows in proportion to the text, the length of its
runs and the number of its spans (but for one sort): nothing that a lambda reads is worked out again for
each element (`let`), and running totals are made in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare_name

#: The fixed patterns: kind, what to look for before the costlier steps, pattern, group and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the Markov models: runs of at least so many token characters, whatever they hold.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Mean log-likelihood ratio of a character pair from which a run counts as random.
RATIO = 0.5
#: Parts of ordinary identifiers, for the labelled samples (fixed list).
PARTS = (
    "account action active address admin agent alias amount app archive array asset async auth author average backup "
    "balance base batch block body bool branch buffer build button cache call cancel card cart category channel char "
    "check child class clean click client clone close cloud code column command comment commit common company config "
    "connect container content context control copy count country create current cursor custom customer data database "
    "date default delete delta department description detail device dialog digest directory display document domain "
    "download draft drop duration edge edit element email employee enable encode engine entry error event example "
    "execute export factory feature field file filter final first flag float folder footer form format frame function "
    "gateway global graph group handle header height hidden history home host html http icon image import index info "
    "init input insert instance integer interface internal invoice item iterator job join key label language last layer "
    "layout length level library limit line link list local location lock log login loop main manager map margin master "
    "match max member memory menu merge message meta method metric middle min mobile mode model module monitor month "
    "name native network next node normal note null number object offset online open operator option order origin output "
    "owner package page panel parent parse part password path pattern payment pending percent period phone pixel player "
    "plugin point policy pool port position post prefix previous price primary print priority private process product "
    "profile project property provider proxy public publish query queue quick range rate read record refresh region "
    "register release remote remove render report request reset resource response result return review role root route "
    "row rule sample save schema scope screen script scroll search second secret section security select sender serial "
    "server service session set shadow shape share shift size slot sort source space spec split stack stage standard "
    "start state static status step stock stop storage store stream string style submit subject summary support switch "
    "symbol sync system table tag target task team template test text thread time title token tool topic total track "
    "transaction transfer transform tree trigger type unit update upload user utility valid value variable vector "
    "version video view visible volume warning web week weight widget width window word worker wrapper write year zone"
)


def labelled_samples(spark: SparkSession, count: int = 4000) -> DataFrame:
    """(text, random): random strings as hex, base64 and upper-case digits; identifiers, rulers and dates."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest("b"))), "=+$", "")
    randoms = F.element_at(
        F.array(F.substring(digest("h"), 1, 40), base64, F.substring(F.upper(F.regexp_replace(base64, "[+/]", "7")), 1, 24), F.translate(base64, "+/", "-_")),
        (F.col("id") % 4 + 1).cast("int"),
    )
    words = F.split(F.lit(PARTS), " ")
    word = lambda salt: F.element_at(words, (F.pmod(F.xxhash64(F.lit(salt), "id"), F.size(words)) + 1).cast("int"))
    w = [word(k) for k in range(4)]
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)).cast("string")
    names = F.element_at(
        F.array(
            F.concat_ws("_", w[0], w[1], w[2], number),
            F.concat(w[0], F.initcap(w[1]), F.initcap(w[2]), F.initcap(w[3]), number),
            F.concat_ws("-", w[0], w[1], w[2], number),
            F.upper(F.concat_ws("_", w[0], w[1], w[2], number)),
            F.concat_ws("/", w[0], w[1], w[2], F.concat(w[3], number)),
            F.concat(w[0], w[1], w[2], w[3]),
            # Rulers, and dates joined to words.
            F.concat(F.repeat(F.substring(F.lit(ALPHABET), (F.floor(F.col("id") / 8) % len(ALPHABET) + 1).cast("int"), F.lit(1)), 24), number),
            F.concat_ws("-", w[0], F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 3).cast("int")), "yyyy-MM-dd-HHmmss")),
        ),
        (F.col("id") % 8 + 1).cast("int"),
    )
    ids = spark.range(count)
    return ids.select(randoms.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(names.alias("text"), F.lit(False).alias("random")))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, by position first * size + second.

    samples: text, random. What comes to the driver is bounded by the alphabet: 2 * 67^2 counts.
    """
    size = len(ALPHABET)
    text = F.coalesce(F.col("text"), F.lit(""))
    pairs = samples.where("random is not null").select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))).alias("pair")
    )
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()}
    out = []
    totals = {(c, a): sum(counts.get((c, a + b), 0) for b in ALPHABET) for c in (True, False) for a in ALPHABET}
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = ((counts.get((c, a + b), 0) + 0.5) / (totals[c, a] + 0.5 * size) for c in (True, False))
            out.append(round(math.log(p / q), 6))
    return out


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often `then` and its lambdas read it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Inclusive running totals of array<bigint> under join; arrays grow by one only within a block."""
    def plain(array: Column) -> Column:
        more = lambda acc, x: F.concat(acc, F.array(F.coalesce(join(F.try_element_at(acc, F.lit(-1)), x), x)))
        return F.aggregate(array, F.array().cast("array<bigint>"), more)

    def in_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / block).cast("int"))
        return let(F.transform(starts, lambda k: plain(F.slice(v, k * block + 1, F.lit(block)))), joined)

    def joined(parts: Column) -> Column:
        ends = plain(F.transform(parts, lambda a: F.try_element_at(a, F.lit(-1))))
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(ends, F.lit(1), F.size(parts) - 1))
        return F.flatten(F.zip_with(parts, before, lambda a, e: F.transform(a, lambda x: F.coalesce(join(e, x), x))))

    return let(values, in_blocks)


def plus(a: Column, b: Column) -> Column:
    return a + b


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def matches(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's matches that keep(match) holds for."""
    def measured(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        size = lambda c: F.length(c).cast("long")
        return F.zip_with(found, between, lambda m, gap: F.struct((size(gap) + size(m)).alias("both"), size(m).alias("own"), keep(m).alias("keep")))

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda m: m["both"]), plus)
        spans = F.zip_with(found, ends, lambda m, e: F.struct((e - m["own"]).alias("start"), e.alias("end"), m["keep"].alias("keep")))
        return F.transform(F.filter(spans, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return let(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), measured), placed)


def log_ratio(run: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the pairs of a run of token characters."""
    size = len(ALPHABET)
    n = F.length(run) - 1

    def total(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.coalesce(F.get(table, a * size + b), F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), plus)

    return let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), total) / n


def free_of(base: Column, more: Column) -> Column:
    """All spans, sorted: base, and those of more that touch none of base."""
    def swept(spans: Column) -> Column:
        is_base = lambda s: s["kind"] < len(PATTERNS)
        # The greatest end of a base span up to each span's start, and the next base span's start.
        ended = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)), F.greatest)
        coming = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), s["start"]).otherwise(2**62))), F.least))
        seen = F.zip_with(F.zip_with(spans, ended, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), coming, lambda x, c: F.struct(x["s"].alias("s"), x["e"].alias("e"), c.alias("c")))
        free = F.filter(seen, lambda x: is_base(x["s"]) | (x["e"] <= x["s"]["start"]) & (x["c"] >= x["s"]["end"]))
        return F.transform(free, lambda x: x["s"])

    return let(F.array_sort(F.concat(base, more)), swept)


def digest_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """docs with `found`: base (the patterns' spans) and all (those and the models'), by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    base = []
    for k, (_, first, pattern, group, least) in enumerate(PATTERNS):
        # A match, taken alone, matches as it did in the text: nothing looks beyond it.
        keep = (lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n) if group else (lambda m: F.lit(True))
        base.append(F.when(t.rlike(first), matches(t, pattern, k, keep)).otherwise(none))
    table = F.split(F.lit(" ".join(map(repr, ratios))), " ").cast("array<double>")
    likely = matches(t, RUN, 3, lambda m: log_ratio(m, table) >= RATIO)
    name, raw = spare_name(docs, "found"), spare_name(docs, "found_raw")
    out = docs.withColumn(raw, F.struct(F.array_sort(F.concat(*base)).alias("base"), F.when(t.rlike(RUN), likely).otherwise(none).alias("more")))
    b, m = F.col(f"{raw}.base"), F.col(f"{raw}.more")
    every = F.when(F.size(m) > 0, free_of(b, m)).otherwise(b)
    return out.withColumn(name, F.struct(b.alias("base"), every.alias("all"))).drop(raw)


def digests(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    found = spare_name(docs, "found")
    out = scan(docs, ratios, text)
    every = F.col(f"{found}.all")
    of_kind = lambda k: F.filter(every, lambda s: s["kind"] == k)
    for k, kind in enumerate(KINDS):
        out = out.withColumn(spare_name(docs, f"n_{kind}"), F.size(of_kind(k)).cast("long"))
    out = out.withColumn(spare_name(docs, "base_sha256"), F.sha2(digest_of(F.col(f"{found}.base")), 256))
    return out.withColumn(spare_name(docs, "spans"), digest_of(every)).drop(found)


def redact(docs: DataFrame, ratios: list[float], mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by the mask; nothing else changes.

    n_chars, where it is among the columns, is set to the new length of a changed text.
    """
    found = spare_name(docs, "found")
    spans = F.col(f"{found}.all")
    piece = 1024

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        """Code points start to end of the text whose pieces of so many code points the chunks are."""
        first = F.floor(start / piece)
        held = F.array_join(F.slice(chunks, (first + 1).cast("int"), (F.floor(end / piece) - first + 1).cast("int")), "")
        return F.substring(held, (start - first * piece + 1).cast("int"), (end - start).cast("int"))

    def masked(chunks: Column) -> Column:
        ended = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        before = F.concat(F.array(F.lit(0).cast("long")), F.slice(ended, F.lit(1), F.size(spans) - 1))
        parts = F.zip_with(spans, before, lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(cut(chunks, at, s["start"]), F.lit(mask))))
        return F.concat(F.array_join(parts, ""), cut(chunks, F.element_at(ended, -1), F.length(F.col(text)).cast("long")))

    folded = let(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), masked)
    hit = F.size(spans) > 0
    out = scan(docs, ratios, text).withColumn(text, F.when(hit, folded).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(F.col(text)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
