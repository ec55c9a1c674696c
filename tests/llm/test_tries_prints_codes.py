"""Conversation tries, document fingerprints and vector codes against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import conversations, decontaminate, fingerprints, licenses, near_duplicates, topk, vector_codes
from tracewright.llm.queries import QUERIES

# 11 ---------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie(rows):
    """Every prefix of every rebuilt conversation, in plain Python."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            convs[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in convs.items()}
    built = {c: tuple(own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :]) for c, v in own.items()}
    nodes, below = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for p in nodes:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if c % 3 else 100 * (c // 3)
        start = r.choice([["a", "b"], ["a"], ["a", "c"], []])
        rest = [r.choice("xyz") + r.choice(["", "é", "😀"]) for _ in range(r.choice([0, 1, 3, 9]))]
        rows += [(c, t, r.choice(["user", "user", None]) if t > 2 else "user", x) for t, x in enumerate(start + rest)]
    rows += [(500 + i, t, "user", f"turn {t}") for i in range(20) for t in range(30)]  # copies, long
    rows += [(800 + i, t, "user", f"turn {t}") for i in range(6) for t in range(14 + i)]  # each the prefix of the next
    rows += [(7000, None, "user", "first"), (7000, 1, None, None), (7000, 1, None, None), (None, 0, "user", "lost"), (7001, -5, "user", "x")]
    return rows


@pytest.mark.parametrize("local, block, hot, turns", [(128, 64, 1000, 1 << 20), (3, 8, 4, 40)])
def test_trie_equals_brute_force(spark, monkeypatch, local, block, hot, turns):
    for name, value in (("LOCAL", local), ("BLOCK", block), ("HOT", hot), ("LOCAL_TURNS", turns), ("PIECE", 3), ("PACK", 4)):
        monkeypatch.setattr(conversations, name, value)
    rows = talks(local)
    got = conversations.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert got.dtypes == [tuple(c.split()) if c.split()[1] != "long" else (c.split()[0], "bigint") for c in conversations.NODE.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_trie_of_little(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.prefix_trie(empty).collect() == []
    assert conversations.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).collect() == []
    # Without a root conversation, a conversation shorter than its opening has no turns at all.
    c = next(c for c in range(1, 50) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    got = conversations.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert list(map(tuple, got)) == trie(rows) and len(got) == 1 and got[0].n_leaves == 1


def test_trie_with_clashing_columns(spark):
    rows = [(c, t, "user", "abc"[t], 1, "b", [1]) for c in (0, 100, 200) for t in range(3)]
    got = conversations.prefix_trie(spark.createDataFrame(rows, TURNS + ", position int, bucket string, turns array<int>"))
    assert sorted(map(tuple, got.collect()), key=str) == trie([r[:4] for r in rows])


def test_trie_of_very_long_texts(spark):
    rows = [(c, 0, "user", "lorem ipsum " * 200_000) for c in (0, 600, 900)]
    assert sorted(map(tuple, conversations.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == trie(rows)


def test_multikey_quicksort_of_a_comb():
    """Each conversation is the opening of the next: a trie as deep as there are conversations."""
    rows = [(i, [(7, 2)] * (i + 1)) for i in range(300)]
    nodes = sorted(conversations.multikey(rows, 0, 0), key=lambda n: n[1])
    assert [(n[0], n[1], n[3], n[4], n[5]) for n in nodes] == [(d, d + 1, 300 - d, int(d < 299), 1) for d in range(300)]


# 12 ---------------------------------------------------------------------------------------------------------

def plain_print(text):
    """The fingerprint code point by code point."""
    text = text or ""
    mask = fingerprints.WORD - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * fingerprints.MIX) & mask
        return x ^ (x >> 29)

    if not text:
        return "1::"
    codes = [mixed(ord(ch) + 1) for ch in text]
    levels = []
    for i in range(len(codes) - 1):
        rolled = sum(codes[i - k] * pow(fingerprints.ROLL, k, fingerprints.WORD) for k in range(fingerprints.WINDOW) if i >= k) & mask
        value = (mixed(rolled) >> 32) | (1 << 32)
        levels.append((value & -value).bit_length() - 1)
    level = 0
    while sum(x >= level for x in levels) >= fingerprints.MOST_PIECES:
        level += 1

    def signature(least):
        out, start = "", 0
        for end in [i for i, x in enumerate(levels) if x >= least] + [len(codes) - 1]:
            x = sum(c * pow(fingerprints.PIECE, k, fingerprints.WORD) for k, c in enumerate(codes[start : end + 1])) & mask
            x = ((x ^ (x >> 31)) * fingerprints.MIX) & mask
            out += fingerprints.CHARACTERS[x >> 58]
            start = end + 1
        return out

    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def alike(s, t):
        run = min(fingerprints.RUN, (min(len(s), len(t)) + 1) // 2)
        if not run or not any(s[i : i + run] in t for i in range(len(s) - run + 1)):
            return 0.0
        far = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            before, far[0] = far[0], i
            for j, y in enumerate(t, 1):
                before, far[j] = far[j], before if x == y else 1 + min(far[j], far[j - 1])
        return 1 - far[-1] / (len(s) + len(t))

    (x, *f), (y, *g) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    pairs = {0: [(0, 0), (1, 1)]}.get(x - y) or ([(0, 1)] if x == 2 * y else [(1, 0)] if y == 2 * x else [])
    return max((alike(f[i], g[j]) for i, j in pairs), default=0.0)


def texts(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé中😀") for _ in range(r.randint(1, 8)))
    out = [None, "", "a", "ab", "abc", "abcd", "x" * 500, "ab " * 400]
    out += [" ".join(word() for _ in range(r.choice([2, 20, 200, 900]))) for _ in range(n)]
    return out + out[-4:]


def test_fingerprints_equal_the_plain_ones(monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 97)  # many blocks: pieces and windows cross their borders
    all_texts = texts(1)
    prints = [fingerprints.fingerprint(t) for t in all_texts]
    assert prints == [plain_print(t) for t in all_texts]
    for a, b in zip(prints, prints[1:] + prints[:1], strict=True):
        assert fingerprints.likeness(a, b) == pytest.approx(plain_likeness(a, b), abs=1e-12)
    edits = [fingerprints.fingerprint(fingerprints.edited(t or "", u or "")) for t, u in zip(all_texts, all_texts[1:] + all_texts[:1], strict=True)]
    for a, b in zip(prints, edits, strict=True):
        assert fingerprints.likeness(a, b) == pytest.approx(plain_likeness(a, b), abs=1e-12)
    assert all(s.split(":")[1] == "" or 0 < len(s.split(":")[1]) <= 64 for s in prints)


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        a, b, c = map(plain_print, (text, changed, after))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def rounded(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 12])
def test_next_documents(spark, parts):
    rows = [(3 * i, t) for i, t in enumerate(texts(2, 24))] + [(None, "no id at all")]
    random.Random(3).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert rounded(got) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_of_little(spark):
    schema = "doc_id long, text string, n_chars string, part int, edge int"
    assert fingerprints.with_next(spark.createDataFrame([], schema)).collect() == []
    one = fingerprints.with_next(spark.createDataFrame([(5, "one short text", "?", 1, 2)], schema)).collect()
    assert [(r.doc_id, r.near_next, r.n_chars) for r in one] == [(5, 1.0, 14)]
    same = fingerprints.with_next(spark.createDataFrame([(1, "same text", "", 0, 0)] * 3 + [(1, "another text", "", 0, 0)], schema)).collect()
    assert sorted(r.near_next == 1.0 for r in same) == [False, False, True, True]


def test_edited_documents_stay_alike(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    docs = [" ".join(r.choice(words) for _ in range(n)) for n in [10, 60, 400, 3000] * 10]
    got = fingerprints.with_next(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert min(x.near_edited for x in got) > 0.5 and max(x.near_next for x in got) < 0.4


def test_fingerprint_of_a_very_long_text():
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    whole = fingerprints.fingerprint(text)
    cut = text[:1_500_000] + "!" + text[1_500_000:]
    assert 32 <= len(whole.split(":")[1]) <= 64 and fingerprints.likeness(whole, fingerprints.fingerprint(cut)) > 0.9


# 13 ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, entries, rounds, parts, scale=1024):
    """Every distance of every part, in Python's integers."""
    kept = [(i, [int(np.floor(x * scale)) if abs(x) < 2**40 else int(x) * scale for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = lambda v: [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)]
    kept = [(i, cut(v), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]
    nearest = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(books[p], v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(books[p], v[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, None if label is None else str(label), "".join(f"{k:02x}" for _, k in found), error if error < 2**63 else None))
    return sorted(out, key=str), books


def vectors(seed, n=160, width=8, spread=5):
    r = random.Random(seed)
    # Coarse values: many equal distances, so that ties must be broken by index.
    rows = [(i, [r.randrange(-spread, spread) / 8 for _ in range(width)], r.choice([0, 1, None])) for i in range(n)]
    rows += [(rows[3][0], rows[3][1], 1), (None, [0.5] * width, 2), (900, None, 1), (901, [1.0, None] * (width // 2), 1), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, 1)]
    return rows + [(904, [0.25] * (width - 3), 0), (905, [], 0)]


@pytest.mark.parametrize("seed, entries", [(1, 16), (2, 256)])
def test_codes_equal_brute_force(spark, seed, entries):
    rows = vectors(seed)
    got, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries)
    want, want_books = plain_codes(rows, entries, 4, 4)
    assert books == want_books
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_codes_of_huge_components(spark):
    rows = vectors(4, 60) + [(2000, [1e20] * 8, 1), (2001, [1e20, -1e20] * 4, 1), (1, [3e18, 0.5] * 4, 7), (2002, [1e6] * 8, 7)]
    got, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS), entries=12)
    want, want_books = plain_codes(rows, 12, 4, 4)
    assert books == want_books
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_label_errors_and_digest(spark):
    rows = vectors(6)
    out = vector_codes.digests(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", code string, error int")).collect()
    want, books = plain_codes(rows, 256, 4, 4)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out], key=str) == sorted([(i, code, e, sums[label], digest) for i, label, code, e in want], key=str)


def test_label_errors_when_labels_are_many(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)
    df = spark.createDataFrame(vectors(7), VECTORS)
    many = sorted(map(tuple, vector_codes.digests(df).collect()), key=str)
    monkeypatch.undo()
    assert many == sorted(map(tuple, vector_codes.digests(df).collect()), key=str)


def test_codes_of_nothing(spark):
    assert vector_codes.digests(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.digests(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], VECTORS)).collect() == []
    one = vector_codes.digests(spark.createDataFrame([(1, [], None)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(1, "00000000", 0, 0)]


def test_the_annulus_is_inclusive():
    """Entries on both borders of the annulus are as near as the best: the lower index wins."""
    book = vector_codes.Codebook([[5], [-1], [3], [1]], 1)
    index, best = book.nearest(np.array([[2.0], [4.0], [0.0]]))
    assert index.tolist() == [2, 0, 1] and best.tolist() == [1, 1, 1]
    low, high = book.annulus(np.array([2.0]), np.array([1.0]))
    assert book.norms[low[0] : high[0]].tolist() == [1.0, 1.0, 3.0]


def test_new_queries_are_registered():
    assert {"op11_conversation_prefix_trie", "op12_document_fingerprints", "op13_vector_code_compression"} <= set(QUERIES)


# 3, 5, 6, 8: what earlier forms got wrong -------------------------------------------------------------------

def test_one_huge_vector_does_not_stop_the_search(spark):
    """Only a score among the five that doesn't fit a long is an error."""
    rows = [(i, [float(i), 1.0]) for i in range(12)] + [(100, [-1e20, 0.0]), (101, [-1e30, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id").isin(3, 8), k=5).collect()
    m = 65536
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(q, i, (q * i + 1) * m) for q in (3, 8) for i in [i for i in range(11, 5, -1) if i != q][:5]]
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(df, F.col("vec_id") == 100, k=5).collect()
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(df.where("vec_id < 3 or vec_id = 100"), F.col("vec_id") == 2, k=5).collect()


def longest_in_order(words, template):
    """The best count of pairs that stand in order in any band of diagonals, vote by vote."""
    votes = [(t, p) for p in range(len(words) - 1) for t in range(len(template) - 1) if words[p : p + 2] == template[t : t + 2]]
    best = 0
    for centre in {p - t for t, p in votes}:
        band = sorted(v for v in votes if abs(v[1] - v[0] - centre) <= licenses.DRIFT)
        longest = []
        for i, (t, p) in enumerate(band):
            longest.append(1 + max((longest[j] for j in range(i) if band[j][0] < t and band[j][1] < p), default=0))
        best = max(best, *longest)
    return best


def plain_labels(text):
    words, found = text.lower().split(), set()
    for label, template in [(n, p) for p, n in licenses.PHRASES] + list(licenses.TEMPLATES):
        t = template.split()
        pairs = len(t) - 1
        if pairs <= licenses.SHORT:
            ok = any(words[i : i + len(t)] == t for i in range(len(words)))
        else:
            ok = longest_in_order(words, t) >= licenses.COVER * pairs
        if ok:
            found.add(label)
    return ",".join(sorted(found))


def license_texts():
    r = random.Random(11)
    bsd = next(p for n, p in licenses.TEMPLATES if n == "bsd").split()
    whole = max((p for n, p in licenses.TEMPLATES if n == "mit"), key=len).split()
    pairs = [bsd[i : i + 2] for i in range(len(bsd) - 1)]
    backwards = [w for p in reversed(pairs) for w in p]
    scattered = [w for p in pairs for w in [*p, *(["filler"] * 20)]]
    out = [bsd, backwards, scattered, bsd[10:] + bsd[:10], whole, whole[:40] + ["x"] * 3 + whole[40:], whole[:60] + whole[63:120] + ["y", "z"] + whole[120:], whole[::2], ["the"] * 300, (["of", "this", "software"] * 100)]
    for _ in range(25):
        t = list(r.choice([bsd, whole, r.choice(licenses.TEMPLATES)[1].split()]))
        for _ in range(r.randint(0, len(t) // 6 + 1)):
            i = r.randrange(len(t))
            t[i : i + r.choice([0, 1, 2])] = r.choice([[], ["word"], ["the"], [t[r.randrange(len(t))]]])
        out.append(["before"] * r.randint(0, 4) + (t or ["none"]) + ["after"])
    return [" ".join(t) for t in out]


def test_license_spans_are_aligned_in_order(spark):
    texts = license_texts()
    rows = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [r.labels for r in rows]
    assert got == [plain_labels(t) for t in texts]
    # The pairs in another order, scattered, or the halves exchanged are no license; the text with a few words put in is.
    assert got[0] == "bsd" and got[1:4] == ["", "", ""] and got[4:6] == ["mit", "mit"] and got[7:10] == ["", "", ""]


def test_whole_licenses_are_templates():
    assert max(len(p.split()) for _, p in licenses.TEMPLATES) > 150


def near_texts(n, seed=12):
    r = random.Random(seed)
    out = []
    for _ in range(n // 2):
        words = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(40)]
        out += [" ".join(words), " ".join(words[:-1] + ["end"])]
    return out


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_groups_of_null_and_repeated_ids(spark, ids):
    """Ids say nothing of what is compared: with none, with one for all, the same texts are linked."""
    texts = near_texts(200) + near_texts(200)[:50] * 3
    rows = [({"null": None, "equal": 7, "own": i}[ids], t) for i, t in enumerate(texts)]
    out, _ = near_duplicates.rooted_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, (80, 100), "doc_id", "text")
    got = out.groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == sorted([2] * 75 + [8] * 25)
    components = {r.component_id for r in out.select("component_id").collect()}
    assert components == ({None} if ids == "null" else {7} if ids == "equal" else {2 * i for i in range(100)})


def test_null_ids_cost_what_ids_cost(spark):
    """Rows without ids are joined by their texts: the join gives a row a class, not a row for each pair."""
    import time

    texts = near_texts(1200)
    took = {}
    for name in ("warm", "own", "null"):
        df = spark.createDataFrame([(None if name == "null" else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        began = time.monotonic()
        assert near_duplicates.similar_groups(df, 3, (80, 100)).count() == len(texts)
        took[name] = time.monotonic() - began
    assert took["null"] < 2 * took["own"] + 5


def test_a_large_benchmark_takes_passes_one_at_a_time(spark, monkeypatch):
    r = random.Random(13)
    item = lambda: " ".join(r.choice("klmnop") + str(r.randrange(3000)) for _ in range(40))
    items = [(i, item()) for i in range(60)]
    docs = [(i, " ".join([item(), items[i % 60][1] if i % 3 else "", item()])) for i in range(90)] + [(None, items[3][1]), (None, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=str)
    clean = sorted(map(tuple, decontaminate.without_leaks(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert decontaminate.Passes(bench).turns > 4
    many = decontaminate.leaks(docs, bench)
    # What the passes found is read back: no task of the result runs a finder, let alone several.
    assert "ArrowEvalPython" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect()), key=str) == one and len(one) == 61
    assert sorted(map(tuple, decontaminate.without_leaks(docs, bench).collect()), key=str) == clean and len(clean) == 31


def test_words_are_hashed_without_a_call_for_each():
    import sys

    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    text = " ".join(f"word{i}" for i in range(5000))
    near_duplicates.shingles(text, 3)
    other = text.replace("word", "term")
    sys.setprofile(seen)
    try:
        got = near_duplicates.shingles(other, 3)
    finally:
        sys.setprofile(None)
    assert len(got) == 4998 and calls < 500


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
def test_hashed_words_are_those_of_a_plain_split(monkeypatch, piece):
    monkeypatch.setattr(near_duplicates, "PIECE", piece)
    spaces, r = " \t\n\r\x0b\x0c", random.Random(piece)
    words = ["a", "b", "ab", "ba", "aab", "é", "日本", "\x1c", "\xa0", "x" * 63, "x" * 64, "x" * 65, "y" + "x" * 64, "x" * 64 + "y", "z" * 500]
    texts = ["", " ", "\n\t ", "a", " a", "a ", "x" * 65, *("".join(r.choice(words) + r.choice(spaces) * r.randrange(1, 4) for _ in range(r.randrange(60))) for _ in range(60))]
    hashes = {}
    for text in texts:
        plain = text.encode().split()
        for word, h in zip(plain, near_duplicates.word_hashes(text.encode()).tolist(), strict=True):
            assert hashes.setdefault(word, h) == h
        w = text.lower().encode().split()
        assert len(near_duplicates.shingles(text, 3)) == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else ())
    assert len(set(hashes.values())) == len(hashes) == len(words)
