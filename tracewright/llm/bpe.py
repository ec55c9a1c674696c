"""Exact byte-pair encoding by a dynamic programme over prefixes, and decoding.

Every prefix of a pre-token has exactly one BPE encoding, so it has exactly one last token. For the
prefix of length i the programme tries the vocabulary tokens that end at i (found by walking a suffix
automaton of the vocabulary) and keeps the one that can stand beside the last token of what is left:
two neighbouring tokens are compatible when BPE, run on their joined bytes, gives these two tokens
again. Back-pointers then give the exact ids. A prefix's answer does not depend on what follows, so
sorted pre-tokens share the work of their common prefixes.

Defined cases: a null text is the empty text; the empty text has no ids and decodes to ""; the
strings of the vocabulary's special tokens become their ids wherever they stand, as the tokenizers
library does by default; repeated rows get equal results; other columns pass through untouched, and a
result column whose name is taken gets underscores before it. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, spare_name

#: Entries of a generation of a worker's caches; two generations are held, so that memory stays bounded.
CACHE_ENTRIES = 60_000
#: Answers of the pair test that a worker remembers.
PAIR_ENTRIES = 150_000
#: White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of byte-level BPE vocabularies (fixed value).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "n_tokens long, ids binary, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class SuffixAutomaton:
    """Recognises every substring of the given byte strings; a state knows which of them are its suffixes."""

    def __init__(self, tokens: list[bytes]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for token in tokens:
            last = 0
            for b in token:
                last = self._extend(last, b)
        # full[state] = id of the token that is this state's string of its own length
        self.own: dict[int, list[tuple[int, int]]] = {}
        for k, token in enumerate(tokens):
            state = 0
            for b in token:
                state = self.step[state][b]
            self.own.setdefault(state, []).append((len(token), k))
        self._ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, b: int, q: int) -> int:
        clone = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(b) == q:
            self.step[p][b] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, b: int) -> int:
        if b in self.step[last]:  # the strings share this much: nothing new to recognise
            q = self.step[last][b]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, b, q)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and b not in self.step[p]:
            self.step[p][b] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][b]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, b, q)
        return new

    def ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, id) of the tokens that are suffixes of the state's longest string, longest first."""
        found = self._ends.get(state)
        if found is None:
            found = tuple(sorted(self.own.get(state, ()), reverse=True)) + self.ends(self.link[state])
            self._ends[state] = found
        return found


class Recent:
    """A mapping of what was used lately: entries not used for a whole generation are forgotten."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not held; those that are get young again."""
        if len(self.new) > CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out


class Encoder:
    """A vocabulary file with its automaton and merge tables; one per Python worker."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, letters = held["model"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ids = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(PRETOKENS).findall
        # A run of white space that a split at single blanks would tear apart.
        self.torn = re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)").search
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        to_bytes = lambda t: bytes(byte_of[c] for c in t)
        for r, merge in enumerate(model["merges"]):
            a, b = map(to_bytes, merge if isinstance(merge, list) else merge.split(" "))
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[x, y] = (r, z)
            if z not in self.parts:
                self.parts[z], self.made[z] = (x, y), r
        known = [(i, t) for t, i in ids.items() if len(t) == 1 or i in self.parts]
        self.number = [i for i, _ in known]
        self.automaton = SuffixAutomaton([t for _, t in known])
        self.fits: dict[int, bool] = {}
        self.pieces = Recent()  # pre-token -> ids as little-endian unsigned 32-bit integers
        self.later = Recent()  # what follows a blank, up to the next -> ids with that blank
        top = max(self.bytes_of) + 1
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between these two tokens.

        Undo the merges that built the two tokens, the latest first. At every stage the two symbols
        that touch the border are those that BPE saw at that time; had their merge been due before
        the one just undone, BPE would have joined across the border.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIR_ENTRIES:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        never = len(self.rank)
        due, due_on_right = never, False  # the merge just undone, and its side
        while True:
            across = self.rank.get((left, right), (never, 0))[0]
            # At one rank BPE works from left to right: a merge of the right side waits for the border.
            if across < due or across == due < never and due_on_right:
                return False
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                due, due_on_right, left = a, False, self.parts[left][1]
            elif b > a:
                due, due_on_right, right = b, True, self.parts[right][0]
            else:  # equal tokens' merges: the right one comes last
                due, due_on_right, right = b, True, self.parts[right][0]

    def encode_all(self, words: list[str]) -> None:
        """Put the ids of these pre-tokens into self.pieces."""
        step, link, length, ends = self.automaton.step, self.automaton.link, self.automaton.length, self.automaton.ends
        number, fits, compatible = self.number, self.fits, self.compatible
        before, states, last, back = b"", [0], [-1], [0]
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            state, i = states[shared][0] if shared else 0, shared
            held = states[shared][1] if shared else 0  # length of the longest suffix that the automaton knows
            for b in raw[shared:]:
                i += 1
                while b not in step[state]:
                    state = link[state]
                    held = length[state]
                state = step[state][b]
                held += 1
                for n, k in ends(state):
                    if n > held:
                        continue
                    token, j = number[k], i - n
                    if j == 0 or ((ok := fits.get(last[j] << 20 | token)) or ok is None and compatible(last[j], token)):
                        last.append(token)
                        back.append(j)
                        break
                states.append((state, held))
            before = raw
            out, i = [], len(raw)
            while i:
                out.append(last[i])
                i = back[i]
            self.pieces.new[word] = pack(f"<{len(out)}I", *out[::-1])

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk of text, cut into pre-tokens; new pre-tokens are encoded together."""
        cut = {c: self.find(c) for c in chunks}
        if new := self.pieces.missing({w for ws in cut.values() for w in ws}):
            self.encode_all(new)
        pieces = self.pieces.new
        return {c: b"".join([pieces[w] for w in ws]) for c, ws in cut.items()}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        plain: list[list[tuple[bool, str]]] = []  # per text: (is a special token, string)
        for t in texts:
            if self.cut and any(s in t for s in self.special):
                plain.append([(s in self.special, s) for s in self.cut.split(t) if s])
            else:
                plain.append([(False, t)] if t else [])
        runs = []
        new_first, new_later = set(), set()
        for parts in plain:
            run = []
            for is_special, s in parts:
                if is_special:
                    run.append((s, None))
                elif self.torn(s):
                    run.append((None, s))
                    new_first.add(s)
                else:
                    head, *rest = s.split(" ")
                    run.append((head, rest))
                    new_first.add(head)
                    new_later.update(rest)
            runs.append(run)
        missing = self.later.missing(new_later)
        known = self.learn([*new_first, *(" " + c for c in missing)])
        self.later.new.update((c, known[" " + c]) for c in missing)
        later, out = self.later.new.__getitem__, []
        for run in runs:
            ids = []
            for a, b in run:
                if a is None:
                    ids.append(known[b])
                elif b is None:
                    ids.append(self.special[a].to_bytes(4, "little"))
                else:
                    ids.append(known[a])
                    ids.extend(map(later, b))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The bytes of the ids, read as UTF-8 (what is not UTF-8 becomes U+FFFD)."""
        held = np.frombuffer(ids, "<u4")
        sizes = self.sizes[held]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[held] - ends + sizes, sizes)
        return self.flat[at].tobytes().decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    return kept(f"bpe {path}", lambda: Encoder(path))


def _slices(texts: Iterable[str], chars: int = 500_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_column(docs: DataFrame, vocabulary: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with n_tokens and either ids and decoded, or the SHA-256 of both. A narrow map: no shuffle."""

    names = [c.split()[0] for c in (DIGESTS if digests else SCHEMA).split(", ")]

    @F.pandas_udf(DIGESTS if digests else SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            # Results leave slice by slice, so that a worker holds few of them at a time.
            for texts in _slices(t or "" for t in batch):
                n, x, y = [], [], []
                for ids in e.encode_batch(texts):
                    back = e.decode(ids)
                    n.append(len(ids) // 4)
                    x.append(sha(ids) if digests else ids)
                    y.append(sha(back.encode()) if digests else back)
                yield pd.DataFrame(dict(zip(names, (n, x, y), strict=True)))

    held = spare_name(docs, "bpe")
    out = docs.withColumn(held, run(F.col(text)))
    for c in names:
        out = out.withColumn(spare_name(docs, c), F.col(f"{held}.{c}"))
    return out.drop(held)
