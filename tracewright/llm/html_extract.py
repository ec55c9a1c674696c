"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: text between block-level tags, each with the path of open elements and
what their tags, classes, ids and roles say. A bidirectional LSTM in numpy reads the page's sequence of
blocks (hashed path, hashed words, a few shapes) and labels every block as article text or not, with the
whole page as context. It is trained on generated pages of many layouts, whose blocks are known; the
same seed gives the same weights in every run.

Scripts, styles, comments and what a browser wouldn't show are never blocks. Text is decoded (character
references), white space inside a block becomes one space, and the blocks kept are joined by line feeds
in the order of the page.

Defined cases: a null or empty page, or one without kept blocks, gives the empty text; unclosed and
misnested tags are closed by what encloses them; a tag or comment that never ends runs to the end of the
page; repeated rows get equal results; other columns pass through, and a result column whose name is
taken gets underscores before it. Pages are read whole; nothing is dropped or capped for length.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare_name

PATH_WIDTH, WORD_WIDTH, SHAPE_WIDTH = 96, 24, 8
INPUT = PATH_WIDTH + WORD_WIDTH + SHAPE_WIDTH
HIDDEN = 16
TRAIN_PAGES, EPOCHS, BATCH, SEED = 480, 8, 24, 20240501
#: Blocks in one forward pass, at most, beyond a single page's own.
FORWARD_BLOCKS = 20_000

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li link main menu meta nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN_TAGS = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "select", "textarea", "button")
RAW_TAGS = frozenset("script style textarea title iframe noscript xmp".split())
#: A start tag that ends open elements of these names, up to the nearest of the second.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK_TAGS - {"button", "label", "option", "optgroup", "legend", "caption"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPLIT_MARK = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("path", "text", "linked", "inside")

    def __init__(self, path: tuple[int, tuple[str, ...]], text: str, linked: int, inside: bool):
        self.path, self.text, self.linked, self.inside = path, text, linked, inside


@functools.lru_cache(maxsize=50_000)
def marks_of(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """(what the element says about itself, whether it is hidden)."""
    out, hidden = [tag], tag in HIDDEN_TAGS
    for name, value in MARKS.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            out += [f".{w}" for w in SPLIT_MARK.split(value) if w]
    return tuple(out), hidden


def blocks_of(page: str | None) -> list[Block]:
    """The page's leaf blocks of text, in order."""
    page = page or ""
    out: list[Block] = []
    # Open elements: tag, marks, hidden here or above.
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    # The path: the marks of all open elements but unmarked inline ones, how many fall on each place, and the places taken.
    marks_open: list[str] = []
    on_place = [0] * PATH_WIDTH
    taken = 0
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text and not (stack and stack[-1][2]):
                out.append(Block((taken, tuple(marks_open[-2:])), text, linked, bool(open_tags["article"] or open_tags["main"])))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][2]):
            parts.append(raw)
            if open_tags["a"]:
                linked += len(raw)

    def on_path(tag: str, marks: tuple[str, ...]) -> bool:
        return tag in BLOCK_TAGS or len(marks) > 1

    def pop_to(k: int) -> None:
        nonlocal taken
        open_tags.subtract(s[0] for s in stack[k:])
        for tag, marks, _ in stack[k:]:
            if on_path(tag, marks):
                del marks_open[len(marks_open) - len(marks) :]
                for m in marks:
                    on_place[place_of(m)] -= 1
                    if not on_place[place_of(m)]:
                        taken &= ~(1 << place_of(m))
        del stack[k:]

    def last(name: str) -> int:
        """Place of the innermost open element of this name, -1 if there is none."""
        if not open_tags[name]:
            return -1
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)

    at, size = 0, len(page)
    search = TOKEN.search
    while at < size:
        m = search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if m[1]:
            k = last(tag)
            if block or tag == "br":
                flush() if block else parts.append(" ")
            # An end tag of an inline element doesn't close blocks around it.
            if k >= 0 and (block or not any(s[0] in BLOCK_TAGS for s in stack[k + 1 :])):
                pop_to(k)
            continue
        if tag == "br":
            add(" ")
            continue
        if block:
            flush()
            if tag in ENDS_P:
                k = last("p")
                if k >= 0 and not any(s[0] in ("td", "th", "button", "object") for s in stack[k + 1 :]):
                    pop_to(k)
            if tag in CLOSES:
                ends, limit = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in limit:
                        break
                    if stack[i][0] in ends:
                        pop_to(i)
        if tag in VOID or m[3].endswith("/") and not block:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        marks, hidden = marks_of(tag, m[3])
        if tag == "body" and open_tags["head"]:  # its end is missing
            pop_to(last("head"))
        stack.append((tag, marks, hidden or bool(stack and stack[-1][2])))
        open_tags[tag] += 1
        if on_path(tag, marks):
            marks_open += marks
            for mark in marks:
                on_place[place_of(mark)] += 1
                taken |= 1 << place_of(mark)
    flush()
    return out


def crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace"))


@functools.lru_cache(maxsize=50_000)
def place_of(mark: str) -> int:
    return crc(mark) % PATH_WIDTH


@functools.lru_cache(maxsize=20_000)
def path_vector(taken: int, leaf: tuple[str, ...]) -> np.ndarray:
    out = np.array([taken >> k & 1 for k in range(PATH_WIDTH)], np.float32)
    for mark in leaf:
        out[place_of(f"leaf {mark}")] = 1
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: hashed path, hashed words, shape."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    for i, b in enumerate(blocks):
        out[i, :PATH_WIDTH] = path_vector(*b.path)
        words = b.text.split()
        n, chars = len(words), len(b.text)
        # Every word counts; the sum is scaled so that long and short blocks weigh alike.
        places = np.fromiter((crc(w.lower()) % WORD_WIDTH for w in words), np.int64, n)
        out[i, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = np.bincount(places, minlength=WORD_WIDTH) / n
        s = out[i, PATH_WIDTH + WORD_WIDTH :]
        s[0] = np.log1p(n) / 4
        s[1] = np.log1p(chars) / 6
        s[2] = min(1.0, b.linked / chars)
        s[3] = b.text[-1] in ".!?:;…\"'»”)"
        s[4] = (i + 1) / len(blocks)
        s[5] = b.text.count(",") / n
        s[6] = "©" in b.text
        s[7] = b.inside
    return out


class Labeller:
    """A bidirectional LSTM over the blocks of a page, and a logistic label for each block."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {}
        for d in ("fore", "back"):
            self.w[f"{d}_x"], self.w[f"{d}_h"] = draw(INPUT, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember, to begin with
            self.w[f"{d}_b"] = bias
        self.w["out"], self.w["out_b"] = draw(2 * HIDDEN, 1), np.zeros(1, np.float32)

    @staticmethod
    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) of one direction; x is (T, B, INPUT), mask (T, B)."""
        t_most, b = mask.shape
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        pre = (x.reshape(-1, INPUT) @ self.w[f"{d}_x"]).reshape(t_most, b, -1) + self.w[f"{d}_b"]
        out, tape = np.zeros((t_most, b, HIDDEN), np.float32), []
        for t in range(t_most) if d == "fore" else range(t_most - 1, -1, -1):
            g = pre[t] + h @ self.w[f"{d}_h"]
            gates = self.sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            z = np.tanh(g[:, 3 * HIDDEN :])
            new_c = f * c + i * z
            tc = np.tanh(new_c)
            m = mask[t][:, None]
            if keep:
                tape.append((t, h, c, i, f, o, z, tc, m))
            c = np.where(m, new_c, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, d, False)[0] for d in ("fore", "back")], axis=2)
        return (both @ self.w["out"])[..., 0] + self.w["out_b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self.run(x, mask, d, True) for d in ("fore", "back")}
        both = np.concatenate([runs["fore"][0], runs["back"][0]], axis=2)
        p = self.sigmoid((both @ self.w["out"])[..., 0] + self.w["out_b"])
        dz = (p - y) * mask / max(1, mask.sum())
        grad = {"out": (both * dz[..., None]).reshape(-1, 2 * HIDDEN).sum(axis=0)[:, None], "out_b": np.array([dz.sum()], np.float32)}
        spread = dz[..., None] * self.w["out"][:, 0]
        for k, d in enumerate(("fore", "back")):
            wh = self.w[f"{d}_h"]
            dh_all = spread[..., k * HIDDEN : (k + 1) * HIDDEN]
            dpre = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = np.zeros(dh_all.shape[1:], np.float32), np.zeros(dh_all.shape[1:], np.float32)
            for t, h, c, i, f, o, z, tc, m in reversed(runs[d][1]):
                dh = dh + dh_all[t]
                own_h, own_c = dh * m, dc * m
                own_c = own_c + own_h * o * (1 - tc * tc)
                dg = np.concatenate([own_c * z * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - z * z)], axis=1)
                dpre[t] = dg
                gh += h.T @ dg
                dh = dg @ wh.T + dh * ~m
                dc = own_c * f + dc * ~m
            grad[f"{d}_x"] = x.reshape(-1, INPUT).T @ dpre.reshape(-1, 4 * HIDDEN)
            grad[f"{d}_h"], grad[f"{d}_b"] = gh, dpre.reshape(-1, 4 * HIDDEN).sum(axis=0)
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, pages))
    x, mask = np.zeros((most, len(pages), INPUT), np.float32), np.zeros((most, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# Generated pages. What a block is stands in a marker that is taken off before training.
SYLLABLES = "ba be bi co da de el en er fa ga he in is ka la le lo ma mi mo na ne no o pa pe ra re ri ro sa se si ta te ti to un ve vi wa".split()
NOISE_NAMES = {
    "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs tabs pagination", "head": "header masthead banner site-header top logo tagline",
    "foot": "footer site-footer copyright bottom colophon legal", "side": "sidebar aside widget related recommended more-stories trending popular tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner-ad adsbygoogle", "note": "cookie cookie-notice consent notice alert gdpr popup modal paywall subscribe newsletter",
    "talk": "comments comment discussion replies responses comment-list reader-comments disqus", "share": "share social social-share follow byline-tools toolbar", "form": "form search search-form login signup contact",
}
NOISE_TAGS = {"nav": ("nav", "div", "ul"), "head": ("header", "div"), "foot": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "note": ("div", "section", "aside", "dialog"), "talk": ("section", "div", "ol"), "share": ("div", "ul"), "form": ("form", "div")}
BODY_NAMES = "content article post entry article-body post-content entry-content main story body-text text page-content".split()
YES, NO = "\ue000", "\ue001"


def invented_page(r: random.Random) -> str:
    """A page of some layout; each block's text begins with the marker of its label.

    Some pages name nothing: there only tags, links, words and the order of blocks tell what is what. Some wrap
    everything in plain containers, some lay the page out as a table.
    """
    bare, layout = r.random() < 0.25, r.random()
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def say(n: int) -> str:
        ws = [word() + ("," if r.random() < 0.08 else "") for _ in range(n)]
        return " ".join(ws).capitalize() + r.choice((".", ".", ".", "!", "?", ""))

    def prose(mark: str) -> str:
        text = mark + " ".join(say(r.randint(3, 25)) for _ in range(r.choice((1, 1, 2, 3, 5))))
        if r.random() < 0.2:
            text += f' <a href="/{word()}">{word()}</a> ' + say(r.randint(2, 8))
        return text

    def noise(kind: str) -> str:
        tag = r.choice(NOISE_TAGS[kind])
        name = r.choice(NOISE_NAMES[kind].split())
        attribute = r.choice((f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name}"', ""))
        if r.random() < 0.15:
            attribute = r.choice((f' class="{name}-{word()}"', f' class="{word()}-{name}"', f' id="{word()}_{name}"'))
        if attribute == "" and tag in ("div", "section", "ul", "ol"):
            attribute = f' class="{name}"'
        if bare:
            attribute = ""
        if kind in ("nav", "share") or kind == "side" and r.random() < 0.6 or kind == "foot" and r.random() < 0.3:
            items = "".join(f'<li><a href="/{word()}">{NO}{word()}</a></li>' for _ in range(r.randint(2, 9)))
            inner = items if tag in ("ul", "ol") else r.choice((f"<ul>{items}</ul>", f"<h3>{NO}{say(2)}</h3><ul>{items}</ul>"))
        elif kind == "talk":
            inner = f"<h3>{NO}{say(2)}</h3>" + "".join(f'<div class="comment"><span>{NO}{word()}</span><p>{prose(NO)}</p></div>' for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f'<label>{NO}{word()}</label><input name="q"><p>{NO}{say(4)}</p>'
        elif kind == "foot":
            inner = r.choice((f"{NO}&copy; {word()} &middot; {say(4)}", f"<p>{NO}&copy; 2024 {say(3)}</p><p>{NO}{say(6)}</p>"))
        else:
            inner = r.choice((f"{NO}{say(r.randint(2, 14))}", f"<p>{prose(NO)}</p>", f"<h4>{NO}{say(3)}</h4><p>{prose(NO)}</p>"))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def body() -> str:
        out = [f"<h1>{YES}{say(r.randint(2, 10))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice((1, 2, 4, 8, 14, 25))):
            k = r.random()
            if k < 0.72:
                out.append(f"<p>{prose(YES)}" + r.choice(("</p>", "</p>", "</p>", "")))
            elif k < 0.8:
                out.append(f"<h2>{YES}{say(r.randint(1, 6))}</h2>")
            elif k < 0.87:
                items = "".join(f"<li>{YES}{say(r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5)))
                out.append(f"<ul>{items}</ul>")
            elif k < 0.91:
                out.append(f"<blockquote><p>{prose(YES)}</p></blockquote>")
            elif k < 0.94:
                out.append(f"<table><tr><td>{YES}{word()}</td><td>{YES}{word()}</td></tr></table>")
            elif k < 0.96:
                out.append(f"<figure><img src='a.png'><figcaption>{YES}{say(5)}</figcaption></figure>")
            else:
                out.append(noise(r.choice(("ad", "side", "share", "note", "form"))))
        tag = r.choice(("article", "article", "main", "div", "section"))
        name = r.choice(BODY_NAMES)
        open_tag = f"<{tag}>" if bare or tag in ("article", "main") and r.random() < 0.6 else f'<{tag} class="{name}">'
        text = f"{open_tag}{''.join(out)}</{tag}>"
        return r.choice((text, text, f"<main>{text}</main>", f'<div class="container">{text}</div>', f'<div id="wrapper"><div class="row">{text}</div></div>'))

    before = [noise(k) for k in ("note", "head", "nav", "ad", "form", "side") if r.random() < 0.5]
    after = [noise(k) for k in ("share", "talk", "ad", "side", "nav", "note", "foot", "form") if r.random() < 0.45]
    r.shuffle(before)
    wrapped = lambda x: "<div>" * (n := r.randint(1, 4)) + x + "</div>" * n
    if layout < 0.1:
        links = "<br>".join(f'<a href="/{word()}">{NO}{word()}</a>' for _ in range(r.randint(2, 6)))
        last = f'<tr><td><small>{NO}{say(r.randint(2, 6))} <a href="/{word()}">{word()}</a></small></td></tr>' if r.random() < 0.5 else ""
        whole = f"<table><tr><td>{links}</td><td>{body()}</td></tr>{last}</table>"
    elif layout < 0.3:
        whole = wrapped("".join(map(wrapped, [*before, body(), *after])))
    else:
        whole = "".join([*before, body(), *after])
    return f"<html><head><title>{word()}</title></head><body>{whole}</body></html>"


def train(seed: int = SEED, pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """Fit the labeller to generated pages with Adam; deterministic."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        blocks, truth = [], []
        for b in blocks_of(invented_page(r)):
            truth.append(YES in b.text)
            b.text = b.text.replace(YES, "").replace(NO, "") or "."
            blocks.append(b)
        if blocks:
            data.append((vectors(blocks), np.array(truth, np.float32)))
    model = Labeller(rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        order = sorted(order.tolist(), key=lambda k: len(data[k][0]) // 8)  # pages of like length together
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        rng.shuffle(batches)
        for batch in batches:
            x, mask = padded([data[k][0] for k in batch])
            # Now and then a mark or a word is missing, so that no single one is relied on.
            x = x * (rng.random((1, x.shape[1], INPUT)) > 0.12)
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(batch):
                y[: len(data[k][1]), j] = data[k][1]
            step += 1
            for name, g in model.gradients(x.astype(np.float32), mask, y).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                rate = 0.02 * (0.5 if epoch >= epochs - 2 else 1)
                model.w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which blocks are article text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(pages[order[j]]) <= FORWARD_BLOCKS:
            j += 1
        x, mask = padded([vectors(pages[k]) for k in order[i:j]])
        s = model.scores(x, mask) > 0
        for n, k in enumerate(order[i:j]):
            out[k] = s[: len(pages[k]), n]
        i = j
    return out


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, yes in zip(bs, keep, strict=True) if yes) for bs, keep in zip(cut, label(model, cut), strict=True)]


def extract_column(pages: DataFrame, model: Labeller | None = None, html: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars. A narrow map; the weights (60 kB) are broadcast."""
    held = pages.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("text string, n_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts: list[str] = []
            for lo in range(0, len(batch), 500):
                texts += main_texts(held.value, list(batch.iloc[lo : lo + 500]))
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    rest = pages.drop(html)
    name = spare_name(pages, "extracted")
    out = pages.withColumn(name, run(F.col(html))).drop(html)
    for c in ("text", "n_chars"):
        out = out.withColumn(spare_name(rest, c), F.col(f"{name}.{c}"))
    return out.drop(name)
