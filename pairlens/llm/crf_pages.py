"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import add_columns, table

#: Fixed sets of HTML: elements without an end tag, elements that stay in a line, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head template noscript svg iframe object select textarea button".split())
#: Elements that may stand in a head, which any other element ends; elements that can't stand in a control, which they end.
IN_HEAD = frozenset("title script style meta link base template noscript".split())
NOT_IN_CONTROL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table section article main nav aside header footer blockquote pre figure".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|xmp|title)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*+)>|<[!?/]?[a-zA-Z][^<>]*\Z""", re.S | re.I)
_NAMED = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def leaf_blocks(page: str | None) -> list[tuple[str, list[str], str | None]]:
    """Leaf blocks in page order: text (references decoded, white space as single blanks, trimmed, never empty), features, label.

    A block ends where any element that isn't inline starts or ends; a tag that the page's end cuts off is no text. A head without
    an end tag ends where an element starts that can't stand in it, an open select or button where a block of text starts.
    Quotes hold a tag's end only where they begin an attribute's value. The label is ``data-y`` of the nearest ancestor (training).
    """
    out: list[tuple[str, list[str], str | None]] = []
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    text: list[str] = []
    linked, hidden = 0, 0

    def close() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, features(whole, stack, linked), next((s[2] for s in reversed(stack) if s[2] is not None), None)))
        text, linked = [], 0

    def pop(to: int) -> None:
        nonlocal hidden
        while len(stack) > to:
            hidden -= stack.pop()[0] in NO_TEXT

    def put(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text.append(raw)
            if any(s[0] == "a" for s in stack[-4:]):
                linked += len(raw)

    page, at = page or "", 0
    for m in _PIECE.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if hidden and not m[2]:
            at_hidden = max(i for i, s in enumerate(stack) if s[0] in NO_TEXT)
            if stack[at_hidden][0] == "head" and tag not in IN_HEAD or stack[at_hidden][0] in ("select", "button") and tag in NOT_IN_CONTROL:
                pop(at_hidden)
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif not inline:
                close()
        elif m[2]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if not inline:
                close()
            if depth is not None:
                pop(depth)
        else:
            if not inline:
                close()
                shut = CLOSED_BY.get(tag, ())
                for i in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                    if stack[i][0] == "p" or stack[i][0] in shut:
                        pop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            names, label = [], None
            if "=" in (m[4] or ""):
                for a in _NAMED.finditer(m[4]):
                    value = (a[2] or a[3] or a[4] or "").lower()
                    if a[1].lower() == "data-y":
                        label = value
                    else:
                        names += [f"name={w}" for w in _WORD.findall(value)]
            if not m[4].rstrip().endswith("/") or inline or tag in ("p", "div", "article", "section"):
                stack.append((tag, tuple(names), label))
                hidden += tag in NO_TEXT
    put(page[at:])
    close()
    return out


def features(text: str, stack: list[tuple[str, tuple[str, ...], str | None]], linked: int) -> list[str]:
    found = {"bias"}
    for tag, names, _ in stack:
        if tag not in INLINE:
            found.add(f"in={tag}")
        found.update(names)
    n = text.count(" ") + 1
    found.add(f"words={min(7, n.bit_length())}")
    found.add(f"linked={min(4, 4 * linked // max(1, len(text)))}")
    found.add(f"ends={text[-1] in '.!?…:;'}")
    if "©" in text:
        found.add("mark")
    return list(found)


class Crf:
    """Two labels (0 other, 1 article) in a chain: emission weights by feature, transition weights between neighbours."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def scores(self, blocks: list[list[str]]) -> list[tuple[float, float]]:
        get = self.weights.get
        return [tuple(map(sum, zip(*[w for w in map(get, b) if w]))) or (0.0, 0.0) for b in blocks]

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """Viterbi; ties go to 0."""
        back, now, m = [], (0.0, 0.0), self.moves
        for k, (s0, s1) in enumerate(self.scores(blocks)):
            if k:
                x0, x1 = now[1] + m[1][0] > now[0] + m[0][0], now[1] + m[1][1] > now[0] + m[0][1]
                back.append((x0, x1))
                s0 += now[1] + m[1][0] if x0 else now[0] + m[0][0]
                s1 += now[1] + m[1][1] if x1 else now[0] + m[0][1]
            now = (s0, s1)
        out = [int(now[1] > now[0])]
        for x in reversed(back):
            out.append(int(x[out[-1]]))
        return out[::-1]


def fit(pages: list[str], passes: int = 14, rate: float = 0.5, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by AdaGrad over pages in order; gradients come from forward-backward sums."""
    sets = [[(f, int(y or 0)) for _, f, y in leaf_blocks(p)] for p in pages]
    names = sorted({x for s in sets for f, _ in s for x in f})
    at = {x: i for i, x in enumerate(names)}
    w, m = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    for _ in range(passes):
        for s in sets:
            if not s:
                continue
            rows = [[at[x] for x in f] for f, _ in s]
            y = [v for _, v in s]
            e = np.array([w[r].sum(axis=0) for r in rows])
            n = len(s)
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            a[0] = e[0]
            for i in range(1, n):
                a[i] = e[i] + np.logaddexp(a[i - 1][0] + m[0], a[i - 1][1] + m[1])
            for i in range(n - 2, -1, -1):
                t = m + e[i + 1] + b[i + 1]
                b[i] = np.logaddexp(t[:, 0], t[:, 1])
            z = np.logaddexp(a[-1, 0], a[-1, 1])
            p = np.exp(a + b - z)
            d_w, d_m = decay * w, decay * m
            for i, r in enumerate(rows):
                d = p[i].copy()
                d[y[i]] -= 1
                d_w[r] += d
            for i in range(1, n):
                d_m += np.exp(a[i - 1][:, None] + m + e[i] + b[i] - z)
                d_m[y[i - 1], y[i]] -= 1
            gw += d_w**2
            gm += d_m**2
            w -= rate * d_w / np.sqrt(gw)
            m -= rate * d_m / np.sqrt(gm)
    return Crf({x: (float(w[i, 0]), float(w[i, 1])) for x, i in at.items()}, m.tolist())


def labelled_pages(n: int = 200, seed: int = 5) -> list[str]:
    """Training pages of many layouts with ``data-y`` on every part: 1 for the article, 0 for what stands around and inside it."""
    rng = random.Random(seed)
    letters = "etaoinshrdlu"

    def words(a: int, b: int) -> list[str]:
        return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b))]

    def sentence(a: int = 1, b: int = 60) -> str:
        between = rng.choice([" "] * 7 + [" | ", "### ", "&amp;&amp; ", " *** "])
        return between.join(words(a, b)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def links(a: int = 1, b: int = 8) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{" ".join(words(1, 3))}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"

    def off(tag: str, names: list[str], inner: str) -> str:
        attribute = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if names and rng.random() < 0.95 else ""
        return f'<{tag}{attribute} data-y="0">{inner}</{tag}>'

    def some() -> str:
        return rng.choice([links(), f"<p>{sentence()}</p>", sentence(1, 25), f"<h3>{sentence(1, 4)}</h3>{links()}", f"<p>{sentence()}</p><p>{sentence()}</p>"])

    def around() -> list[str]:
        return [
            off("nav", ["menu", "nav main", "navbar", ""], links(1, 12)), off("div", ["menu", "navigation", "nav", "breadcrumb", "topbar", "toc"], some()),
            off("header", ["site", "header", "masthead", "top"], rng.choice([sentence(1, 6), f"<h1>{sentence(1, 6)}</h1>", links()])),
            off("div", ["header", "masthead", "banner"], some()), off("aside", ["sidebar", "related", ""], some()),
            off("div", ["sidebar", "widget", "related", "share social", "recommended", "promo", "popular", "trending"], some()),
            off("div", ["ad", "ads", "advert", "advertisement", "sponsored", "ad banner", "sponsor"], some()), off("section", ["ad", "promo", "related", "newsletter"], some()),
            off("div", ["cookie", "notice", "consent", "cookie notice", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "paywall", "disclaimer"], some()),
            off("form", ["search", "login", "subscribe", ""], f"<label>{sentence(1, 5)}</label><p>{sentence(1, 12)}</p><input>"),
        ]

    def comments() -> str:
        inner = "".join(f'<div class="{rng.choice(["comment", "reply", "c"])}"><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 5)))
        return off(rng.choice(["section", "div", "ol", "aside"]), ["comments", "comment list", "discussion", "responses", "replies", "reader comments"], inner)

    def footer() -> str:
        return off(rng.choice(["footer", "footer", "div"]), ["footer", "bottom", "copyright", "legal"], rng.choice([f"&copy; {sentence(1, 20)}", links(), f"<p>&copy; {sentence(1, 9)}</p>{links()}"]))

    def body() -> str:
        parts = [f"<h1>{sentence(1, 9)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(0, 14)):
            x = rng.random()
            if x < 0.6:
                parts.append(f"<p>{sentence(1, rng.choice([2, 8, 40, 200]))}" + rng.choice(["</p>", "</p>", ""]))
            elif x < 0.66:
                parts.append(f"<h2>{sentence(1, 6)}</h2>")
            elif x < 0.72:
                parts.append("<ul>" + "".join(f"<li>{sentence(1, 12)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif x < 0.76:
                parts.append(f"<blockquote>{sentence()}</blockquote>")
            elif x < 0.8:
                parts.append(f'<p><a href="/y">{sentence(1, 9)}</a></p>')
            elif x < 0.84:
                parts.append(f"<p><b>{sentence(1, 9)}<br>{sentence(1, 9)}")
            elif x < 0.88:
                parts.append(f"<table><tr><td>{sentence(1, 4)}</td><td>{sentence(1, 4)}</td></tr></table>")
            elif x < 0.91:
                parts.append(f"<pre>{sentence(1, 12)}</pre>")
            else:
                parts.append(rng.choice(around()))
        tag, name = rng.choice([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "entry content"), ("div", "article"), ("section", "story"), ("div", "main text")])
        named = f' class="{name}"' if name else ""
        inner = f'<{tag}{named} data-y="1">' + "".join(parts) + (comments() if rng.random() < 0.15 else "") + f"</{tag}>"
        return f"<main>{inner}</main>" if rng.random() < 0.2 and tag != "main" else inner

    out = []
    for _ in range(n):
        before = rng.sample(around(), rng.randint(0, 5))
        after = [*rng.sample(around(), rng.randint(0, 4)), *([comments()] if rng.random() < 0.5 else []), *([footer()] if rng.random() < 0.9 else [])]
        page = f"<html><head><title>{sentence(1, 9)}</title></head><body>{''.join(before)}{body()}{''.join(after)}</body></html>"
        out.append(f'<div class="wrapper">{page}</div>' if rng.random() < 0.1 else page)
    return out


def extract(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return " ".join(b[0] for b, y in zip(blocks, model.decode([b[1] for b in blocks])) if y)


def main_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page.

    Null and empty pages, and pages without an article, have an empty text. Nothing is cut: a page's every block is labelled.
    Malformed markup is read as far as it goes; repeated rows come out repeated. Other columns are ignored. Without a model, one is
    fitted to ``labelled_pages()``, a fixed set of 200.
    """
    model = model or fit(labelled_pages())

    def run(pages: list) -> tuple[pa.Array, pa.Array]:
        texts = [extract(p, model) for p in pages]
        return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return add_columns(rows, "html", run, "text string, n_chars long").select("page_id", "url", "text", "n_chars")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
