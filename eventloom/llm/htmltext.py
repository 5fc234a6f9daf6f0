"""Main-text extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks (runs of text between block-level tags). Each block is a vector
of its hashed tag path (tag names, class and id words of its ancestors), hashed words, and a few shape
figures. A bidirectional LSTM in numpy reads the whole page's sequence and labels every block as main text or not, so
a block's label depends on all of its page. It is trained here, by back-propagation through time, on
pages built from randomly drawn site templates whose labels are known, and on at most SAMPLE pages (of
SAMPLE_BYTES together) that mark their article by an element; for a share of those the mark is hidden. These
pages are drawn by a hash from the whole table: ids and lengths of a few candidates reach the driver, then
the drawn pages alone. A long page is learnt in stretches of STRETCH blocks, none of which is left out.

Defined cases: null or empty html gives an empty text; unclosed tags, comments and quotes are read to
their likely end; scripts, styles, titles and other invisible text are no blocks; repeated rows give equal results;
an empty table gives no rows; extra columns are ignored. Nothing of a main block is dropped or cut.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batch, map_rows, read

PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 128, 64, 8, 24
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM
SAMPLE, SAMPLE_BYTES, SYNTHETIC, EPOCHS = 200, 8 << 20, 360, 8
BATCH_PAGES = 64
STRETCH = 400

#: HTML element names.
BLOCKS = frozenset("html body div p article section header footer nav aside main ul ol li h1 h2 h3 h4 h5 h6 table thead tbody tr td th blockquote pre form fieldset figure figcaption dl dt dd hr address details summary dialog label legend".split())
UNSEEN = "script|style|noscript|template|title|textarea|select|svg|iframe|object|canvas"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({UNSEEN})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; path: (tag, class and id words) from the root."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, page = 0, 0, 0, page or ""

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text))))
        parts, linked = [], 0

    def say(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            linked += len(raw) if in_link else 0

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            parts.append("" if m[0].startswith("<!") or not parts else " ")
            continue
        name, closing, attrs = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append("\n")
        elif name in BLOCKS:
            flush()
            in_link = 0
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                if stack and stack[-1][0] in _IMPLIED.get(name, ()):
                    stack.pop()
                elif name in BLOCKS and stack and stack[-1][0] == "p" and name != "p":
                    stack.pop()  # a block-level tag ends an open paragraph
                words = tuple(w for n in _NAMES.findall(attrs) for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(n)).lower()) if w)
                if name != "hr":
                    stack.append((name, words))
    say(page[at:])
    flush()
    return out


@lru_cache(1 << 16)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if h >> 16 & 1 else -1.0


@lru_cache(1 << 14)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for tag, words in path:
        for w in (f"<{tag}>", *words):
            i, s = _slot(w, PATH_DIM)
            v[i] += s
    if path:
        i, s = _slot(f"leaf {path[-1][0]}", PATH_DIM)
        v[i] += s
    return v


def vectors(page: list[Block]) -> np.ndarray:
    """A row per block."""
    x = np.zeros((len(page), INPUT), np.float32)
    for k, b in enumerate(page):
        x[k, :PATH_DIM] = _path_vector(b.path)
        words = b.text.lower().split(" ")
        codes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % WORD_DIM
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(codes, minlength=WORD_DIM) / np.sqrt(len(words))
        n = len(b.text)
        x[k, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, b.linked / n, sum(map(b.text.count, ".,;:!?")) * 10 / n, b.text[-1] in ".!?", k / len(page), 1 - k / len(page), "©" in b.text or "(c)" in b.text)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLstm:
    """Forward and backward LSTMs over a page's blocks and a logistic output; float32 numpy."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        u = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"w{d}": u(INPUT, 4 * HIDDEN), f"u{d}": u(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.p |= {"o": u(2 * HIDDEN, 1)[:, 0], "a": np.zeros(1, np.float32)}

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        """x: time, page, input; mask: time, page. Padded steps leave the state as it is."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        z_all = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_all[t] + h @ self.p[f"u{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        f = self._direction("f", x, mask, None if keep is None else keep.setdefault("f", []))
        b = self._direction("b", x, mask, None if keep is None else keep.setdefault("b", []))
        both = np.concatenate([f, b], axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["o"] + self.p["a"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        e = np.where(mask, _sigmoid(self.logits(x, mask, keep)) - y, 0).astype(np.float32) / mask.sum()
        g = {"o": np.einsum("tp,tph->h", e, keep["both"]), "a": np.array([e.sum()], np.float32)}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(keep[d]):
                dh = dh + e[t][:, None] * self.p["o"][part]
                live = np.where(m, dh, 0)
                dct = np.where(m, dc + live * o * (1 - tc * tc), 0)
                dz = np.concatenate([dct * gg * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                du += h.T @ dz
                dh = np.where(m, dz @ self.p[f"u{d}"].T, dh)
                dc = np.where(m, dct * f, dc)
            g |= {f"w{d}": np.einsum("tpi,tpz->iz", x, dz_all, optimize=True), f"u{d}": du, f"c{d}": dz_all.sum(axis=(0, 1))}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 0) -> "BiLstm":
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]) // 8)
            groups = [order[i : i + 24] for i in range(0, len(order), 24)]
            for k in rng.permutation(len(groups)):
                x, mask = _padded([pages[i][0] for i in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(groups[k]):
                    y[: len(pages[i][1]), j] = pages[i][1]
                t += 1
                for name, g in self.gradients(x, mask, y).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= rate * (1 - epoch / (epochs + 1)) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-7)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = order[at : at + BATCH_PAGES]
            while len(group) > 1 and len(pages[group[-1]]) * len(group) > 20_000:  # long pages go in smaller groups
                group = group[: len(group) // 2]
            x, mask = _padded([vectors(pages[i]) for i in group])
            z = self.logits(x, mask)
            for j, i in enumerate(group):
                out[i] = z[: len(pages[i]), j] > 0
            at += len(group)
        return out


def _padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(x) for x in xs)
    x, mask = np.zeros((n, len(xs), INPUT), np.float32), np.zeros((n, len(xs)), bool)
    for j, v in enumerate(xs):
        x[: len(v), j], mask[: len(v), j] = v, True
    return x, mask


# Training pages

_SYLLABLES = "an be ca de el fo gi ha in jo ka lu me no or pe qui ra se ta un ve wa xi yo zu th st er".split()
_BOILER = "home about contact login register privacy terms cookies accept subscribe newsletter share reply comments sponsored advertisement related more search menu copyright reserved follow".split()


def synthetic_page(rng: np.random.Generator) -> str:
    """A page of a random site template; main text lies in elements that carry data-main."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(a: int, b: int, boiler: float = 0.0) -> str:
        return " ".join(pick(_BOILER) if chance(boiler) else "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(a, b))))

    def sentence() -> str:
        return words(4, 18).capitalize() + "."

    def para(a: int = 1, b: int = 7) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(a, b))))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 4, 0.3).capitalize()}</a></li>' for _ in range(n)) + "</ul>"

    def box(tag: str, names: str, inner: str) -> str:
        how = pick(["class", "id"])
        return f'<{tag} {how}="{names}">{inner}</{tag}>' if names else f"<{tag}>{inner}</{tag}>"

    nav = lambda: box(pick(["nav", "div", "nav"]), pick(["", "menu", "navbar", "main-nav", "navigation"]), links(int(rng.integers(3, 9))))
    ad = lambda: box("div", pick(["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "ad"]), pick([sentence(), para(1, 3), f"<p>{sentence()}</p>"]))
    header = lambda: box("header", pick(["", "site-header", "masthead"]), f"<div>{words(1, 4)}</div>" + (nav() if chance(0.4) else ""))
    footer = lambda: box(pick(["footer", "footer", "div"]), pick(["footer", "site-footer", "bottom footer"]), pick(["&copy; ", "Copyright ", ""]) + words(2, 12, 0.3) + (links(3) if chance(0.4) else ""))
    aside = lambda: box(pick(["aside", "div"]), pick(["sidebar", "related", "widget sidebar", "recommended"]), f"<h3>{words(1, 3, 0.5)}</h3>" + pick([links(4), f"<p>{para(1, 4)}</p>"]))
    notice = lambda: box("div", pick(["cookie-notice", "cookie banner", "notice", "alert", "gdpr consent", "popup"]), f"<p>{para(1, 3)}</p>" + pick(["", "<button>ok</button>"]))
    form = lambda: "<form>" + f"<label>{words(1, 4, 0.5)}</label><input><button>{words(1, 3, 0.5)}</button><p>{sentence()}</p></form>"
    comments = lambda: box(pick(["section", "div"]), pick(["comments", "comment-list", "reader-comments", "discussion comments"]), f"<h3>{words(1, 3, 0.5)}</h3>" + "".join(box("div", pick(["comment", "comment-body", "reply"]), f"<p>{para(1, 5)}</p>") for _ in range(int(rng.integers(1, 5)))))
    body = []
    for _ in range(int(rng.choice([1, 3, 6, 12, 24]))):
        kind = rng.random()
        body.append(f"<p>{para()}</p>" if kind < 0.7 else f"<p><b>{para(1, 3)}<br>" if kind < 0.8 else f"<h2>{words(2, 7).capitalize()}</h2>" if kind < 0.88 else f"<blockquote>{para(1, 3)}</blockquote>" if kind < 0.94 else "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>")
    inside = [ad, aside, form, notice, lambda: box("div", pick(["share", "social-share"]), links(3))]
    inner = "<h1>" + words(2, 9).capitalize() + "</h1>"
    for b in body:
        inner += (f'<div data-no="1">{pick(inside)()}</div>' if chance(0.04) else "") + b
    if chance(0.15):
        inner += f'<div data-no="1">{comments()}</div>'
    tag, names = pick([("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("section", "story article"), ("article", "post"), ("div", "main-content"), ("div", "article-body")])
    main = f'<{tag} data-main="1"' + (f' class="{names}"' if names else "") + f">{inner}</{tag}>"
    before = [f() for f in (header, nav, notice, ad, aside, form) if chance(0.4)]
    after = [f() for f in (comments, aside, ad, form, notice, footer) if chance(0.45)]
    page = "".join(before) + main + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>"


_DATA = re.compile(r' data-(main|no)="1"')


def _marked(page: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a synthetic page and their labels; the marks are turned into classes to read and then removed."""
    found = blocks(_DATA.sub(r' id="zz\1"', page))
    labels, clean = [], []
    for b in found:
        names = [w for _, ws in b.path for w in ws]
        labels.append("zzmain" in names and "zzno" not in names)
        path = tuple((t, tuple(w for w in ws if w not in ("zzmain", "zzno"))) for t, ws in b.path if "zzno" not in ws)
        clean.append(Block(b.text, path, b.linked))
    return clean, np.array(labels, np.float32)


_OTHER = frozenset("ad ads advert sponsored promo comments comment sidebar related share social cookie notice newsletter banner".split())


def _weak(found: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article by an element, else None."""
    inside = lambda b: any(t in ("article", "main") for t, _ in b.path)
    other = lambda b: any(t in ("nav", "aside", "form", "footer") or _OTHER & set(ws) for t, ws in b.path)
    y = np.array([inside(b) and not other(b) for b in found], np.float32)
    return y if len(y) and 0 < y.sum() else None


def train(sample: list[str], seed: int = 0) -> BiLstm:
    rng = np.random.default_rng(seed)
    pages = []
    for _ in range(SYNTHETIC):
        found, y = _marked(synthetic_page(rng))
        pages.append((vectors(found), y))
    for page in sample:
        found = blocks(page)
        y = _weak(found)
        if y is not None:
            if rng.random() < 0.1:  # hide the mark
                found = [Block(b.text, tuple((("div" if t in ("article", "main") else t), ws) for t, ws in b.path), b.linked) for b in found]
            pages.append((vectors(found), y))
    pages = [(x[i : i + STRETCH], y[i : i + STRETCH]) for x, y in pages for i in range(0, len(x), STRETCH)]
    return BiLstm(seed).fit(pages)


def sample_pages(pages: DataFrame) -> list[str]:
    """At most SAMPLE pages of SAMPLE_BYTES together, in the order of a hash of id and url."""
    drawn = pages.select("page_id", "url", "html").withColumn("draw", F.xxhash64(F.lit("sample"), "page_id", "url")).where("html IS NOT NULL")
    among = drawn.where(F.pmod("draw", F.lit(1 << 20)) < min(1 << 20, (SAMPLE * 4 << 20) // max(1, pages.count())))
    found = among.groupBy("draw").agg(F.max(F.octet_length("html")).alias("size"), F.count("*").alias("n")).orderBy("draw").limit(SAMPLE).collect()
    chosen, size, rows = [], 0, 0
    for r in found:  # of pages that share id and url, each counts
        if rows + r["n"] <= SAMPLE and size + r["size"] * r["n"] <= SAMPLE_BYTES:
            chosen.append(r["draw"])
            size, rows = size + r["size"] * r["n"], rows + r["n"]
    return [r["html"] for r in sorted(drawn.where(F.col("draw").isin(chosen)).select("draw", "html").collect())]


_TEXT = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("blocks", T.IntegerType()),
        T.StructField("main_blocks", T.IntegerType()),
    ]
)


def extract(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, blocks, main_blocks) of pages (page_id, url, html)."""
    model = model or train(sample_pages(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [blocks(h) for h in rows[2].to_pylist()]
            kept = [[b.text for b, k in zip(f, y, strict=True) if k] for f, y in zip(found, model.label(found), strict=True)]
            yield batch({"page_id": rows[0].to_pylist(), "url": rows[1].to_pylist(), "text": ["\n".join(k) for k in kept], "blocks": list(map(len, found)), "main_blocks": list(map(len, kept))}, _TEXT)

    return map_rows(pages.select("page_id", "url", "html"), run, _TEXT)


def op7_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
