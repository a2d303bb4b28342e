"""Operator 9: main text of web pages by a recurrent block labeller.

A page is cut into blocks, the texts between block-level tags, each with the path of open elements (names,
classes, ids and roles).  A block's vector joins hashed path parts, hashed words and a few numbers;
a bidirectional LSTM in numpy reads the page's blocks in order, so each block is classified with the
whole page as context.  Kept blocks are joined in page order.

The labeller is trained here: its pages are laid out from sentences of a bounded sample of the given
pages' own words (``train_words`` at most) in a range of layouts whose blocks' labels are known,
with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around or inside
the article.  The network is small (fixed size), trained on the driver and shipped to the tasks.

Heads, scripts, styles, templates, drawings (svg), comments and markup never become blocks; what stands in ``<noscript>`` does.  ``<br>`` is white space.  Null
and empty html give an empty text.  Null urls and repeated rows are carried; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.llm.common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?][^<>]*>", re.DOTALL)
#: A tag up to its end, with whole quoted values, which may hold ``<`` and ``>``; or, where quotes are broken, up to the next ``>`` before
#: any ``<``.
_QUOTED, _PLAIN = re.compile(r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"), re.compile(r"[^<>]*+")
#: Failed readings of whole quoted values may cost so many times the page's length; then quotes count as broken, so that reading is linear.
_BROKEN = 8
#: Elements whose content is no text, and where they end; a head without an end tag ends at the first element that cannot stand in it.
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "template", "svg")}
_RAW["head"] = re.compile(r"</head\s*>|(?=<(?:body|div|p|h[1-6]|article|main|section|header|nav|ul|table)\b)", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

PATH_BITS, WORD_BITS, EXTRA, HIDDEN = 96, 24, 8, 16
INPUT = PATH_BITS + WORD_BITS + EXTRA


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path parts, text, number of characters in links) of each non-empty block."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[tuple[str, ...], str, int]] = []
    held: list[str] = []
    linked = [0]

    def close() -> None:
        if held:
            text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
            if text:
                out.append((tuple(part for _, parts in stack for part in parts), text, min(linked[0], len(text))))
            held.clear()
        linked[0] = 0

    def pop(names: tuple[str, ...] | str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return

    at = look = spent = 0
    in_link = False
    while m := _TOKEN.search(page, look):
        end, name, attributes = m.end(), m[2], ""
        if name:
            until = _QUOTED.match(page, end).end() if spent <= _BROKEN * len(page) else end
            if page[until : until + 1] != ">":
                spent += until - end
                until = _PLAIN.match(page, end).end()
            if page[until : until + 1] != ">":
                look = end  # no tag: its characters are text
                continue
            attributes, end = page[end:until], until + 1
        if m.start() > at:
            held.append(piece := page[at : m.start()])
            if in_link:
                linked[0] += len(piece)
        at = look = end
        if not name:
            continue
        name = name.lower()
        if name in _RAW and not m[1]:
            if name not in ("svg", "template") or not attributes.endswith("/"):
                closing = _RAW[name].search(page, end)
                at = look = closing.end() if closing else len(page)
            continue
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            elif name == "a":
                in_link = not m[1]
            continue
        close()
        if m[1]:
            if any(n == name for n, _ in stack):
                pop((name,))
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        elif name in _SAME and stack and stack[-1][0] in _SAME[name]:
            pop(_SAME[name])
        if name not in _VOID and not attributes.endswith("/"):
            stack.append((name, _parts(name, attributes)))
    if at < len(page):
        held.append(page[at:])
    close()
    return out


@lru_cache(maxsize=20_000)
def _parts(name: str, attributes: str) -> tuple[str, ...]:
    found = [f"<{name}>"]
    for m in _ATTRIBUTE.finditer(attributes):
        found += _NAME.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(found)


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_BITS, np.float32)
    for part in path:
        h = xxhash.xxh3_64_intdigest(part)
        for k in range(3):
            out[(h >> (16 * k)) % PATH_BITS] += 1 - 2 * ((h >> (60 + k)) & 1)
    return np.clip(out, -2, 2)


class _Buckets(dict):
    """word -> bucket of its hash, forgotten when 200,000 words are known."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        bucket = self[word] = xxhash.xxh3_64_intdigest(word) % WORD_BITS
        return bucket


_BUCKETS = _Buckets()


def vectors(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """One row for each block: its path, the shares of its words in hashed buckets, its numbers."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    for row, (path, text, linked) in zip(out, blocks, strict=True):
        row[:PATH_BITS] = _path_vector(path)
        found = text.split(" ")
        row[PATH_BITS : PATH_BITS + WORD_BITS] = np.bincount(list(map(_BUCKETS.__getitem__, found)), minlength=WORD_BITS) / len(found)
        n = len(text)
        row[-EXTRA:] = np.log1p(n) / 8, np.log1p(len(found)) / 8, linked / n, text[-1] in ".!?", text[0].isupper(), n < 25, len(path) / 16, 1
    return out


class Labeller:
    """A bidirectional LSTM and a logistic output, in numpy."""

    NAMES = ("fx", "fh", "bx", "bh", "o", "c")

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.fx, self.fh, self.bx, self.bh = draw(INPUT, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), draw(INPUT, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
        self.o, self.c = draw(2 * HIDDEN + INPUT, 1), np.zeros(1, np.float32)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: bool = True):
        """x is (steps, pages, INPUT); padded steps leave the state as it is.  Gates are kept for training only."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        gates = x @ wx
        kept, out = [], np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps):
            g = gates[t] + h @ wh
            i, f, o = (self._sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * u
            th = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                kept.append((h, c, i, f, o, u, th))
            c, h = m * new + (1 - m) * c, m * (o * th) + (1 - m) * h
            out[t] = h
        return out, kept

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        steps = max(map(len, pages))
        x, mask = self._padded(pages, steps)
        hf, _ = self._run(x, self.fx, self.fh, mask, keep=False)
        hb, _ = self._run(x[::-1], self.bx, self.bh, mask[::-1], keep=False)
        p = self._sigmoid((np.concatenate([hf, hb[::-1], x], 2) @ self.o + self.c)[..., 0])
        return [p[: len(v), k] for k, v in enumerate(pages)]

    @staticmethod
    def _padded(pages: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
        x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, v in enumerate(pages):
            x[: len(v), k], mask[: len(v), k] = v, 1
        return x, mask

    def _back(self, x, mask, wx, wh, kept, dout):
        dwx, dwh = np.zeros_like(wx), np.zeros_like(wh)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, u, th = kept[t]
            m = mask[t][:, None]
            dh = dh + dout[t]
            live, keep_h = dh * m, dh * (1 - m)
            dnew = dc * m + live * o * (1 - th * th)
            dg = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - u * u)], 1)
            dwx += x[t].T @ dg
            dwh += h.T @ dg
            dh, dc = keep_h + dg @ wh.T, dnew * f + dc * (1 - m)
        return dwx, dwh

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 16, batch: int = 32, rate: float = 0.02, seed: int = 1) -> None:
        """Adam on the mean logistic loss over blocks."""
        rng = np.random.default_rng(seed)
        first, second, n = {k: 0.0 for k in self.NAMES}, {k: 0.0 for k in self.NAMES}, 0
        for turn in range(rounds):
            now = rate * (1 - turn / rounds)
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                x, mask = self._padded([pages[i] for i in chosen], max(len(pages[i]) for i in chosen))
                y = np.zeros_like(mask)
                for k, i in enumerate(chosen):
                    y[: len(labels[i]), k] = labels[i]
                hf, kf = self._run(x, self.fx, self.fh, mask)
                hb, kb = self._run(x[::-1], self.bx, self.bh, mask[::-1])
                both = np.concatenate([hf, hb[::-1], x], 2)
                d = ((self._sigmoid((both @ self.o + self.c)[..., 0]) - y) * mask / mask.sum())[..., None]
                dboth = d @ self.o.T
                fx, fh = self._back(x, mask, self.fx, self.fh, kf, dboth[..., :HIDDEN])
                bx, bh = self._back(x[::-1], mask[::-1], self.bx, self.bh, kb, dboth[::-1, :, HIDDEN : 2 * HIDDEN])
                grads = {"fx": fx, "fh": fh, "bx": bx, "bh": bh, "o": np.einsum("tpi,tpj->ij", both, d), "c": d.sum((0, 1))}
                n += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    step = now * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))


#: Class words of the parts of a page, in the layouts that the labeller is trained on.
_MAIN = ("article", "content", "post", "entry", "story", "body", "text", "main", "prose")
_ASIDE = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "links", "tabs"),
    "header": ("header", "masthead", "banner", "top", "branding"),
    "footer": ("footer", "copyright", "legal", "bottom"),
    "sidebar": ("sidebar", "aside", "widget", "related", "recommended", "popular", "trending"),
    "notice": ("notice", "cookie", "consent", "alert", "gdpr", "subscribe", "newsletter", "popup", "modal"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsense"),
    "form": ("form", "login", "search", "signup", "contact"),
    "comments": ("comments", "comment", "replies", "reply", "discussion", "respond", "reader"),
}
_TAGS = {"menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "p"), "ad": ("div", "aside"), "form": ("form", "div"), "comments": ("section", "div", "ol")}
_OWN = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


def made_page(rng: np.random.Generator, vocabulary: list[str]) -> str:
    """A page of random sentences; blocks of its article start with a mark (\x02), others do not."""

    def sentence(least: int, most: int) -> str:
        n = int(rng.integers(least, most + 1))
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
        return _html.escape(" ".join(words).capitalize() + ("." if n > 4 else ""), quote=False)

    def part(kind: str) -> str:
        names = _ASIDE[kind]
        name = names[int(rng.integers(len(names)))]
        tag = _TAGS[kind][int(rng.integers(len(_TAGS[kind])))]
        if tag != _OWN.get(kind) or rng.random() < 0.5:
            attribute = ("class", "id", "class")[int(rng.integers(3))]
            opened = f'<{tag} {attribute}="{name}">'
        else:
            opened = f"<{tag}>"
        if kind in ("menu", "sidebar") and rng.random() < 0.8:
            items = "".join(f'<li><a href="/x">{sentence(1, 3)}</a></li>' for _ in range(int(rng.integers(2, 9))))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{sentence(1, 2)}</label><input><button>{sentence(1, 2)}</button>" if rng.random() < 0.7 else f"<p>{sentence(2, 12)}</p><button>{sentence(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h3>{sentence(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{sentence(3, 60)}</p></div>' for _ in range(int(rng.integers(1, 4))))
        else:
            inner = sentence(1, 25) if tag == "p" or rng.random() < 0.5 else "".join(f"<p>{sentence(2, 40)}</p>" for _ in range(int(rng.integers(1, 3))))
        return f"{opened}{inner}</{tag}>"

    def body() -> str:
        out = [f"<h1>\x02{sentence(2, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 14))):
            draw = rng.random()
            if draw < 0.72:
                least = (1, 20)[int(rng.random() < 0.6)]
                out.append(f"<p>\x02{sentence(1, 4 * least + 10)}</p>" if rng.random() < 0.8 else f"<p>\x02<b>{sentence(1, 30)}<br>")
            elif draw < 0.80:
                out.append(f"<h2>\x02{sentence(1, 8)}</h2>")
            elif draw < 0.86:
                out.append("<ul>" + "".join(f"<li>\x02{sentence(1, 20)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif draw < 0.90:
                out.append(f"<blockquote>\x02{sentence(4, 40)}</blockquote>")
            elif draw < 0.93:
                out.append("<table>" + "".join(f"<tr><td>\x02{sentence(1, 6)}</td><td>\x02{sentence(1, 6)}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>")
            else:
                out.append(part(("ad", "notice", "sidebar", "form")[int(rng.integers(4))]))
        if rng.random() < 0.2:
            out.append(part("comments"))
        return "".join(out)

    draw, name = rng.random(), _MAIN[int(rng.integers(len(_MAIN)))]
    tag = "article" if draw < 0.55 else "main" if draw < 0.7 else "div"
    opened = f'<{tag} class="{name}">' if tag == "div" or rng.random() < 0.4 else f"<{tag}>"
    before = [part(k) for k in ("header", "menu", "notice", "ad", "sidebar", "form") if rng.random() < 0.5]
    after = [part(k) for k in ("comments", "sidebar", "ad", "notice", "menu") if rng.random() < 0.4]
    last = [part("footer")] if rng.random() < 0.8 else []
    wrap = ("<div class=\"wrapper\">", "</div>") if rng.random() < 0.3 else ("", "")
    return f"<html><head><title>x</title></head><body>{wrap[0]}{''.join(before)}{opened}{body()}</{tag}>{''.join(after + last)}{wrap[1]}</body></html>"


def train_labeller(vocabulary: list[str], pages: int = 800, seed: int = 42) -> Labeller:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        found = blocks_of(made_page(rng, vocabulary))
        ys.append(np.array(["\x02" in text for _, text, _ in found], np.float32))
        xs.append(vectors([(path, text.replace("\x02", "").strip() or "x", linked) for path, text, linked in found]))
    labeller = Labeller(seed)
    labeller.train(xs, ys)
    return labeller


def _extract(labeller: Labeller, step: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = [blocks_of(page) if page else [] for page in part["html"].to_pylist()]
                texts = [""] * len(found)
                # pages of like length together, so that padding stays small
                full = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
                at_once: list[list[int]] = []
                for i in full:  # at most 32 pages and some 20,000 padded blocks
                    if not at_once or len(at_once[-1]) == 32 or (len(at_once[-1]) + 1) * len(found[i]) > 20_000:
                        at_once.append([])
                    at_once[-1].append(i)
                for some in at_once:
                    for i, p in zip(some, labeller.probabilities([vectors(found[i]) for i in some]), strict=True):
                        texts[i] = "\n".join(text for (_, text, _), keep in zip(found[i], p >= 0.5, strict=True) if keep)
                out = [part[c] for c in part.schema.names if c != "html"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string())], [c for c in part.schema.names if c != "html"] + ["text"])

    return run


def extract(pages: DataFrame, train_words: int = 5_000, train_pages: int = 200, seed: int = 42) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text).

    The labeller is trained on laid-out pages of at most ``train_words`` words of ``train_pages`` pages.  A null or empty page
    gives an empty text; repeated rows are extracted each; other columns are ignored; an empty table gives no rows."""
    cut = pages.where("html is not null").orderBy(F.xxhash64(F.lit(seed), "page_id"), "page_id").limit(train_pages).select(F.regexp_replace("html", "<[^>]*>", " ").alias("t"))
    words = cut.select(F.explode(F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct().orderBy(F.xxhash64(F.lit(seed), "w"), "w").limit(train_words)
    vocabulary = sorted(r["w"] for r in words.collect()) or ["word"]
    return pages.select("page_id", "url", "html").mapInArrow(_extract(train_labeller(vocabulary, seed=seed)), "page_id long, url string, text string")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = extract(pages)
    return out.withColumn("n_chars", F.length("text").cast("long"))
