"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Each block is a vector of its tag
path (tags, classes and ids, hashed), its words (hashed) and a few measures (length, share of linked text, place). A
bidirectional LSTM in numpy reads the whole sequence, so that each block is judged with the page around it, and labels
every block as article or not. Article blocks, with references decoded and white space turned into single spaces, are joined in
page order by a space.

The weights are trained by train_html.py on synthetic pages of many layouts and lie beside this module. Scripts, styles,
comments and markup are never text. A null or empty page gives an empty text; broken markup is read as far as it
goes: an unclosed tag ends with its parent, a stray closing tag is ignored, an unclosed comment, script or style runs to the end. The
head's own tags are ignored, since both may be left out; so is the tag of any other silent element that is never closed, but a title, which ends at the next tag. Repeated
rows are read each; null ids and addresses stay null; a chance of exactly one half is article. Pages are labelled in batches of
like length, so that padding is small; memory follows the longest page, at about half a kilobyte a block. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import io
import math
import pkgutil
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

PATHS, NEAR, WORDS, MEASURES, HIDDEN = 96, 48, 24, 15, 24
INPUTS = PATHS + NEAR + WORDS + MEASURES
#: Blocks of a batch of pages, padding included.
BATCH = 16_384
#: Bytes of pages that a worker reads at a time; a longer page is read alone.
SLICE = 4_000_000

#: What stands in a tag after its name, up to `>`: a quote opens a value only after `=`, so that an apostrophe in an unquoted value is plain.
_ATTRIBUTES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>][^\s>]*|[^>])*+"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that stand inside a line, that have no content, that aren't text, that hold no markup, and that an opening element of their kind closes.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math title".split())
RAW = frozenset("script style".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@cache
def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % slots


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each closed element of this tag starts and ends; an unclosed one doesn't take the end tag of a later one."""
    found, waiting = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>]){_ATTRIBUTES}>", page, re.I):
        if not m[1]:
            if not m[0].endswith("/>"):
                waiting.append(m.start())
        elif waiting:
            found[waiting.pop()] = m.end()
    return found


class Block:
    __slots__ = ("path", "parts", "linked")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.parts, self.linked = path, [], 0


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, linked share) of the leaf blocks of a page; path has the open tags with their classes and ids."""
    page = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    now: Block | None = None
    links = at = 0
    ends: dict[str, dict[int, int]] = {}

    def add(text: str) -> None:
        nonlocal now
        if not text.strip():
            if now:
                now.parts.append(text)
            return
        if now is None:
            now = Block(tuple(t for _, names in stack for t in names))
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "head":
            continue
        if m[1]:
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            now = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            links = 0
            continue
        if tag in SILENT and not m[3].rstrip().endswith("/"):
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            if (end := ends[tag].get(m.start())) is not None:
                at = end
            elif tag == "title":
                at = k if (k := page.find("<", at)) >= 0 else len(page)
            continue
        if tag in INLINE:
            links += tag == "a"
            if tag == "br" and now:
                now.parts.append(" ")
            continue
        now, links = None, 0
        if tag in ENDS_P or tag in CLOSES:
            closed = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closed:
                    del stack[k:]
                    break
                if stack[k][0] not in ("p", "b", "i"):
                    break
        if tag not in VOID:
            names = [tag]
            if m[3]:
                for a in _NAMED.finditer(m[3]):
                    names += re.split(r"[\s_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a[1] or a[2] or a[3] or "").lower().strip())
            stack.append((tag, tuple(names)))
    add(page[at:])
    found = []
    for b in out:
        raw = "".join(b.parts)
        text = " ".join(references.unescape(raw).split())
        if text:
            found.append((b.path, text, b.linked / max(1, len(raw))))
    return found


def vectors(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """Of each block the hashed names on its path, those of its last elements once more, its hashed words, and measures: lengths, also against the longest
    block and the whole page, what share of the page's text stands in elements of its kind, linked share, place from both ends, last sign, signs and digits within, depth, and whether it has its element to itself."""
    x = np.zeros((len(found), INPUTS), np.float32)
    sizes = [len(text) for _, text, _ in found]
    longest, total = max(sizes, default=1), max(1, sum(sizes))
    alike: dict[tuple[str, ...], int] = {}
    for (path, _, _), n in zip(found, sizes, strict=True):
        alike[path] = alike.get(path, 0) + n
    at = PATHS + NEAR
    for k, (path, text, linked) in enumerate(found):
        for token in path:
            x[k, _slot(token, PATHS)] += 0.8
        for token in path[-3:]:
            x[k, PATHS + _slot("near " + token, NEAR)] += 1.0
        words = text.split(" ")
        counts = np.bincount([zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
        x[k, at : at + WORDS] = counts / len(words)
        n = len(text)
        x[k, at + WORDS :] = (
            math.log1p(len(words)) / 5, math.log1p(n) / 7, linked, k / len(found), 1 / (1 + k), 1 / (len(found) - k), text[-1] in ".!?…:;", len(path) / 10, n / longest, n / total,
            min(1.0, sum(map(text.count, ".,;!?")) / len(words)), min(1.0, 10 * sum(map(text.count, "0123456789")) / n), k > 0 and found[k - 1][0] == path, math.log1p(len(found)) / 5, alike[path] / total,
        )
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output. Each direction has weights w (inputs + hidden + 1 by 4 hidden: input, forget, output, candidate)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def states(self, x: np.ndarray, there: np.ndarray, w: np.ndarray, back: bool) -> np.ndarray:
        """Hidden states of (page, place); `there` marks places with a block."""
        n, t, _ = x.shape
        fed = x @ w[:INPUTS] + w[-1]
        h, c, out = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, t, HIDDEN), np.float32)
        recur = w[INPUTS:-1]
        for k in range(t - 1, -1, -1) if back else range(t):
            z = fed[:, k] + h @ recur
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            on = there[:, k, None]
            c = np.where(on, gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :]), c)
            h = np.where(on, gates[:, 2 * HIDDEN :] * np.tanh(c), h)
            out[:, k] = h
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance that each block of each page is article text."""
        longest = max(len(p) for p in pages)
        x = np.zeros((len(pages), longest, INPUTS), np.float32)
        there = np.zeros((len(pages), longest), bool)
        for k, p in enumerate(pages):
            x[k, : len(p)], there[k, : len(p)] = p, True
        both = np.concatenate([self.states(x, there, self.w["ahead"], False), self.states(x, there, self.w["back"], True)], axis=2)
        y = 1 / (1 + np.exp(-(both @ self.w["out"][:-1] + self.w["out"][-1])))
        return [y[k, : len(p)] for k, p in enumerate(pages)]


@cache
def labeller() -> Labeller:
    with np.load(io.BytesIO(pkgutil.get_data("quern.llm", "html_weights.npz"))) as saved:
        return Labeller({k: saved[k] for k in saved.files})


def texts(pages: list[str | None], model: Labeller | None = None) -> list[str]:
    model = model or labeller()
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k, f in enumerate(found) if f), key=lambda k: len(found[k]))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start + 1) * len(found[order[end]]) <= BATCH:
            end += 1
        same = order[start:end]
        for k, y in zip(same, model.scores([vectors(found[k]) for k in same]), strict=True):
            out[k] = " ".join(text for (_, text, _), p in zip(found[k], y, strict=True) if p >= 0.5)
        start = end
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for _, pages in common.slices(batch.column(2), SLICE):
                found += texts(pages)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(common.lean(run), "page_id long, url string, text string")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
