"""Main text of web pages, by a conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text with no block element inside, each with
the elements around it. A linear-chain CRF labels the blocks of a page in order as
article or not; its features are the tags and class words of all ancestors and
measures of the text. It is trained on pages whose markup says what the article is,
also with that markup hidden and with further boilerplate put in, and decoded by
Viterbi's algorithm.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Bounds of the fit: pages, consecutive blocks of a page, and code points of a block.
PAGES = 200
PAGE_BLOCKS = 60
BLOCK_CHARS = 3000
SEED = 7
STEPS = 120

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg object canvas select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "button", "html", "head", "title", "option", "td", "th", "tr"}
TAGS = (
    "a article aside b blockquote button dd div dl dt figcaption figure footer form h1 h2 h3 "
    "head header li main nav ol p pre section span table td th title ul"
).split()
#: Words in class, id and role, by what they speak for.
WORDS = {
    "ad": "ad|ads|advert\\w*|banner|promo\\w*|sponsor\\w*",
    "menu": "nav\\w*|menu|breadcrumb\\w*|toolbar|tabs",
    "comment": "comment\\w*|repl(?:y|ies)|discuss\\w*|disqus",
    "foot": "foot\\w*|copyright|colophon|legal",
    "side": "side\\w*|widget\\w*|related|recommend\\w*|teaser\\w*|share|social",
    "notice": "cookie\\w*|notice\\w*|consent|popup|modal|alert",
    "form": "form\\w*|subscri\\w*|newsletter|login|search\\w*|signup",
    "head": "head(?:er)?|masthead|topbar|logo",
    "content": "content|article\\w*|post|story|main|entry|text|body",
}
MAIN = frozenset(("article", "main"))
NOT_MAIN = frozenset("nav aside footer header form head title button".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)"
    r"(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPEAKS = [(k, re.compile(rf"(?:^|[\s_-])(?:{w})(?=$|[\s_-])", re.I)) for k, w in WORDS.items()]
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

FEATURES = (
    [f"in:{t}" for t in TAGS]
    + [f"named:{w}" for w in WORDS]
    + [f"own:{t}" for t in ("p", "li", "div", "td", "h1", "h2", "h3", "title", "body", "other")]
    + [f"chars:{n}" for n in (0, 15, 40, 80, 160, 400)]
    + [f"words:{n}" for n in (1, 3, 8, 20, 60)]
    + ["links:some", "links:most", "ends:stop", "mark:copyright", "mark:digits", "mark:capitals"]
    + ["first", "last", "after:heading"]
)
_AT = {f: i for i, f in enumerate(FEATURES)}
_HIDDEN = {_AT[k]: _AT["in:div"] for k in ("in:article", "in:main")}


@dataclass
class Block:
    """A leaf block: its text, what is around it, and how much of it is in links."""

    text: str
    around: frozenset[str]
    tag: str
    linked: int


def _speaks(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    names = " ".join(x or y or z for x, y, z in _NAMED.findall(attributes))
    return tuple(f"named:{k}" for k, p in _SPEAKS if p.search(names)) if names else ()


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, whatever its markup lacks or has too much of.

    Comments, scripts, styles and the like have no text. A line break is white space.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: dict[str, int] = {}
    text: list[str] = []
    links: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                tag = next((t for t, _ in reversed(stack) if t in BLOCK), "body")
                linked = len(" ".join("".join(links).split()))
                blocks.append(Block(words, frozenset(k for k, n in held.items() if n), tag, linked))
        text.clear()
        links.clear()

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names))
        for k in (f"in:{tag}", *names):
            held[k] = held.get(k, 0) + 1

    def pop_to(tag: str) -> None:
        while stack:
            top, names = stack.pop()
            for k in (f"in:{top}", *names):
                held[k] -= 1
            if top == tag:
                return

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            run = page[at:]
            at = n
        else:
            run = page[at : found.start()]
            at = found.end()
        if run:
            text.append(run)
            if held.get("in:a"):
                links.append(run)
        if not found or not found.group(2):
            continue
        tag, closing = found.group(2).lower(), bool(found.group(1))
        if tag in RAW:
            if not closing:
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else n
                text.append(" ")
            continue
        if tag in VOID:
            text.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
        if closing:
            if held.get(f"in:{tag}"):
                pop_to(tag)
            continue
        if tag in CLOSES_P and held.get("in:p"):
            pop_to("p")
        if tag == "li" and held.get("in:li") and stack and stack[-1][0] == "li":
            pop_to("li")
        if tag == "body" and held.get("in:head"):
            pop_to("head")
        push(tag, _speaks(found.group(3) or ""))
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[list[int]]:
    """The numbers of the features each block has."""
    out = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        names = [k for k in b.around if k in _AT]
        own = f"own:{b.tag}"
        names.append(own if own in _AT else "own:other")
        names += [f"chars:{x}" for x in (0, 15, 40, 80, 160, 400) if n > x]
        names += [f"words:{x}" for x in (1, 3, 8, 20, 60) if words > x]
        if b.linked:
            names.append("links:most" if 2 * b.linked > n else "links:some")
        if b.text[-1] in ".!?:;\"')":
            names.append("ends:stop")
        if "\N{COPYRIGHT SIGN}" in b.text:
            names.append("mark:copyright")
        if sum(c.isdigit() for c in b.text[:200]) * 4 > min(n, 200):
            names.append("mark:digits")
        if b.text[:200].isupper():
            names.append("mark:capitals")
        if i == 0:
            names.append("first")
        if i == len(blocks) - 1:
            names.append("last")
        if i and blocks[i - 1].tag in ("h1", "h2", "h3"):
            names.append("after:heading")
        out.append([_AT[k] for k in names])
    return out


@dataclass
class Field:
    """Weights of the random field: per feature for the article, and per pair of labels."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not features:
            return []
        w = self.weights
        (aa, ab), (ba, bb) = self.pairs.tolist()
        zero, one, back = 0.0, 0.0, []
        for i, f in enumerate(features):
            s = float(w[f].sum())
            if i:
                a, b = zero + aa, one + ba
                c, d = zero + ab, one + bb
                back.append((b > a, d > c))
                zero, one = max(a, b), max(c, d) + s
            else:
                one = s
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit_field(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS) -> Field:
    """Weights of greatest penalised likelihood of the labels, by gradient steps.

    Pages are padded to one length and worked on together, forwards and backwards.
    """
    pages = [p for p in pages if p[0]]
    n, length = len(pages), max((len(f) for f, _ in pages), default=0)
    size = len(FEATURES)
    theta = np.zeros(size + 4)
    if not n:
        return Field(theta[:size], theta[size:].reshape(2, 2))
    x = np.zeros((n, length, size), dtype=np.float32)
    y = np.zeros((n, length), dtype=int)
    real = np.zeros((n, length), dtype=bool)
    for i, (features, labels) in enumerate(pages):
        for t, f in enumerate(features):
            x[i, t, f] = 1
        y[i, : len(labels)] = labels
        real[i, : len(labels)] = True
    seen_x = (x * (y * real)[:, :, None]).sum(axis=(0, 1))
    seen_pairs = np.zeros((2, 2))
    both = real[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            seen_pairs[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, pairs = theta[:size], theta[size:].reshape(2, 2)
        score = np.zeros((n, length, 2))
        score[:, :, 1] = x @ w.astype(np.float32)
        ahead, behind = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            step_ = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step_, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            step_ = np.logaddexp.reduce(
                pairs + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2
            )
            behind[:, t] = np.where(real[:, t + 1, None], step_, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * real
        due_x = (x * chance[:, :, None].astype(np.float32)).sum(axis=(0, 1))
        joint = (
            ahead[:, :-1, :, None] + pairs + (score[:, 1:] + behind[:, 1:])[:, :, None, :]
        ) - total[:, None, None, None]
        due_pairs = (np.exp(joint) * both[:, :, None, None]).sum(axis=(0, 1))
        slope = np.concatenate([due_x - seen_x, (due_pairs - seen_pairs).ravel()]) / n + 2e-3 * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        rate = 0.2 * (1 - 0.9 * step / steps)
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:size], theta[size:].reshape(2, 2))


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """What a page's own markup says of its blocks; None where it does not say."""
    if not any(MAIN & {k[3:] for k in b.around if k.startswith("in:")} for b in blocks):
        return None
    out = []
    for b in blocks:
        tags = {k[3:] for k in b.around if k.startswith("in:")}
        named = {k[6:] for k in b.around if k.startswith("named:")}
        inside = bool(tags & MAIN) and not tags & NOT_MAIN and not named - {"content"}
        out.append(int(inside))
    return out


#: What boilerplate put into training pages is surrounded by.
_PUT_IN = [
    ({"in:aside"}, "p"), ({"in:aside", "in:ul", "in:li"}, "li"), ({"in:form"}, "p"),
    ({"in:header"}, "p"), ({"in:header"}, "div"), ({"in:footer"}, "p"), ({"in:nav"}, "li"),
    *[({"in:div", f"named:{w}"}, t) for w in WORDS if w != "content" for t in ("p", "div")],
    *[({"in:section", f"named:{w}"}, "p") for w in ("comment", "side")],
    ({"in:ul", "in:li", "named:comment"}, "li"), ({"in:button"}, "button"),
]


def marked_run(page: str) -> tuple | None:
    """Blocks and labels of a page that marks its article, and whether they begin and end
    the page; None where it does not.

    Of a long page a run of ``PAGE_BLOCKS`` consecutive blocks is taken: by the page's
    text either anywhere, or around a place where the article begins or ends. A long
    block's text is shortened, which leaves its features almost as they are.
    """
    blocks = leaf_blocks(page)
    labels = marked_labels(blocks)
    if not labels:
        return None
    rng = random.Random(len(page) * 1_000_003 + len(blocks))
    at, most = 0, len(blocks) - PAGE_BLOCKS
    if most > 0:
        edges = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
        at = rng.randint(0, most)
        if edges and rng.random() < 0.5:
            at = min(max(rng.choice(edges) - rng.randrange(1, PAGE_BLOCKS), 0), most)
    end = at + PAGE_BLOCKS
    run = []
    for b in blocks[at:end]:
        n = len(b.text)
        if n > BLOCK_CHARS:
            short = b.text[: BLOCK_CHARS - 1] + b.text[-1]
            b = Block(short, b.around, b.tag, b.linked * BLOCK_CHARS // n)
        run.append(b)
    return run, labels[at:end], at == 0, end >= len(blocks)


def run_features(blocks: list[Block], begins: bool, ends: bool) -> list[list[int]]:
    """Features of a run of blocks that does or does not begin and end its page."""
    out = block_features(blocks)
    if out and not begins:
        out[0].remove(_AT["first"])
    if out and not ends:
        out[-1].remove(_AT["last"])
    return out


def training_pages(pages: Iterable[str], seed: int = SEED) -> list:
    """``training_runs`` of the pages that mark their article."""
    return training_runs([r for r in map(marked_run, pages) if r], seed)


def training_runs(known: list[tuple], seed: int = SEED) -> list:
    """Features and labels of marked pages, each as it is, and with boilerplate put in:
    texts of articles, so that the text alone does not tell; and with the markup of the
    article replaced by plain divisions."""
    rng = random.Random(seed)
    texts = [b.text for blocks, labels, *_ in known for b, y in zip(blocks, labels, strict=True) if y]
    out = []
    for blocks, labels, *sides in known:
        out.append((run_features(blocks, *sides), labels))
        more = list(zip(blocks, labels, strict=True))
        for around, tag in rng.sample(_PUT_IN, 6):
            at = rng.randrange(len(more) + 1)
            inside = 0 < at < len(more) and more[at - 1][1] and more[at][1]
            extra = {"in:article"} if inside else set()
            words = rng.choice(texts) if texts else "more"
            block = Block(words, frozenset({f"in:{tag}"} | around | extra), tag, 0)
            more[at:at] = [(block, 0)] * rng.choice((1, 1, 2))
        features = run_features([b for b, _ in more], *sides)
        out.append((features, [y for _, y in more]))
        hidden = [sorted({_HIDDEN.get(i, i) for i in f}) for f in features]
        out.append((hidden, [y for _, y in more]))
    return out


def train(pages: DataFrame, sample: int = PAGES) -> Field:
    """The field, from up to ``sample`` pages that mark their article, those of smallest hash.

    All pages that name such an element are candidates. They are read by rising hash,
    a larger part each time, until enough of them mark an article or all are read.
    """

    def runs(parts):
        for part in parts:
            found = [marked_run(p) for p in part.column("html").to_pylist()]
            keep = pa.array([f is not None for f in found], pa.bool_())
            packed = [
                json.dumps([[(b.text, sorted(b.around), b.tag, b.linked) for b in f[0]], *f[1:]])
                for f in found
                if f
            ]
            order = part.column("place").filter(keep), part.column("digest").filter(keep)
            yield pa.RecordBatch.from_arrays([*order, pa.array(packed, pa.string())], ["place", "digest", "run"])

    place = F.xxhash64("html")
    able = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s/>]")).select(
        "html", place.alias("place"), F.sha2(F.col("html").cast("binary"), 256).alias("digest")
    )
    total = able.count()
    share = min(1.0, 2 * sample / max(total, 1))
    while total:
        part = able if share >= 1 else able.where(place < int((2 * share - 1) * (1 << 63)))
        rows = part.mapInArrow(runs, "place long, digest string, run string")
        chosen = rows.orderBy("place", "digest").limit(sample).collect()
        if len(chosen) >= sample or share >= 1:
            break
        share = min(1.0, 8 * share)
    known = []
    for row in chosen if total else []:
        blocks, *rest = json.loads(row.run)
        known.append(([Block(t, frozenset(k), tag, n) for t, k, tag, n in blocks], *rest))
    return fit_field(training_runs(known))


def main_text(field: Field, page: str) -> str:
    blocks = leaf_blocks(page)
    labels = field.decode(block_features(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract_articles(pages: DataFrame, sample: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A null page is empty; a page without an article has an empty text. Repeated rows
    give equal rows; null ids and urls are carried along. Other columns than
    ``page_id``, ``url`` and ``html`` are not looked at. Where no page marks its
    article, nothing can be learned and every text is empty.
    """
    field = train(pages, sample)

    def batches(parts):
        for part in parts:
            texts = [main_text(field, p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    found = pages.select("page_id", "url", whole_text("html").alias("html")).mapInArrow(
        batches, "page_id long, url string, text string"
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))
