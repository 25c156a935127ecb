"""Main text of web pages by a recurrent block labeller (operator 8).

A page is read as a sequence of blocks, the runs of text between tags that
part blocks. Each block is a vector: hashed words of its tag path (tags,
classes, ids, roles), hashed words of its text, and a few lengths. A
bidirectional LSTM in numpy reads the whole sequence, so every block is
classified with the page around it; blocks labelled as main text are joined.

The labeller is trained on the driver from ``SAMPLE_PAGES`` pages, chosen by a
hash among those of up to ``SAMPLE_LENGTH`` characters (longer ones are only read). Elements and class words that name their part of a page label their
blocks; from the same texts further pages are made up in which containers have
other names, or none, and parts that the sampled pages lack stand around them.

Scripts, styles, comments of the markup and templates are no blocks. Of these
only svg may close itself. Line
breaks part blocks; inline elements do not. Broken markup is read as far as it
goes: end tags without a start are skipped, open elements end with their
parents.

Defined results: null and empty pages, and pages without main text, give an
empty text; rows that repeat give rows each; pages of any length are read to
the end; without pages to learn from, the made-up ones have no text and all
blocks are kept by their path only; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import read_table

#: Pages that the labeller is trained on, at most about as many.
SAMPLE_PAGES = 240
#: The longest page, in characters, that it is trained on.
SAMPLE_LENGTH = 200_000
PATH_SIZE = 128
WORD_SIZE = 32
SIZE = PATH_SIZE + WORD_SIZE + 4
HIDDEN = 24
MADE_UP = 3
EPOCHS = 6

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An svg start tag that closes itself; a slash at the end of a value without quotes does not.
_CLOSED_SVG = r"""<svg(?=[\s/])(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+(?:\s*+/)++>"""
_PARTS = re.compile(
    rf"<!--.*?(?:-->|\Z)|{_CLOSED_SVG}|"
    r"<(script|style|noscript|template|svg|iframe)(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")

#: Words of tags, classes and ids that say that a part is not main text, or is.
ASIDE = frozenset(
    "nav menu navbar breadcrumb breadcrumbs header masthead footer aside sidebar widget form button select label title head ad ads advert advertisement banner "
    "sponsor sponsored promo cookie cookies consent notice alert popup modal comment comments reply replies discussion disqus share social related recommended "
    "newsletter subscribe login signup search pagination pager copyright legal toolbar".split())
MAIN = frozenset("article main content post story entry body text".split())


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """Path and text of each block, in order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[tuple[str, ...], str]] = []
    held: list[str] = []
    path: tuple[str, ...] = ()

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((path, text))
            held.clear()

    at = 0
    for m in _PARTS.finditer(page):
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            continue
        close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in _VOID:
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == tag in ("li", "td", "th", "tr", "option", "dt", "dd"):
                stack.pop()
            names = [w for x in _NAMES.findall(m[4] or "") for w in _LETTERS.findall("".join(x).lower())]
            stack.append((tag, (tag, *names)))
        path = tuple(w for _, words in stack for w in (*words, "/"))
    if at < len(page):
        held.append(page[at:])
    close()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed words of a path; the words of the innermost element count a second time, as such."""
    vector = _paths.get(path)
    if vector is None:
        vector = np.zeros(PATH_SIZE, np.float32)
        last = "/".join(path).rstrip("/").rpartition("///")[2].split("/") if path else []
        for word in [*path, *("@" + w for w in last)]:
            code = zlib.crc32(word.encode())
            if word != "/":
                vector[code % PATH_SIZE] += 1 if code >> 16 & 1 else -1
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = vector
    return vector


def vectors(page: list[tuple[tuple[str, ...], str]]) -> np.ndarray:
    """One row for each block."""
    out = np.zeros((len(page), SIZE), np.float32)
    for k, (path, text) in enumerate(page):
        out[k, :PATH_SIZE] = path_vector(path)
        words = text.split(" ")
        code = np.fromiter((hash_ for hash_ in map(zlib.crc32, map(str.encode, words))), np.int64, len(words))
        out[k, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.bincount(code % WORD_SIZE, minlength=WORD_SIZE) / len(words)
        out[k, -4:] = np.log1p(len(words)) / 5, np.log1p(len(text)) / 8, text[-1] in ".!?…", (k + 1) / len(page)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions (input, recurrent, bias) and of the output."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        made = {}
        for way in "fb":
            made[f"{way}x"] = rng.normal(0, SIZE**-0.5, (SIZE, 4 * HIDDEN))
            made[f"{way}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            made[f"{way}c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        made["o"], made["oc"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in made.items()})

    def run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time x pages x HIDDEN) of one direction; padding holds the state."""
        w = self.weights
        order = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        put = x @ w[f"{way}x"] + w[f"{way}c"]
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in order:
            gates = put[t] + h @ w[f"{way}h"]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN:])
            m = mask[t, :, None]
            new = f * c + i * g
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, new, m))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[t] = h
        return out

    def output(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run("f", x, mask), self.run("b", x, mask)], 2)
        return both @ self.weights["o"] + self.weights["oc"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the known blocks, through time."""
        w, kept = self.weights, {"f": [], "b": []}
        both = np.concatenate([self.run("f", x, mask, kept["f"]), self.run("b", x, mask, kept["b"])], 2)
        slope = ((_sigmoid(both @ w["o"] + w["oc"]) - y) * known / max(1, known.sum())).astype(np.float32)
        out = {"o": np.einsum("tn,tnh->h", slope, both), "oc": np.array([slope.sum()], np.float32)}
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            into = slope[:, :, None] * w["o"][part]
            dx, dh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(w[f"{way}h"])
            back_h, back_c = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, new, m in reversed(kept[way]):
                total = back_h + into[t]
                bent = np.tanh(new)
                cell = (total * o * (1 - bent * bent) + back_c) * m
                gates = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), total * m * bent * o * (1 - o), cell * i * (1 - g * g)], 1)
                dx[t] = gates
                dh += h.T @ gates
                back_h = np.where(m, gates @ w[f"{way}h"].T, total)
                back_c = np.where(m, cell * f, back_c)
            flat = dx.reshape(-1, 4 * HIDDEN)
            out |= {f"{way}x": x.reshape(-1, SIZE).T @ flat, f"{way}h": dh, f"{way}c": flat.sum(0)}
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """time x pages x SIZE, and where there is a block."""
    most = max(map(len, pages))
    x, mask = np.zeros((most, len(pages), SIZE), np.float32), np.zeros((most, len(pages)), bool)
    for k, page in enumerate(pages):
        x[:len(page), k], mask[:len(page), k] = page, True
    return x, mask


def rule_label(path: tuple[str, ...]) -> float:
    """1 or 0 where the names in a path tell whether a block is main text, else not a number."""
    told: list[str] = []
    elements = [x.split(" ") for x in " ".join(path).rstrip(" /").split(" / ")] if path else []
    inner = max((k for k, x in enumerate(elements) if x[0] in ("article", "main")), default=-1)
    for k, (tag, *names) in enumerate(elements):
        if tag in ("html", "body"):  # their classes tell of the page as a whole
            told += [tag, "/"]
        else:  # a form around an article is the whole page's
            told += [*([tag] if tag != "form" or k > inner else []), *(w for w in names if w != "title"), "/"]
    if ASIDE.intersection(told):
        return 0.0
    return 1.0 if MAIN.intersection(told) - {"body"} or "/body/" in "/" + "/".join(told[2:]) + "/" else np.nan


_CONTAINERS = (("article",), ("main",), ("div", "content"), ("div", "post", "body"), ("main", "/", "div", "entry", "content"), ("div", "article", "text"), ("section", "story"), ("div",), ("div", "/", "div"))
_AROUND = (
    (("header",), 1), (("div", "header"), 1), (("nav", "/", "ul", "/", "li"), 6), (("ul", "menu", "/", "li"), 5), (("div", "cookie", "notice"), 1), (("div", "consent", "banner"), 1), (("div", "ad"), 1),
    (("div", "advert"), 1), (("aside",), 2), (("aside", "sidebar", "/", "p"), 2), (("div", "sidebar", "/", "ul", "/", "li"), 4), (("form",), 2), (("form", "/", "label"), 2), (("form", "search", "/", "button"), 1),
    (("div", "newsletter", "/", "p"), 1), (("section", "comments", "/", "div", "comment", "/", "p"), 4), (("div", "comments", "/", "p"), 3), (("ol", "comment", "list", "/", "li", "comment"), 3), (("div", "related", "/", "li"), 3),
    (("div", "notice"), 1), (("footer",), 1), (("footer", "/", "p"), 2), (("div", "footer", "/", "p"), 1), (("div", "share"), 1), (("p", "copyright"), 1))


def made_up(pages: list[list[tuple[tuple[str, ...], str]]], seed: int) -> list[tuple[list[tuple[tuple[str, ...], str]], list[float]]]:
    """Pages of other forms out of the texts of ``pages``, with their labels."""
    rng = np.random.default_rng(seed)
    mains = [[(p, t) for p, t in page if rule_label(p) == 1] for page in pages]
    short = [t for page in pages for p, t in page if rule_label(p) == 0] or [""]
    long = [t for page in mains for _, t in page] or [""]
    titles = [page[0][1] for page in mains if page] or [""]
    root = ("html", "/", "body", "/")
    out = []
    for main in mains:
        made: list[tuple[tuple[str, ...], str, float]] = [(("html", "/", "head", "/", "title", "/"), main[0][1] if main else "", 0.0)]

        def around(inside: tuple[str, ...] = ()) -> None:
            path, most = _AROUND[rng.integers(len(_AROUND))]
            if len(path) > 1 and rng.random() < 0.3:
                made.append(((*root, *inside, path[0], *([path[1]] if path[1] != "/" else []), "/", ("h2", "h3", "h4")[rng.integers(3)], "/"), titles[rng.integers(len(titles))], 0.0))
            for _ in range(rng.integers(1, most + 1)):
                pool = long if rng.random() < 0.4 else short
                text = pool[rng.integers(len(pool))]
                made.append(((*root, *inside, *path, "/"), text, 0.0))

        for _ in range(rng.integers(0, 4)):
            around()
        box = _CONTAINERS[rng.integers(len(_CONTAINERS))]
        for k, (path, text) in enumerate(main):
            if rng.random() < 0.05:
                around((*box, "/") if rng.random() < 0.5 else ())
            if rng.random() < 0.15:
                made.append(((*root, *box, "/", ("h2", "h3", "h4")[rng.integers(3)], "/"), titles[rng.integers(len(titles))], 1.0))
            leaf = path[-2] if len(path) > 1 and path[-2] in ("h1", "h2", "li", "pre", "td", "blockquote") else ("h1", "h2", "p")[rng.integers(3)] if k == 0 else "p"
            made.append(((*root, *box, "/", leaf, "/"), text, 1.0))
        for _ in range(rng.integers(0, 5)):
            around((*box, "/") if rng.random() < 0.1 else ())
        made = [m for m in made if m[1]]
        if made:
            out.append(([(p, t) for p, t, _ in made], [y for _, _, y in made]))
    return out


def train(pages: list[str], seed: int = 3) -> Labeller:
    """A labeller from sampled pages, by Adam over batches of pages of like length."""
    read = [b for b in map(blocks, pages) if b]
    examples = [(page, [rule_label(p) for p, _ in page]) for page in read]
    for k in range(MADE_UP):
        examples += made_up(read, seed + k)
    labeller = Labeller.fresh(seed)
    if not any(np.isfinite(y).any() for _, y in examples):
        return Labeller({})
    data = [(vectors(page), np.array(y)) for page, y in examples]
    rng = np.random.default_rng(seed)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in labeller.weights.items()}
    step = 0
    order = sorted(range(len(data)), key=lambda k: len(data[k][0]))
    batches = [order[k:k + 16] for k in range(0, len(order), 16)]
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            some = [data[k] for k in batches[b]]
            x, mask = padded([v for v, _ in some])
            y, known = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, bool)
            for k, (_, label) in enumerate(some):
                y[:len(label), k], known[:len(label), k] = np.nan_to_num(label), np.isfinite(label)
            step += 1
            for name, grad in labeller.gradients(x, mask, y, known).items():
                grad = grad * min(1.0, 5 / (np.linalg.norm(grad) + 1e-9))
                one, two = state[name]
                one += 0.1 * (grad - one)
                two += 0.001 * (grad * grad - two)
                labeller.weights[name] -= (0.01 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return labeller


def main_texts(labeller: Labeller, pages: list[str]) -> list[str]:
    """Main text of each page; pages of like length go through the labeller together."""
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k, b in enumerate(read) if b), key=lambda k: len(read[k]))
    low = 0
    while low < len(order):
        high = low + 1  # as many as pad to 4096 blocks
        while high < len(order) and (high - low + 1) * len(read[order[high]]) <= 4096:
            high += 1
        some = order[low:high]
        if labeller.weights:
            score = labeller.output(*padded([vectors(read[k]) for k in some]))
        else:  # nothing was learnt: by the path, and kept where it does not tell
            score = padded([vectors(read[k]) for k in some])[1].astype(np.float32)
            for place, k in enumerate(some):
                score[:len(read[k]), place] = [0 if rule_label(p) == 0 else 1 for p, _ in read[k]]
        for place, k in enumerate(some):
            out[k] = "\n".join(text for (_, text), s in zip(read[k], score[:, place], strict=False) if s > 0)
        low = high
    return out


def sample_pages(pages: DataFrame, bound: int = SAMPLE_PAGES) -> list[str]:
    """About ``bound`` pages, chosen by a hash of their text; all if there are fewer."""
    rows = pages.filter(f"length(html) BETWEEN 1 AND {SAMPLE_LENGTH}").select("html")
    part = F.pmod(F.xxhash64(F.lit(9), "html"), F.lit(1 << 30)) / float(1 << 30)
    return sorted(r["html"] for r in rows.filter(part < min(1.0, bound / max(1, rows.count()))).collect())


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                rows = batch.slice(low, 128)
                texts = main_texts(labeller, [p or "" for p in rows.column("html").to_pylist()])
                yield pa.record_batch([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train(sample_pages(pages)))
