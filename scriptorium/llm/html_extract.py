"""Main-text extraction by wrapper induction.

Pages of a host share a template. Each page is read once into the tree of its block elements and its
lines of text, each with the block it stands in. Pages of one host and one layout (the kinds of
the elements down to the children of body) form a group; those of thin groups are grouped by host, then by
layout alone. A group has a reference page, and every page's tree is aligned with the
reference's by simple tree matching. An aligned block is a slot of the wrapper; a block without a
partner belongs to the slot of its nearest aligned ancestor, told apart by the kinds of elements
on the way. For every slot the different pages, the different texts, the words and the linked words
are counted over the whole group, with partial sums and sketches. Pages that share their ``LONGEST``
longest lines are one page there, so copies of a page do not make its text a template.

The counts decide: a slot is template if its texts repeat (at most ``VARIED`` different ones for each page), else
content; a slot of under ``LEAST_PAGES`` pages goes by all its siblings of the same kind. The content region is
the deepest container that holds ``REGION`` of the group's unlinked content words; lists of links
inside it are left out. A page's text is its lines in the region whose slot is not template, and
varied first headings elsewhere. Of these, lines that elements, roles or class names mark as no part of an article (forms,
comments and the like, which differ from page to page inside an article) are dropped after that.
Pages of which the wrapper keeps nothing, and those without one, keep what such marks leave.

Pages are never compared with each other beyond the reference, so a hot host costs no more per page
than another. Wrappers are broadcast if they have been counted to be few, else joined by group, where
adaptive execution splits a hot one.

Edge cases: null and empty html give an empty text; cut-off and unbalanced markup is closed at the
end; very long and deep pages are read and aligned whole; pages of a null or odd url belong to the host '';
of equal candidates the reference is the tree of the smallest hash; repeated rows are extracted each; an empty
table gives no rows; null page_ids and extra columns change nothing.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

LEAST_PAGES = 8
VARIED = 0.5
REGION = 0.85
LINKED = 0.8
LONGEST = 4
#: Trees up to this size are aligned exactly; of larger ones the children are paired by kind and size first.
ALIGN_NODES = 400
#: Wrappers that may be broadcast.
WRAPPERS = 2_000
#: Alignments and wrappers a task remembers.
REMEMBERED = 4_096

#: Elements without content, without text, that open a block, and that hold only text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg math iframe object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt caption figcaption".split())
#: Fixed values, for the marks: elements that are no part of an article, and words in class, id or role.
BOILERPLATE = frozenset("nav header footer aside button select dialog menu head figure label fieldset".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|share|sharing|social|"
    r"cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|search|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|skip|toolbar|contentinfo|complementary|hidden|sr-only)(?=$|[\s_-])",
    re.I,
)
_CLOSES_P = BLOCKS - {"html", "body", "tbody", "tr", "td", "th", "thead", "tfoot", "li", "dd", "dt", "caption"}
_SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^>\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?=[\s/]|\Z))", re.I)

#: What is known of a place: it is marked, inside a form, an article, a main element, a link.
MARK, FORM, ARTICLE, MAIN, LINK = 1, 2, 4, 8, 16

#: Block elements in document order: (parent's index, kind), the first being the page.
Tree = list[tuple[int, str]]
#: (index of its block, text, words, linked words, what is known of its place).
Line = tuple[int, str, int, int, int]


def _attributes(attrs: str) -> tuple[str, bool, bool]:
    """An element's class without digits, whether it is marked, and whether its role is main."""
    kind, marked, main = "", False, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            kind = re.sub(r"[0-9]+", "", " ".join(value.split()))
        main |= name == "role" and value.lower() == "main"
        marked |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name in ("class", "id", "role") and MARKED.search(value) is not None)
    return kind, marked, main


def _known(tag: str, marked: bool, main: bool, above: int) -> int:
    """What is known inside an element, given what is known around it."""
    if tag == "article" or tag == "main" or main:
        return (above & ~FORM) | (ARTICLE if tag == "article" else MAIN)
    if tag in ("html", "body"):
        return above
    if tag in BOILERPLATE and not (above & (ARTICLE | MAIN) and tag in ("header", "figure", "label")):
        marked = True
    return above | (MARK if marked else 0) | (FORM if tag == "form" else 0) | (LINK if tag == "a" else 0)


def read_page(source: str | None) -> tuple[Tree, list[Line]]:
    """The tree of a page's blocks, and its lines of text in page order, in one pass.

    Comments and the contents of raw elements are dropped. Marked parts of a block are a line of their own.
    """
    text = source or ""
    tree: Tree = [(-1, "#page")]
    lines: list[Line] = []
    stack = [("#page", 0, 0)]
    opened: Counter = Counter()
    runs: tuple[list, list] = ([], [])

    def flush() -> None:
        for pieces in runs:
            if pieces:
                line = " ".join(entities.unescape("".join([p for p, _, _ in pieces])).split())
                if line:
                    _, node, known = next(p for p in pieces if not p[0].isspace())
                    linked = sum(len(p.split()) for p, _, k in pieces if k & LINK)
                    lines.append((node, line, line.count(" ") + 1, linked, known))
                pieces.clear()

    def say(piece: str) -> None:
        _, node, known = stack[-1]
        run = runs[1 if known & (MARK | FORM) else 0]
        if run or not piece.isspace():
            run.append((piece, node, known))

    def close(i: int) -> None:
        for tag, _, _ in stack[i:]:
            opened[tag] -= 1
        if any(tag in BLOCKS for tag, _, _ in stack[i:]):
            flush()
        del stack[i:]

    at = 0
    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            say(text[at:])
            break
        if m.start() > at:
            say(text[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag, attrs = m["name"].lower(), m["attrs"]
        if m["close"]:
            i = len(stack) - 1 if opened[tag] else 0
            while i > 0 and stack[i][0] != tag:
                i = 0 if stack[i][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html") else i - 1
            if i > 0:
                close(i)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in _CLOSES_P or tag in _SAME_CLOSES:
            ends = _SAME_CLOSES.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCKS and stack[i][0] != "p":
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            say(" ")
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        kind, marked, main = _attributes(attrs) if attrs else ("", False, False)
        _, node, above = stack[-1]
        if tag in BLOCKS:
            tree.append((node, f"{tag}.{kind}" if kind else tag))
            node = len(tree) - 1
        stack.append((tag, node, _known(tag, marked, main, above)))
        opened[tag] += 1
    flush()
    return tree, lines


def layout(tree: Tree) -> int:
    """A digest of the kinds of elements down to the children of body."""
    depth, paths = [0] * len(tree), [""] * len(tree)
    for i, (parent, kind) in enumerate(tree):
        depth[i] = depth[parent] + 1 if parent >= 0 else 0
        if depth[i] <= 3:
            paths[i] = f"{paths[parent] if parent >= 0 else ''}/{kind}"
    return zlib.crc32("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass"))


def align(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: index pairs of the largest top-down, order-keeping alignment.

    All nodes take part. Equal subtrees at either end of two lists of children are paired at once, which is always
    among the best. Where two nodes hold too much for an exact alignment, their children are paired in order,
    weighed by kind and size instead of by their best alignment, and each pair is aligned in turn.
    """
    most = ALIGN_NODES * ALIGN_NODES
    kids, sizes, shapes = [], [], []
    known_shapes: dict[tuple, int] = {}
    for t in (a, b):
        c: list[list[int]] = [[] for _ in t]
        for i, (parent, _) in enumerate(t):
            if parent >= 0:
                c[parent].append(i)
        kids.append(c)
        n, shape = [1] * len(t), [0] * len(t)
        for i in range(len(t) - 1, -1, -1):
            shape[i] = known_shapes.setdefault((t[i][1], *[shape[k] for k in c[i]]), len(known_shapes))
            if i:
                n[t[i][0]] += n[i]
        sizes.append(n)
        shapes.append(shape)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(i: int, j: int) -> tuple[int, list[tuple[int, int]]]:
        """The size of the best alignment below (i, j), and the aligned children."""
        if a[i][1] != b[j][1]:
            return 0, []
        if (i, j) in memo:
            return memo[i, j]
        x, y = kids[0][i], kids[1][j]
        if not x or not y:
            return 1, []
        if shapes[0][i] == shapes[1][j]:
            return sizes[0][i], list(zip(x, y, strict=True))
        first, last = 0, min(len(x), len(y))
        while first < last and shapes[0][x[first]] == shapes[1][y[first]]:
            first += 1
        back = 0
        while first + back < last and shapes[0][x[-1 - back]] == shapes[1][y[-1 - back]]:
            back += 1
        xm, ym = x[first : len(x) - back], y[first : len(y) - back]
        pairs = paired(xm, ym, [[match(p, q)[0] for q in ym] for p in xm]) if xm and ym else []
        ends = [*zip(x[:first], y[:first], strict=True), *zip(x[len(x) - back :], y[len(y) - back :], strict=True)]
        memo[i, j] = (1 + sum(sizes[0][p] for p, _ in ends) + sum(match(p, q)[0] for p, q in pairs), ends + pairs)
        return memo[i, j]

    def paired(x: list[int], y: list[int], w: list[list[int]]) -> list[tuple[int, int]]:
        """The order-keeping pairs of the largest weight, from the last to the first."""
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            row, prev, wp = best[p], best[p - 1], w[p - 1]
            for q in range(1, len(y) + 1):
                row[q] = max(row[q - 1], prev[q], prev[q - 1] + wp[q - 1])
        pairs, p, q = [], len(x), len(y)
        while p and q:
            if w[p - 1][q - 1] and best[p][q] == best[p - 1][q - 1] + w[p - 1][q - 1]:
                p, q = p - 1, q - 1
                pairs.append((x[p], y[q]))
            elif best[p][q] == best[p - 1][q]:
                p -= 1
            else:
                q -= 1
        return pairs

    def linear(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        """Pairs of equal kinds from both ends, then by weight if few are left, else each with the next of its kind."""
        pairs, same = [], lambda p, q: a[p][1] == b[q][1]
        first, last = 0, min(len(x), len(y))
        while first < last and same(x[first], y[first]):
            pairs.append((x[first], y[first]))
            first += 1
        back = 0
        while first + back < last and same(x[-1 - back], y[-1 - back]):
            pairs.append((x[-1 - back], y[-1 - back]))
            back += 1
        x, y = x[first : len(x) - back], y[first : len(y) - back]
        if len(x) * len(y) <= most:
            return pairs + paired(x, y, [[min(sizes[0][p], sizes[1][q]) if same(p, q) else 0 for q in y] for p in x])
        places: dict[str, list[int]] = {}
        for k, q in enumerate(y):
            places.setdefault(b[q][1], []).append(k)
        at = 0
        for p in x:
            known = places.get(a[p][1], [])
            k = bisect_left(known, at)
            if k < len(known):
                pairs.append((p, y[known[k]]))
                at = known[k] + 1
        return pairs

    out, todo = [], [(0, 0)] if a and b and a[0][1] == b[0][1] else []
    whole = set()
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        if (i, j) in whole or sizes[0][i] * sizes[1][j] <= most:
            below = match(i, j)[1]
            whole.update(below)
        else:
            below = linear(kids[0][i], kids[1][j])
        todo += below
    return out


def places(reference: Tree, tree: Tree) -> list[tuple[int, int]]:
    """The slot of each block of a page: (reference block, 0), or that of an ancestor and a digest of the way down."""
    partner = {j: i for i, j in align(reference, tree)}
    out: list[tuple[int, int]] = []
    for j, (parent, kind) in enumerate(tree):
        if j in partner:
            out.append((partner[j], 0))
        else:
            slot, way = out[parent] if parent >= 0 else (0, 0)
            out.append((slot, zlib.crc32(kind.encode("utf-8", "surrogatepass"), way)))
    return out


Wrapper = tuple[dict[tuple[int, int], bool], frozenset[int]]


def induce(reference: Tree, counts: list[tuple[int, int, int, int, int, int]]) -> Wrapper:
    """Which slots hold content, and the reference blocks of the content region.

    counts: (slot, way, different pages, different texts, words, linked words).
    """
    kin = lambda slot, way: (slot, way) if way else (reference[slot][0], zlib.crc32(reference[slot][1].encode("utf-8", "surrogatepass")))
    pooled: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for slot, way, n, texts, _, _ in counts:
        pool = pooled[kin(slot, way)]
        pool[0] += n
        pool[1] += texts
    content: dict[tuple[int, int], bool] = {}
    for slot, way, n, texts, _, _ in counts:
        n, texts = (n, texts) if n >= LEAST_PAGES else pooled[kin(slot, way)]
        if n >= LEAST_PAGES:
            content[slot, way] = texts > VARIED * n
    for key, (n, texts) in pooled.items():
        if n >= LEAST_PAGES:
            content.setdefault(key, texts > VARIED * n)
    mass, words, linked = ([0] * len(reference) for _ in range(3))
    for slot, way, _, _, w, k in counts:
        mass[slot] += max(0, w - k) if content.get((slot, way)) else 0
        words[slot] += w
        linked[slot] += k
    kids: list[list[int]] = [[] for _ in reference]
    for i in range(len(reference) - 1, 0, -1):
        parent = reference[i][0]
        kids[parent].append(i)
        for total in (mass, words, linked):
            total[parent] += total[i]
    if not mass[0]:
        return content, frozenset()
    top = 0
    while True:
        down = [i for i in kids[top] if mass[i] >= REGION * mass[0] and reference[i][1].split(".")[0] not in TEXTUAL]
        if not down:
            break
        top = down[0]
    region, todo = set(), [top]
    while todo:
        i = todo.pop()
        region.add(i)
        todo += [k for k in kids[i] if not (words[k] and linked[k] >= LINKED * words[k])]
    return content, frozenset(region)


def wrapped(slots: list[tuple[int, int]], heading: list[bool], wrapper: Wrapper, parents: list[int], kinds: list[int]) -> list[bool]:
    """Whether the wrapper keeps each line, given its slot and whether it is a first heading."""
    content, region = wrapper
    out = []
    for (slot, way), first in zip(slots, heading, strict=True):
        good = content.get((slot, way))
        if good is None and not way:
            good = content.get((parents[slot], kinds[slot]))
        out.append(good is not False if slot in region else bool(first and good))
    return out


def marked_text(lines: list[str], known: list[int], strict: bool = False) -> list[str]:
    """What the marks leave: unmarked lines of articles, else of main elements, else (unless strict) all."""
    clear = [(t, k) for t, k in zip(lines, known, strict=True) if not k & (MARK | FORM)]
    for inside in (ARTICLE, MAIN):
        if any(k & inside for _, k in clear):
            return [t for t, k in clear if k & inside]
    return [] if strict else [t for t, _ in clear]


def pack(tree: Tree) -> str:
    return "\n".join(f"{p}\t{k}" for p, k in tree)


def unpack(packed: str) -> Tree:
    return [(int(p), k) for p, k in (x.split("\t") for x in packed.split("\n"))]


_READ = "layout long, page long, tree string, block array<int>, text string, digest array<long>, words array<int>, linked array<int>, known array<int>"


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        rows = []
        for source in pages:
            tree, lines = read_page(source)
            digest = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for _, t, _, _, _ in lines], dtype=np.uint64).view(np.int64)
            longest = sorted(zip([-r[2] for r in lines], digest.tolist(), strict=True))[:LONGEST]
            page = xxhash.xxh64_intdigest(repr(longest).encode()) >> 1 if lines else None
            columns = [np.array([r[c] for r in lines], dtype=np.int32) for c in (0, 2, 3, 4)]
            rows.append((layout(tree), page, pack(tree), columns[0], "\n".join([t for _, t, _, _, _ in lines]), digest, *columns[1:]))
        yield pd.DataFrame(rows, columns=["layout", "page", "tree", "block", "text", "digest", "words", "linked", "known"]).astype({"page": "Int64"})


class _Memory(dict):
    """Results of a function of two strings, forgotten all at once when they are many."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = self.function(*key)
        return self[key]


def _placed() -> _Memory:
    return _Memory(lambda reference, tree: places(unpack(reference), unpack(tree)))


def _slots(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    placed = _placed()
    for trees, blocks, references in batches:
        found = [[placed[r, t][b] for b in own] for t, own, r in zip(trees, blocks, references, strict=True)]
        yield pd.DataFrame({"slot": [np.array([s for s, _ in f], dtype=np.int32) for f in found], "way": [np.array([w for _, w in f], dtype=np.int64) for f in found]})


def _induced(references: pd.Series, counts: pd.Series) -> pd.Series:
    out = []
    for r, rows in zip(references, counts, strict=True):
        content, region = induce(unpack(r), [tuple(c[k] for k in ("slot", "way", "pages", "texts", "words", "linked")) for c in rows])
        out.append(json.dumps([sorted([s, w, int(v)] for (s, w), v in content.items()), sorted(region)]))
    return pd.Series(out, dtype=object)


def _loaded(reference: str, induced: str) -> tuple[Wrapper, list[int], list[int]]:
    content, region = json.loads(induced)
    tree = unpack(reference)
    return ({(s, w): bool(v) for s, w, v in content}, frozenset(region)), [p for p, _ in tree], [zlib.crc32(k.encode("utf-8", "surrogatepass")) for _, k in tree]


def page_text(tree: str, blocks, text: str, known, reference: str | None, induced: str | None, marks: bool = True, placed: _Memory | None = None, loaded: _Memory | None = None) -> str:
    """The text of a page that was read, given its group's reference tree and induced wrapper, if there is one."""
    lines, known = text.split("\n") if text else [], [int(k) for k in known]
    if reference is None or induced is None:
        return "\n".join(marked_text(lines, known))
    wrapper, parents, kinds = (_loaded(reference, induced)) if loaded is None else loaded[reference, induced]
    if not wrapper[1]:
        return "\n".join(marked_text(lines, known))
    at = places(unpack(reference), unpack(tree)) if placed is None else placed[reference, tree]
    nodes = unpack(tree)
    kept = wrapped([at[b] for b in blocks], [nodes[b][1].split(".")[0] == "h1" for b in blocks], wrapper, parents, kinds)
    found = [t for t, k, keep in zip(lines, known, kept, strict=True) if keep and not (marks and k & (MARK | FORM))]
    return "\n".join(found or marked_text(lines, known, strict=True))


def _texts(marks: bool):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        placed, loaded = _placed(), _Memory(_loaded)
        for batch in batches:
            yield pd.Series([page_text(*row, marks=marks, placed=placed, loaded=loaded) for row in zip(*batch, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")


def _grouped(read: DataFrame) -> DataFrame:
    """(host, layout, group): layouts of a host, hosts and layouts of enough different pages, in this order."""
    sizes = materialize(read.where("page IS NOT NULL").groupBy("host", "layout").agg(F.approx_count_distinct("page").alias("n")))
    thin = sizes.where(F.col("n") < LEAST_PAGES)
    hosts = thin.groupBy("host").agg((F.sum("n") >= LEAST_PAGES).alias("enough"))
    own = F.concat_ws(" ", "host", F.col("layout").cast("string"))
    name = F.when(F.col("n") >= LEAST_PAGES, own).when(F.col("enough"), F.concat("host", F.lit(" *"))).otherwise(F.concat(F.lit("* "), F.col("layout").cast("string")))
    return materialize(sizes.join(hosts, "host", "left").select("host", "layout", name.alias("group")))


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(page_id, url, text) of every page; without marks the wrapper alone decides where there is one."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))
    read = materialize(pages.select("page_id", "url", host.alias("host"), F.pandas_udf(_read, _READ)("html").alias("p")).select("page_id", "url", "host", "p.*"))
    groups = broadcast_if_small(_grouped(read))
    member = read.join(groups, ["host", "layout"], "left")

    # The reference of a group: a tree of moderate size, else any, by hash; combined before any shuffle.
    pick = F.struct(F.length("tree") > 20_000, F.xxhash64("tree"), F.col("tree").alias("tree"))
    references = member.where("group IS NOT NULL").groupBy("group").agg(F.min(pick).alias("r")).select("group", F.col("r.tree").alias("reference"))
    references = broadcast_if_small(materialize(references), WRAPPERS)

    placed = member.join(references, "group").select("group", "page", "digest", "words", "linked", F.pandas_udf(_slots, "slot array<int>, way array<long>")("tree", "block", "reference").alias("at"))
    line = F.arrays_zip(F.col("at.slot").alias("slot"), F.col("at.way").alias("way"), "digest", "words", "linked")
    lines = placed.select("group", "page", F.explode(line).alias("l")).select("group", "page", "l.*")
    counts = lines.groupBy("group", "slot", "way").agg(
        F.approx_count_distinct("page").alias("pages"), F.approx_count_distinct("digest").alias("texts"), F.sum("words").alias("words"), F.sum("linked").alias("linked"),
    )
    # Ways of few pages tell nothing, and only they may be many.
    slots = counts.where((F.col("way") == 0) | (F.col("pages") >= LEAST_PAGES)).groupBy("group").agg(F.collect_list(F.struct("slot", "way", "pages", "texts", "words", "linked")).alias("counts"))
    wrappers = materialize(slots.join(references, "group").select("group", "reference", F.pandas_udf(_induced, "string")("reference", "counts").alias("induced")))

    whole = member.join(broadcast_if_small(wrappers, WRAPPERS), "group", "left")
    return whole.select("page_id", "url", _texts(marks)("tree", "block", "text", "known", "reference", "induced").alias("text"))


def query(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
