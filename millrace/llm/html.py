"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is not text, elements without content, block elements, headings, elements
# that an opening tag of the key closes, and the element around them beyond which it does not reach.
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object textarea title select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AROUND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ()}
# Elements that can hold a whole article, and those that make no part of one when they stand beside it without content of their own.
HOLDERS = frozenset("html body main article div".split())
WRAPPERS = frozenset("div section center header fieldset details".split())
# Elements that say what they are, and words of classes, ids and roles that hint at what is not the article.
BOILERPLATE_TAGS = frozenset("nav footer aside button head menu dialog".split())
HINTING_TAGS = frozenset("form header".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar side widget related recommended share sharing social comment comments commentlist disqus respond reply replies reactions "
    "cookie cookies consent notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login search form "
    "pagination pager toolbar tagcloud copyright legal skip".split()
)
# Parts of names that say nothing about the content beside a hint, and elements that a name can hint at: containers, never a
# paragraph, a heading, a cell or anything inside a line.
PLAIN = frozenset(
    "list lists area box boxes wrapper wrap container section block blocks bar buttons button links link item items posts post stories story articles site page main "
    "top bottom left right inner outer content group row column col panel region zone slot unit text tags global primary secondary sub mini sticky fixed the".split()
)
HINTABLE = frozenset("div section header form fieldset ul ol dl table center details figure".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd".split())
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)[^.]{0,80}(?:\d{4}|rights reserved|reserved)", re.I)
#: Share of the text from which the only article of a page is it, whatever stands beside it; with a title and a paragraph it needs none.
ONLY_ARTICLE = 0.05
#: A hint is not followed where the text outside that nothing hints at weighs less than this share of the text inside.
LEFT_OVER = 0.1
#: What a followed hint leaves of a path's ratio, and what an article or main element adds to it.
HINTED, MARKED = 0.05, 4.0

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass
class Page:
    """Elements in the order of their opening tags (so parents come first), and text nodes."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    #: 2 where a name says nothing but hints (`comments`, `cookie-banner`), 1 where it holds one among other words (`related-work`).
    hinted: list[int] = field(default_factory=lambda: [0])
    #: Of text nodes: element, number of the block, decoded text.
    leaves: list[tuple[int, int, str]] = field(default_factory=list)

    def sums(self, own: list[float]) -> list[float]:
        """Sums over the elements below each one and itself."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total


def parsed(page: str) -> Page:
    """One pass over a page; its time and memory follow the page's length, whatever is left open or nested in it."""
    out, paths = Page(), {}
    stack, opened = [0], defaultdict(list)  # opened: places in the stack, by name
    block, at, size, strict = 0, 0, len(page), True
    raw_end: dict[str, re.Pattern[str]] = {}

    def text(piece: str) -> None:
        if piece:
            out.leaves.append((stack[-1], block, " " if piece.isspace() else entities.unescape(piece)))

    def close(place: int) -> None:
        while len(stack) > place:
            opened[out.name[stack.pop()]].pop()

    def last(*names: str) -> int:
        return max((opened[n][-1] for n in names if opened[n]), default=0)

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            text(page[at:start])
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if page.startswith(opening, start):
                    end = page.find(closing, start + len(opening))
                    at = size if end < 0 else end + len(closing)
                    break
            continue
        m = _NAME.match(page, start + 1 + (after == "/"))
        if m is None:
            text(page[at : start + 1])
            at = start + 1
            continue
        tail = _ATTRIBUTES.match(page, m.end()) if strict else None
        if tail is None:  # an open quote or no end: from here on the next > ends a tag
            strict = False
            end = page.find(">", m.end()) + 1
            if not end:
                text(page[at:])
                break
        else:
            end = tail.end()
        text(page[at:start])
        at, name, attributes = end, m[0].lower(), page[m.end() : end - 1]
        if name in BLOCK:
            block += 1
        if after == "/":
            place = last(name)
            if place and (place > last("article", "main", "body") or name in ("article", "main", "body", "html", "div", "section")):
                close(place)
            continue
        empty = attributes.rstrip().endswith("/")
        if name in RAW and not empty:
            found = raw_end.setdefault(name, re.compile(rf"</{name}\b[^>]*+>", re.I)).search(page, at)
            at = found.end() if found else size
            continue
        if name in VOID or empty:
            continue
        if name in CLOSED_BY:
            place = min((opened[n][-1] for n in CLOSED_BY[name] if opened[n] and opened[n][-1] > last(*AROUND[name])), default=0)
            if place:
                close(place)
        if name in BLOCK and opened["p"] and opened["p"][-1] > last("td", "th", "button"):
            close(opened["p"][-1])
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
        tokens = [set(_WORD.findall(t)) for t in _CAMEL.sub("-", names).lower().split()]
        words = {w for t in tokens for w in t}
        step = out.path[stack[-1]], name + ("." + ".".join(sorted(words)) if words else "")
        out.parent.append(stack[-1])
        out.name.append(name)
        out.path.append(paths.setdefault(step, len(paths) + 1))
        sure = name in HINTING_TAGS or any(t & HINTS and t <= HINTS | PLAIN for t in tokens)
        out.hinted.append((2 if sure else int(bool(words & HINTS))) if name in HINTABLE else 0)
        opened[name].append(len(stack))
        stack.append(len(out.name) - 1)
    return out


def path_ratios(page: Page, nodes: list[tuple[int, str]]) -> list[float]:
    """The fused ratio of the path of each text node.

    Text length and punctuation are added up per root-to-leaf tag path and divided by the path's number of nodes.  The two
    ratios are smoothed over page order with a Gaussian window and fused by their product with the text's own share.
    """
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for e, text in nodes:
        p = page.path[e]
        length[p] += len(text)
        marks[p] += len(_PUNCTUATION.findall(text))
        count[p] += 1
    ratio = [(length[p] / count[p], (1 + marks[p]) / count[p]) for p in (page.path[e] for e, _ in nodes)]
    window = [math.exp(-(d * d) / 2) for d in range(-2, 3)]

    def smooth(which: int, i: int) -> float:
        near = [(window[d + 2], ratio[i + d][which]) for d in range(-2, 3) if 0 <= i + d < len(ratio)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    fused: dict[int, float] = defaultdict(float)
    for i, (e, text) in enumerate(nodes):
        p = page.path[e]
        fused[p] += len(text) / length[p] * math.log1p(ratio[i][0]) * math.log1p(smooth(0, i) * smooth(1, i))
    return [fused[page.path[e]] for e, _ in nodes]


def followed_hints(page: Page, nodes: list[tuple[int, str]], ratios: list[float]) -> list[bool]:
    """Of each element, whether it or one above is boilerplate.

    Elements that say so (menus, footers) are, unless an article lies in them.  Hints (forms, headers and the words of classes,
    ids and roles of containers) are followed only where enough text remains: the weight, length times ratio, of all that nothing hints
    at and that lies outside must be a tenth of the weight inside.  So a wrapper with a misleading name keeps its article, and
    a discussion longer than its article goes.  A name that holds other words besides is followed only where the ratio is low,
    too, and no paragraph, heading or list item lies inside.  A header in an article, or with the heading of the text that follows, is no hint.
    """
    n = len(page.name)
    own, rich, size = [0.0] * n, [0.0] * n, [0.0] * n
    for (e, text), r in zip(nodes, ratios):
        own[e] += len(text) * r
        size[e] += len(text)
    for e in range(n):
        rich[e] = float(page.name[e] in ("article", "main"))
    weight, articles, size = page.sums(own), page.sums(rich), page.sums(size)
    proper = page.sums([float(x in PARAGRAPHS) for x in page.name])
    in_article = [False] * n
    for e in range(1, n):
        in_article[e] = in_article[page.parent[e]] or page.name[e] in ("article", "main")
    headed = page.sums([float(x in ("h1", "h2")) for x in page.name])
    paragraphs = page.sums([float(x in ("p", "h1", "article", "main", "blockquote", "pre", "li")) for x in page.name])
    article_weight = sum(weight[e] for e in range(1, n) if page.name[e] in ("article", "main") and not in_article[page.parent[e]])
    hint, strong = list(page.hinted), [x in BOILERPLATE_TAGS for x in page.name]
    for e in range(1, n):
        strong[e] = strong[e] and not articles[e]
        if hint[e] == 1:
            hint[e] = 0 if proper[e] or weight[e] * size[0] >= 0.5 * weight[0] * size[e] else 1
        if page.name[e] == "header" or hint[e] and headed[e]:
            # The heading of a text: a title block with little else.
            hint[e] = hint[e] and not (in_article[e] or headed[e] and page.name[e] != "header" and paragraphs[e] <= headed[e] + 1)
    children: dict[int, list[int]] = defaultdict(list)
    for e in range(1, n):
        children[page.parent[e]].append(e)

    def released(e: int) -> float:
        """Weight under an element that no hint below it claims."""
        total, todo = 0.0, [e]
        while todo:
            x = todo.pop()
            total += own[x]
            todo += [c for c in children[x] if not (hint[c] or strong[c])]
        return total

    # Hints are settled from the outside in: what an ignored one releases counts as text without hints for those after it.
    free, out = released(0), [False] * n
    for e in range(1, n):
        if out[page.parent[e]] or strong[e]:
            out[e] = True
        elif hint[e]:
            beside_article = article_weight > LEFT_OVER * weight[e] and not in_article[e] and not articles[e]
            short = not free and not paragraphs[e] and weight[e] < 0.5 * weight[0]
            out[e] = beside_article or short or free > 0 and free >= LEFT_OVER * weight[e] or not weight[e] and not articles[e]
            if not out[e]:
                free += released(e)
    return out


def main_text(page: str | None) -> str:
    """The article of one page; blocks on lines of their own.

    Tag paths whose fused ratio (`path_ratios`) lies above the mean less half a deviation, both over text, or above half the
    mean (of two paths alike, one always lies under the first bound) carry the content.  A followed hint weakens a path's ratio
    and an article or main element strengthens it; neither decides alone.  The smallest container of all content nodes gives
    the blocks, so that headings and short paragraphs stay: the article or main around it if there is one, a div or the page
    otherwise, never a list, table or section of the text, and the block around it that holds its h1.  In it, boilerplate and
    groups of links without content or a heading of their own are left out, and an imprint at the end; the only article of a page is
    the container, whatever stands beside it.  Where only the page holds all content, so are wrappers without content and what
    stands before or after it.
    """
    tree = parsed(page or "")
    n = len(tree.name)
    nodes = [(e, " ".join(text.split())) for e, _, text in tree.leaves if not text.isspace()]
    if not nodes:
        return ""
    ratios = path_ratios(tree, nodes)
    gone = followed_hints(tree, nodes, ratios)
    place, seen, sizes = {}, [math.inf] * n, [0.0] * n
    for i, (e, text) in enumerate(nodes):
        place.setdefault(e, i)
        sizes[e] += len(text)
    for e in range(n - 1, -1, -1):
        seen[e] = min(seen[e], place.get(e, math.inf))
        if e:
            seen[tree.parent[e]] = min(seen[tree.parent[e]], seen[e])
    sizes, passed = tree.sums(sizes), [0]
    for _, text in nodes:
        passed.append(passed[-1] + len(text))
    marked, linked = [False] * n, [False] * n
    for e in range(1, n):
        marked[e] = marked[tree.parent[e]] or tree.name[e] in ("article", "main")
        rights = not marked[e] and tree.name[e] in BLOCK and 0 < sizes[e] <= 300 and passed[int(seen[e])] >= 0.8 * passed[-1] and _RIGHTS.match(nodes[int(seen[e])][1])
        gone[e] = gone[e] or gone[tree.parent[e]] or bool(rights)
        linked[e] = linked[tree.parent[e]] or tree.name[e] == "a"
    scores = [r * (HINTED if gone[e] else MARKED if marked[e] else 1.0) for (e, _), r in zip(nodes, ratios)]
    kept = [(s, len(text)) for s, (e, text) in zip(scores, nodes) if not gone[e]]
    total = sum(size for _, size in kept)
    if not total:
        return ""
    mean = sum(s * size for s, size in kept) / total
    deviation = math.sqrt(sum((s - mean) ** 2 * size for s, size in kept) / total)
    bound = min(mean - 0.5 * deviation, 0.5 * mean)
    carries, chars, link_chars = [0.0] * n, [0.0] * n, [0.0] * n
    for s, (e, text) in zip(scores, nodes):
        carries[e] += s >= bound and not gone[e]
        chars[e] += len(text)
        link_chars[e] += len(text) if linked[e] else 0
    carries, chars, link_chars = tree.sums(carries), tree.sums(chars), tree.sums(link_chars)
    nested = [False] * n
    for e in range(1, n):
        nested[e] = nested[tree.parent[e]] or tree.name[tree.parent[e]] == "article"
    only = [e for e in range(1, n) if tree.name[e] == "article" and chars[e] and not gone[e] and not nested[e]]
    parts = [tree.sums([float(x in names) for x in tree.name]) for names in (("h1", "h2"), ("p",))]
    sole = len(only) == 1 and carries[only[0]] and (chars[only[0]] >= ONLY_ARTICLE * chars[0] or parts[0][only[0]] and parts[1][only[0]])
    root = only[0] if sole else max(e for e in range(n) if carries[e] == carries[0])
    above = [root]
    while above[-1]:
        above.append(tree.parent[above[-1]])
    named = [e for e in above if tree.name[e] in ("article", "main")]
    root = named[0] if named else next((e for e in above if tree.name[e] in HOLDERS), 0)
    titles = tree.sums([float(tree.name[e] == "h1" and not gone[e]) for e in range(n)])
    if not named and not titles[root]:
        around = next((e for e in above if titles[e]), 0)
        root = around if tree.name[around] not in ("body", "html", "") else root
    whole = tree.name[root] in ("body", "html", "")
    first = [s >= bound and not gone[e] for s, (e, _) in zip(scores, nodes)]
    low, high = first.index(True), len(first) - 1 - first[::-1].index(True)
    inside = [False] * n
    heads = tree.sums([float(x in HEADINGS) for x in tree.name])
    titled, sibling = [False] * n, [0] * n  # a list right after a heading
    for e in range(1, n):
        before_ = sibling[tree.parent[e]]
        titled[e] = titled[tree.parent[e]] or tree.name[e] in ("ul", "ol", "dl") and before_ > 0 and tree.name[before_] in HEADINGS
        sibling[tree.parent[e]] = e
    for e in range(n):
        if e == root:
            inside[e] = True
        elif e and inside[tree.parent[e]] and not gone[e]:
            bare = not carries[e] and chars[e] > 0
            links = bare and link_chars[e] > 0.5 * chars[e] and tree.name[e] in HINTABLE and not titled[e]
            beside = whole and bare and tree.name[tree.parent[e]] in ("body", "html", "") and tree.name[e] not in ("body", "html")
            before = seen[e] < low
            outer = beside and not (before and heads[e] and tree.name[e] in HEADINGS) and (tree.name[e] in WRAPPERS or before or seen[e] > high)
            inside[e] = not (links or outer)
    blocks: dict[int, list[str]] = {}
    i = -1
    for e, block, text in tree.leaves:
        i += not text.isspace()
        if inside[e] and not (whole and tree.name[e] in ("body", "html", "") and not low <= i <= high):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page: the whole article, decoded; '' for pages without one (null and empty pages too);
    no rows for an empty table.  Left out whatever stands in them: the elements of RAW (scripts, styles, drawings, form fields,
    media, annotations of formulas; a formula's own text stays).

    Pages are independent, so nothing is shuffled.  Rows that repeat an id are all returned; other columns are not read.  Time and memory follow
    the length of a page, whatever is left open in it and however deep it nests.
    """
    schema = pa.schema([("c_id", pa.int64()), ("c_url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [main_text(page.as_py()) for page in batch.column("c_html")]
                yield pa.RecordBatch.from_arrays([batch.column("c_id"), batch.column("c_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    read = pages.select(F.col(id_col).cast("long").alias("c_id"), F.col(url_col).cast("string").alias("c_url"), F.col(html_col).cast("string").alias("c_html"))
    return read.mapInArrow(run, "c_id long, c_url string, text string, n_chars long").select(F.col("c_id").alias(id_col), F.col("c_url").alias(url_col), "text", "n_chars")
