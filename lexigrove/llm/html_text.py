"""Main text of web pages by tag-path ratios.

A page is read in one pass into text leaves, each with its path from the root (tags with their first class). For every
path, text length outside links, punctuation, leaves and link text are summed over the page. A path's ratio is its text
per leaf, raised by its punctuation per leaf; ratios are smoothed along the leaves in page order, and fused with the ratio
of the path of the enclosing element, so that a short heading shares the standing of the section it opens. Leaves whose
fused ratio reaches ``THRESHOLD`` of the mean over all text are content, and are not in a list of links.

Before that, elements that are never main text go: by their tag (scripts, styles, menus, footers, forms), or by a word in
their class, id or role (adverts, notices, sidebars, reader comments), unless they enclose the article or most of the
page's prose. Inside an article or main element a word in class or id is a hint only: the element goes if it also holds
more link text than other text, or if its text per leaf, raised by its punctuation, is under ``THRESHOLD`` of that of the
article; ``header`` is no hint there. Article and main elements narrow the page down only if together they hold ``ROOT_SHARE`` of its prose (text
with punctuation, outside links and elements with such a word); the ratios then decide inside them, where the mean counts
as ``PROSE`` at most, so that one very long leaf does not put out plain paragraphs. Otherwise the ratios decide over the
whole page.

Defined results: null or empty html gives an empty text; unclosed tags, comments and quotes end with the page; markup in
upper case is read alike; a line break element counts as white space; repeated rows give equal texts; a null page id or
url is kept. Columns ``text`` and ``n_chars`` replace those of the input.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm.common import free_name

THRESHOLD = 0.25
ROOT_SHARE = 0.5
PROSE = 160  # the ratio of leaves of 80 characters and one mark
#: Names and values as HTML delimits them: a quote opens a value only directly after the equals sign.
VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|"
    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{VALUE})?)?)*+)(>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({VALUE})?)?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody"
    " td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html li dd dt td th tr tbody thead tfoot caption option optgroup legend summary figcaption".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
NOISE = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input iframe svg math object embed"
    " canvas audio video map dialog menu label fieldset title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = re.compile(
    r"(?:^|[-_\s])(?:ads?|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|submenu|sidebar\w*|side|"
    r"rail|widgets?|aside|footer\w*|colophon|copyright|masthead|topbar|header|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|form|breadcrumbs?|pagination|pager|share|sharing|social|related|recommended|"
    r"recommendations|popular|trending|comments?|commentlist|comment\w*|replies|reply|respond|disqus|discussion|toolbar|skip|paywall|tracking)"
    r"(?=$|[-_\s\d])"
)
HEADER = re.compile(r"(?:^|(?<=[-_\s]))header(?=$|[-_\s\d])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    noise: bool = False
    hinted: bool = False
    weak: bool = False  # hinted inside a main element, by words alone
    within: bool = False  # a main element
    main: bool = False
    holds_main: bool = False
    links: bool = False
    prose: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)  # of paths
    leaves: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def read(page: str) -> Page:
    """Leaves and elements of a page, with the end tags that HTML implies."""
    out = Page()
    paths: dict[tuple[int, str], int] = {}
    out.elements.append(Element("", -1, 0))
    out.parents.append(-1)
    stack, open_, block, at = [0], {}, 0, 0

    def pop_to(tags, stop=()) -> bool:
        if not any(open_.get(t) for t in tags):
            return False
        for i in range(len(stack) - 1, 0, -1):
            tag = out.elements[stack[i]].tag
            if tag in tags:
                for e in stack[i:]:
                    open_[out.elements[e].tag] -= 1
                del stack[i:]
                return True
            if tag in stop:
                return False
        return False

    lower = None
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            out.leaves.append((stack[-1], block, text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[4] != ">":  # cut off by the end of the page
            break
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            out.leaves.append((stack[-1], block, " "))
        if m[1]:
            if tag == "p" or tag in BLOCK:
                pop_to((tag,))
            else:
                pop_to((tag,), BLOCK)
            continue
        if tag in CLOSES_P:
            pop_to(("p",), ("button", "table", "td", "th", "caption", "object"))
        if tag in SIBLINGS:
            pop_to(*SIBLINGS[tag])
        attributes = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        parent = out.elements[stack[-1]]
        classes = attributes.get("class", "").split()
        key = (parent.path, f"{tag}.{classes[0]}" if classes else tag)
        if (path := paths.get(key)) is None:
            path = paths[key] = len(out.parents)
            out.parents.append(parent.path)
        names = " ".join(CAMEL.sub("-", attributes[k]) for k in ("class", "id") if k in attributes).lower()
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        within = parent.main or parent.within
        if within:
            names = HEADER.sub("", names)
        word = bool(names and WORDS.search(names))
        element = Element(tag, stack[-1], path, tag in NOISE or hidden, role in ROLES or word, word and within and role not in ROLES, within)
        element.main = (tag in ("article", "main") or role in ("main", "article")) and not element.hinted
        element.links = parent.links or tag == "a"
        if tag == "header" and not any(out.elements[e].main for e in stack):
            element.hinted = True
        out.elements.append(element)
        index = len(out.elements) - 1
        if element.main:
            e = stack[-1]
            while e > 0 and not out.elements[e].holds_main:
                out.elements[e].holds_main = True
                e = out.elements[e].parent
        if tag in VOID:
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else (re.compile(rf"</{tag}", re.I).search(page, at) or re.match("", page)).start() or -1
            if end < 0:
                break
            at = end
            stack.append(index)
            open_[tag] = open_.get(tag, 0) + 1
            continue
        stack.append(index)
        open_[tag] = open_.get(tag, 0) + 1
    return out


def _gone(page: Page) -> list[bool]:
    """Elements that are no main text, or are inside one."""
    weights = [0] * len(page.elements)
    for e, _, text in page.leaves:
        if not page.elements[e].links:
            weights[e] += len(text) * bool(PUNCTUATION.search(text))
    shut = [False] * len(page.elements)  # inside what can never be text
    for i, x in enumerate(page.elements[1:], 1):
        shut[i] = x.noise or shut[x.parent]
    for i in range(len(page.elements) - 1, 0, -1):
        page.elements[i].prose += 0 if shut[i] else weights[i]
        page.elements[page.elements[i].parent].prose += page.elements[i].prose
    everything = page.elements[0].prose + weights[0]
    marked = _boilerplate(page, shut) if any(x.weak for x in page.elements) else ()
    gone = [False] * len(page.elements)
    for i, x in enumerate(page.elements[1:], 1):
        spared = x.tag in ("html", "body") or x.holds_main or (x.prose > 0.6 * everything and not _in_main(page, i)) or (x.weak and i not in marked)
        gone[i] = gone[x.parent] or (x.noise and not x.holds_main) or (x.hinted and not spared)
    return gone


def _boilerplate(page: Page, shut: list[bool]) -> set[int]:
    """Weakly hinted elements that their links or their text per leaf mark as boilerplate, against the main element around."""
    count = len(page.elements)
    length, marks, number, linked, top = [0] * count, [0] * count, [0] * count, [0] * count, [0] * count
    for e, _, text in page.leaves:
        if not shut[e] and (n := len(text.strip())):
            number[e] += 1
            if page.elements[e].links:
                linked[e] += n
            else:
                length[e] += n
                marks[e] += len(PUNCTUATION.findall(text))
    for i in range(count - 1, 0, -1):
        above = page.elements[i].parent
        for sums in (length, marks, number, linked):
            sums[above] += sums[i]
    ratio = [a / n * (1 + m / n) if n else 0.0 for a, m, n in zip(length, marks, number, strict=True)]
    for i, x in enumerate(page.elements[1:], 1):
        top[i] = top[x.parent] or (i if x.main else 0)
    return {i for i, x in enumerate(page.elements) if x.weak and (linked[i] > length[i] or ratio[i] < THRESHOLD * ratio[top[i]])}


def _in_main(page: Page, i: int) -> bool:
    while i > 0:
        if page.elements[i].main:
            return True
        i = page.elements[i].parent
    return False


def _roots(page: Page, gone: list[bool]) -> list[int]:
    """For each element, the outermost article or main element around it that holds enough of the text, or 0.

    Empty if those elements hold less than ``ROOT_SHARE`` of the page's prose (of its text outside links, if it has none);
    what stands beside them in an element with a boilerplate word is not counted.
    """
    top, size, doubted = [0] * len(page.elements), {}, [False] * len(page.elements)
    for i, x in enumerate(page.elements[1:], 1):
        top[i] = top[x.parent] or (i if x.main and not gone[i] else 0)
        doubted[i] = not top[i] and (doubted[x.parent] or (x.hinted and not x.holds_main))
    for e, _, text in page.leaves:
        if top[e] and not gone[e]:
            size[top[e]] = size.get(top[e], 0) + len(text.strip())
    least = 0.25 * max(size.values(), default=0)
    kept = {k for k, n in size.items() if n >= least and n > 0}
    prose, plain = [0, 0], [0, 0]  # of the page, of the roots
    for e, _, text in page.leaves:
        if not gone[e] and not doubted[e] and not page.elements[e].links:
            n, inside = len(text.strip()), top[e] in kept
            marked = n * bool(PUNCTUATION.search(text))
            prose[0] += marked
            plain[0] += n
            prose[1] += marked * inside
            plain[1] += n * inside
    whole, held = prose if prose[0] else plain
    return [t if t in kept else 0 for t in top] if kept and held >= ROOT_SHARE * whole else []


def content(page: Page) -> list[tuple[int, str]]:
    """(block, text) of the leaves that are main text, in page order."""
    gone = _gone(page)
    roots = _roots(page, gone)
    leaves = [x for x in page.leaves if not gone[x[0]] and (not roots or roots[x[0]])]
    count = len(page.parents)
    length, marks, number, linked = [0.0] * count, [0.0] * count, [0] * count, [0.0] * count
    for e, _, text in leaves:
        n = len(text.strip())
        if not n:
            continue
        p, inside = page.elements[e].path, page.elements[e].links
        while p > 0:  # a leaf counts for its own path and the enclosing ones, up to the body
            length[p] += 0 if inside else n
            linked[p] += n if inside else 0
            marks[p] += 0 if inside else len(PUNCTUATION.findall(text))
            number[p] += 1
            p = page.parents[p]
            if page.parents[p] <= 0 or page.parents[page.parents[p]] < 0:
                break
    ratio = [length[p] / number[p] * (1 + marks[p] / number[p]) if number[p] else 0.0 for p in range(count)]
    own = [ratio[page.elements[e].path] for e, _, _ in leaves]
    smooth = [(own[max(0, i - 1)] + 2 * r + own[min(len(own) - 1, i + 1)]) / 4 for i, r in enumerate(own)]
    by_path: dict[int, list[float]] = {}
    for (e, _, _), s in zip(leaves, smooth, strict=True):
        by_path.setdefault(page.elements[e].path, []).append(s)
    sizes = [len(t.strip()) for _, _, t in leaves]
    mean = sum(a * b for a, b in zip(own, sizes, strict=True)) / max(1, sum(sizes))
    least = THRESHOLD * (min(mean, PROSE) if roots else mean)
    chosen = {}
    for p, values in by_path.items():
        above = page.parents[p]
        fused = max(sum(values) / len(values), ratio[p], ratio[above] if above > 0 else 0.0)
        outer = max(p, 0)
        for _ in range(3):  # the list or block that a link stands in
            if length[outer] == 0 and page.parents[outer] > 0:
                outer = page.parents[outer]
        listing = linked[outer] > 2 * length[outer] and linked[outer] > 0
        chosen[p] = not listing and fused >= least
    return [(b, t) for e, b, t in leaves if chosen[page.elements[e].path]]


def main_text(page: str) -> str:
    """Blocks of the main text, white space made single blanks, joined by line breaks."""
    blocks: list[list[str]] = []
    last = None
    for block, text in content(read(page)):
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(html.unescape(text))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars, without the html."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, F.coalesce(F.col(html_col), F.lit("")).alias(free_name(kept, "h_html")))
    schema = T.StructType([*rows.select(*kept).schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(kept))]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*kept, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
