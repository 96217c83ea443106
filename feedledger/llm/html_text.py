"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Elements that are not article text (menus,
forms, comments; by tag, role or class) are marked, and their blocks dropped unless the mark is
excused by what the element holds. Of the others the first pass decides by stop-word density,
length and link density (by the latter two where stop words can't tell, as in another script);
the second gives short and doubtful blocks the label of their nearest decided neighbours.
Inside an article element a block is taken for article text unless it is mostly links; where
such elements hold the top heading or most of a page's good text, what stands outside of them
is not. A page of short blocks alone keeps those that are not mostly links.
"""

import html
import re
from bisect import bisect
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare_workers

# Common words of the four languages.
STOP_WORDS = frozenset("""
the of and to in a is that for it was on are as with be by this from or an not which have at
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an
de la que el en y a los se del las un por con no una su para es al lo como más
de la le et les des en un du une que est dans qui par pour au sur pas ne ce se son
""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)[^>]*+>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"\w+")
_OTHER_SCRIPT = re.compile(r"[^\W\d_A-Za-z\u00c0-\u024f]")
_WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")  # a character says as much as three letters
_CONTAINER = re.compile(r"<(/?)(nav|aside|footer|header|form|menu|dialog)\b", re.I)

# Elements by role in a page.
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
DROPPED = frozenset("nav aside footer form head menu dialog button select svg canvas object audio video "
                    "fieldset datalist map".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl
    dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
    main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr
    ul""".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = re.compile(r"""^(?:ad(?:s|box|slot|unit|banner|container)?|advert\w*|banner\w*|sponsor\w*|promo\w*|sidebar\w*|nav|navbar|navigation|
    menus?|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|
    newsletter|subscribe|subscription|comment(?!ar)\w*|disqus|replies|share|sharing|social|related|
    recommended|recommendations|widgets?|pager|pagination|toolbar|copyright|login|signup|search|skip)$""", re.X)
_COMMENTS = re.compile(r"^(?:comment(?!ar)\w*|disqus|replies)$")
#: Marks that a whole page may stand in.
_WRAPPING = frozenset("form fieldset".split())
_WRAPPING_NAMES = re.compile(r"^(?:header|masthead|modals?|popups?|overlay|login|signup|search|skip|toolbar|widget\w*)$")
_WRAPPING_ROLES = frozenset("banner search dialog alertdialog form".split())
#: What a container that lacks its end tag is closed by.
_SECTIONS = frozenset("article main section header footer aside nav h1".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu "
                   "menubar toolbar".split())
_MAIN = frozenset("article entry post content story main body text".split())
#: Parts of a name that say what an element has beside its text.
_MODIFIERS = frozenset("with has no".split())
#: What an opening tag ends without a closing tag, up to the element that holds both.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
         "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}


#: Kinds of marks: a wrapper is excused if it holds the article, or without one most of the
#: text; a part if it holds an article with most of the text; comments only if they hold a main
#: element; what a tag says never.
WRAPPER, PART, COMMENTS, NEVER = 1, 2, 3, 4


@dataclass
class Block:
    text: str
    linked: int = 0
    links: int = 0
    heading: bool = False
    item: bool = False
    top: bool = False
    marks: tuple[int, ...] = ()
    region: int = -1
    inside: bool = False
    told: tuple[int, int] = (0, 0)
    label: str = field(default="", compare=False)


def _mark(tag: str, attrs: dict[str, str]) -> int:
    """The kind of mark that an element's tag, role and names give it; 0 without one."""
    if tag in _WRAPPING:
        return WRAPPER
    if tag in DROPPED:
        return NEVER
    if tag in ("html", "body"):
        return 0
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()
    parts = [set(re.split(r"[_-]+", n)) for n in names]
    if tag in ("main", "article"):
        if tag == "article" and any(_COMMENTS.match(min(p)) and len(p) == 1 or "comment" in p and not p & _MODIFIERS
                                    for p in parts):
            return COMMENTS
        return PART if any(n in ("ad", "advert", "sidebar", "related") for n in names) else 0
    kind = 0
    role = attrs.get("role", "").lower()
    if role in _ROLES:
        kind = WRAPPER if role in _WRAPPING_ROLES else NEVER
    elif "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        kind = PART
    for of in parts:
        hits = {p for p in of if BOILERPLATE.match(p)}
        if not hits or of & _MODIFIERS or hits == {"header"} and of & _MAIN:
            continue
        if any(map(_COMMENTS.match, hits)):
            kind = max(kind, COMMENTS)
        else:
            kind = max(kind, WRAPPER if all(map(_WRAPPING_NAMES.match, hits)) else PART)
    return kind


def _excused(found: list[Block], marks: list[int], regions: list[tuple[tuple[int, ...], bool]],
             short: int = 70) -> tuple[set[int], set[int]]:
    """The marks that drop nothing, and the article regions that no mark drops."""
    out = {m for of, main in regions if main for m in of if marks[m] == COMMENTS}
    open_ = [b for b in found if all(marks[m] < COMMENTS or m in out for m in b.marks)]
    total, held, texts, longest = 0, [0] * len(marks), [0] * len(marks), [0] * len(marks)
    size = [0] * len(regions)
    for b in open_:
        n = len(b.text)
        total += n
        if b.region >= 0:
            size[b.region] += n
        for m in b.marks:
            texts[m] += n - b.linked
            longest[m] = max(longest[m], n - b.linked)
            if b.region >= 0 and m in regions[b.region][0]:
                held[m] += n
    out |= {m for m, kind in enumerate(marks) if kind == PART and 2 * held[m] > total}
    whole = [r for r, (of, _) in enumerate(regions) if size[r] and all(marks[m] == WRAPPER or m in out for m in of)]
    if whole:
        out |= {m for m in regions[max(whole, key=lambda r: size[r])][0] if marks[m] == WRAPPER}
    else:
        out |= {m for m, kind in enumerate(marks) if kind == WRAPPER and 2 * texts[m] > total and longest[m] >= short}
    return out, {r for r in whole if all(m in out for m in regions[r][0])}


def blocks(page: str) -> tuple[list[Block], bool]:
    """The blocks outside dropped elements, and whether the page has an article element."""
    found: list[Block] = []
    marks: list[int] = []
    regions: list[tuple[tuple[int, ...], bool]] = []  # marks around an article, whether it is a main element
    stack: list[tuple[str, tuple[int, ...], int]] = []  # tag, marks, region
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for m in _CONTAINER.finditer(page):
        (ends if m[1] else starts).setdefault(m[2].lower(), []).append(m.start())
    parts: list[str] = []
    state = {"link": 0, "linked": 0, "links": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            tags = {t for t, _, _ in stack}
            found.append(Block(text, state["linked"], state["links"], bool(tags & HEADINGS), "li" in tags,
                               "h1" in tags, *(stack[-1][1:] if stack else ())))
        state["linked"] = state["links"] = 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state["link"]:
                state["linked"] += len(" ".join(html.unescape(text).split()))

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                flush()
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def unclosed(tag: str, at: int) -> bool:
        """Whether the end tags behind ``at`` are all taken by later elements of that tag."""
        later, own = ends.get(tag, []), starts.get(tag, [])
        return len(later) - bisect(later, at) <= len(own) - bisect(own, at)

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at:token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            if token[0].startswith("<![CDATA["):
                add(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        if token["end"]:
            if tag == "a":
                state["link"] = 0
            elif tag in BLOCKS or any(s[0] == tag for s in stack):
                flush()
                close((tag,), ())
            continue
        if tag == "a":
            state["link"] = 1
            state["links"] += 1
            continue
        if tag == "br":
            add(" ")
            continue
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(token["attrs"])}
        kind = _mark(tag, attrs)
        if tag not in BLOCKS and not kind or tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        flush()
        if tag in BLOCKS:
            close(("p",), ("article", "section", "div", "td", "li", "blockquote", "main", "body"))
        if tag in _ENDS:
            close(*(tuple(names.split()) for names in _ENDS[tag]))
        if tag in _SECTIONS:
            for i, (name, _, _) in enumerate(stack):
                if name in starts and unclosed(name, token.start() - 1):
                    del stack[i:]
                    break
        _, around, region = stack[-1] if stack else ("", (), -1)
        if tag == "header" and region < 0:
            kind = max(kind, WRAPPER)
        if kind:
            around = (*around, len(marks))
            marks.append(kind)
        main = tag == "main" or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        if region < 0 and not kind and (tag == "article" or main):
            region = len(regions)
            regions.append((around, main))
        stack.append((tag, around, region))
    for tag, around, _ in stack:
        # What the page's end leaves open may hold the rest of it.
        if around and tag in starts and marks[around[-1]] == NEVER and unclosed(tag, len(page)):
            marks[around[-1]] = WRAPPER
    flush()
    excused, whole = _excused(found, marks, regions)
    found = [b for b in found if excused.issuperset(b.marks)]
    for b in found:
        b.inside = b.region in whole
    return found, any(b.inside for b in found)


def _telling(text: str) -> tuple[int, int]:
    """Words and stop words of a text in Latin script; none in others."""
    if not text.isascii() and 2 * len(_OTHER_SCRIPT.findall(text)) > len(text) - text.count(" "):
        return 0, 0
    words = _WORD.findall(text.lower())
    return len(words), sum(map(STOP_WORDS.__contains__, words))


def _first_pass(b: Block, has_article: bool, spoken: bool, short: int, long: int, low: float, high: float,
                links: float) -> str:
    density = b.linked / len(b.text)
    if has_article:
        if not b.inside:
            return "bad"
        return "bad" if density > links and b.item and b.links else "good"
    if density > links:
        return "bad"
    size = len(b.text) + (0 if b.text.isascii() else 2 * len(_WIDE.findall(b.text)))
    if size < short:
        return "bad" if b.linked else "short"
    words, stops = b.told
    if not spoken or not words:
        return "good" if size > long else "near"
    stop = stops / words
    if stop >= high:
        return "good" if size > long else "near"
    return "near" if stop >= low else "bad"


def classify(found: list[Block], has_article: bool, *, short: int = 70, long: int = 200, low: float = 0.15,
             high: float = 0.25, links: float = 0.5, heading_reach: int = 200, spoken: float = 0.03) -> None:
    """Set each block's label to ``good`` or ``bad``. Stop words decide where they make up a
    share of at least ``spoken`` of the page's words outside links."""
    for block in found:
        block.told = _telling(block.text)
    words, stops = (sum(c) for c in zip(*(b.told for b in found if not b.linked), (0, 0), strict=True))
    rest = (stops >= spoken * words > 0, short, long, low, high, links, heading_reach)
    _label(found, False, *rest)
    if has_article:
        outside = [b for b in found if not b.inside and b.label == "good"]
        _label(found, True, *rest)
        titled = any(b.top for b in found if b.inside) and not any(b.top for b in found if not b.inside)
        if not titled and sum(len(b.text) for b in outside) > sum(len(b.text) for b in found if b.label == "good"):
            # The articles are a minor part of the page's text.
            for block in outside:
                block.label = "good"
    elif not any(b.label == "good" for b in found):
        for block in found:
            block.label = "good" if block.linked <= links * len(block.text) else "bad"


def _label(found: list[Block], has_article: bool, spoken: bool, short: int, long: int, low: float, high: float, links: float,
           heading_reach: int) -> None:
    first = [_first_pass(b, has_article, spoken, short, long, low, high, links) for b in found]
    # Nearest decided labels on either side; doubtful ("near") blocks count next to short ones.
    before, last = [], "bad"
    for label in first:
        before.append(last)
        last = label if label in ("good", "bad") else last
    after, last = [], "bad"
    for label in reversed(first):
        after.append(last)
        last = label if label in ("good", "bad") else last
    after.reverse()
    final = []
    for label, a, b in zip(first, before, after, strict=True):
        if label == "short":
            label = "good" if a == b == "good" else "bad"
        elif label == "near":
            label = "bad" if a == b == "bad" else "good"
        final.append(label)
    # A heading that stands just above article text belongs to it.
    for i, block in enumerate(found):
        if block.heading and first[i] in ("short", "near") and final[i] == "bad":
            distance, j = 0, i + 1
            while j < len(found) and distance <= heading_reach:
                if final[j] == "good":
                    final[i] = "good"
                    break
                distance += len(found[j].text)
                j += 1
    for block, label in zip(found, final, strict=True):
        block.label = label


def main_text(page: str | None) -> str:
    """The blocks of article text, one per line."""
    found, has_article = blocks(page or "")
    classify(found, has_article)
    return "\n".join(b.text for b in found if b.label == "good")


def any_text(page: str | None) -> str:
    """The main text, or all blocks outside dropped elements where there is none."""
    return main_text(page) or "\n".join(b.text for b in blocks(page or "")[0])


def extract_text(pages: DataFrame, *, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
                 text: str = "text") -> DataFrame:
    """The columns of ``keep`` and the main text (empty if there is none), row by row.

    Null html counts as empty. Each page is worked alone, in the task that scans it.
    """
    prepare_workers(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_column).cast("string"))
    fields = [*rows.schema.fields[:-1]]

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(p.as_py()) for p in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*b.schema.names[:-1], text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{schema}, `{text}` string")
