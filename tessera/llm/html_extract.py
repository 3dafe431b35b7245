"""HTML extraction (operator 4): the main text of a page, by scoring its tree.

Every block of text passes points for its length and its commas to the elements that
hold it: in full to the nearest container, by half to the next, then by less. An
element's points are discounted by the share of its text that is links. The container
with the most points is kept, as are its siblings that score nearly as well, or that are
paragraphs of prose with few links, or headings right before what is kept. Where
containers of few links that score nearly as well stand further off, the element that
holds them and the winner is kept, or, if that is the body, its children that hold them.
An <article> or <main> that holds the winner takes its place, with all that is inside.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut wherever they stand. A <form>, and what only its class or id tells to be
such, isn't cut if it holds the page's <main>, all its <article>s or one and most of the
points, or, without those, most of the points (a form: and two paragraphs of prose;
comments: only a <main>), nor if nothing would be left. Plain sections of an article and
inline elements are cut by few and whole names.

Names of comments, of paragraphs and of sections of an article count only as a whole.

A null or empty page, and a page without text, gives the empty text. Markup may be
unclosed, cut off or nested wrongly. Rows are independent, so repeated rows give repeated
results; only the three named columns are read, and an empty table gives an empty one. A page is held by one task at a time, in
memory and time that are linear in its length; nothing of a page is capped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>"
    r"|<[!?/][^<>]*>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")

# Names of HTML elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var br wbr img nobr".split()
)
CUT = frozenset(
    "nav footer aside button select input textarea script style noscript template iframe object "
    "embed svg canvas dialog menu head title audio video map fieldset datalist".split()
)
CUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split()
)
CUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|gdpr|notice\w*|"
    r"popup|modal|overlay|newsletter|subscri\w*|signup|sidebar\w*|side|aside|menu\w*|nav\w*|breadcrumb\w*|"
    r"footer\w*|foot|masthead|social\w*|shar(?:e|ing)\w*|"
    r"related\w*|recommend\w*|pagination|pager|toolbar|skip\w*|login|search\w*|widget\w*|tags?|hidden|"
    r"site-header|page-header|header)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Class names that say what stands beside an element, or how it flows.
MODIFIER = re.compile(r"(?:has|no|with|without|overflow)[_-].*|.*[_-](?:has|no|with|without)[_-].*", re.IGNORECASE)
#: Whole names of readers' comments: no element of such a name is the page for its points.
COMMENT_NAMES = re.compile(
    r"(?:(?:post|article|page|entry|blog|site|user|reader|guest|fb|facebook|the|all)[_-])?"
    r"(?:comments?|comment-?lists?|disqus\w*|respond|replies|reply|discussion)"
    r"(?:[_-]?(?:section|area|lists?|threads?|wrapper|wrap|container|box|form|block|body|content|items?|feed|inner|title|header|text|author|meta|\d+))*",
    re.IGNORECASE,
)
#: Names that stand for parts of a text inside an article.
OWN_PARTS = re.compile(r"discussion|related[_-](?:work|works|research|stud(?:y|ies)|literature|concepts?|topics?)", re.IGNORECASE)
#: Whole names by which a <section> of an article is cut.
SECTION_NAMES = re.compile(
    r"(?:comments?|disqus|respond|replies|ads?|advert\w*|adsense|sponsor(?:s|ed)?|promo|cookies?|gdpr|popup|modal|newsletter|"
    r"subscribe|signup|sidebar|nav|breadcrumbs?|footer|social|share|sharing|pagination|pager|login|widgets?|hidden|"
    r"(?:related|recommended)[_-](?:posts?|articles?|links?|stories|content))(?:[_-](?:section|area|list|wrapper|container|box|bar))?",
    re.IGNORECASE,
)
#: Whole names by which a paragraph is cut.
PARAGRAPH_NAMES = re.compile(
    r"notice|menu|tags?|hidden|(?:cookies?|consent|privacy|gdpr|site|ads?|advert\w*|sponsor\w*|promo\w*|newsletter|subscri\w*|skip|share|social|login|search|footer)"
    r"[_-](?:notice|banner|bar|box|message|text|label|note|links?|info|line|nav|to[_-]content|to[_-]main|disclaimer)",
    re.IGNORECASE,
)
MOST_OF_POINTS = 0.5
KEEP = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key closes an open element of the value, up to a wall.
CLOSES = {
    **{
        x: ("p",)
        for x in (
            "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
        ).split()
    },
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("tr", "thead", "tbody"),
    "tfoot": ("tr", "tbody"), "option": ("option",),
}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
ANY_WALL = frozenset("table td th article section div body html blockquote main aside header footer nav form ul ol dl".split())

#: Points for the parents of a block, nearest first.
SHARES = (1.0, 0.5, 0.25, 0.125)
LONG_TEXT = 100
MOST_FOR_LENGTH = 5.0
SIBLING_SHARE = 0.2
#: Characters from which a paragraph is prose.
LONG_PROSE = 80
PROSE_LINKS = 0.25
#: Share of the winner's points from which a container further off is a part of the same text.
NEARLY = 1 / 3


#: Why an element is cut.
BY_NAME, FORM, COMMENTS, CERTAIN = 1, 2, 3, 4


def _told(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}


def _is_cut(tag: str, attributes: str, in_article: bool) -> int:
    """CERTAIN, FORM, or BY_NAME or COMMENTS where only class and id tell it; 0 for what isn't cut."""
    if tag in CUT:
        return CERTAIN
    if tag == "form":
        return FORM
    if tag == "header" and not in_article:
        return CERTAIN
    if tag in KEEP or not attributes or not attributes.strip():
        return 0
    told = _told(attributes)
    if "hidden" in told or told.get("aria-hidden") == "true" or told.get("role", "").lower() in CUT_ROLES:
        return CERTAIN
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", told.get("style", "")):
        return CERTAIN
    if tag in HEADINGS or tag in ("a", "b", "i", "em", "strong"):
        return 0
    names = told.get("class", "") if tag == "p" else f"{told.get('class', '')} {told.get('id', '')}"
    each = [x for x in names.split() if not MODIFIER.fullmatch(x) and not (in_article and OWN_PARTS.fullmatch(x))]
    if tag in INLINE or tag == "section" and in_article:
        return BY_NAME if any(map(SECTION_NAMES.fullmatch, each)) else 0
    if any(map(COMMENT_NAMES.fullmatch, each)):
        return COMMENTS
    if tag == "p":
        return BY_NAME if any(SECTION_NAMES.fullmatch(x) or PARAGRAPH_NAMES.fullmatch(x) for x in each) else 0
    names = " ".join(each)
    if not CUT_WORDS.search(names) or in_article and re.search(r"(?:^|[\s_-])header", names) and "site" not in names:
        return 0
    return BY_NAME


def _points(text: str, links: int) -> float:
    given = 1 + text.count(",") + min(len(text) / LONG_TEXT, MOST_FOR_LENGTH)
    return given * (1 - min(1, links / len(text)))


class Page:
    """The tree of a page: parallel lists by element, and its blocks of text in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.cut, self.named = [-1], ["#root"], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        # Comments first: their <article>s aren't the page's.
        every = self.blocks
        for why in (COMMENTS, FORM, BY_NAME):
            if why in self.named and not self._cut_by_name(why) and why == BY_NAME and len(every) > len(self.blocks):
                # What is named after comments or a form rather than a footer or a menu.
                rest, self.blocks = self.blocks, every
                if not self._cut_by_name(why):
                    self.blocks = rest

    def _cut_by_name(self, why: int) -> bool:
        """Whether anything is left but for what is named, or why is another than BY_NAME. Drops the blocks of elements that are cut by name, but for those that hold the page."""
        parent, tag, n = self.parent, self.tag, len(self.parent)
        points, filled, mains, articles, prose = [0.0] * n, [False] * n, [0] * n, [0] * n, [0] * n
        for x, text, links in self.blocks:
            points[x] += _points(text, links)
            filled[x] = True
            prose[x] += tag[x] not in HEADINGS and len(text) > LONG_PROSE
        for x in range(n - 1, 0, -1):
            mains[x] += filled[x] and tag[x] == "main"
            articles[x] += filled[x] and tag[x] == "article"
            y = parent[x]
            filled[y] = filled[y] or filled[x]
            for of in (points, mains, articles, prose):
                of[y] += of[x]
        gone = [False] * n
        for x in range(1, n):
            most = points[x] > MOST_OF_POINTS * points[0]
            if mains[0] or why == COMMENTS:
                holds = mains[x] > 0
            elif articles[0]:
                holds = articles[x] == articles[0] or articles[x] > 0 and most
            else:
                holds = most and (why != FORM or prose[x] > 1)
            gone[x] = gone[parent[x]] or self.named[x] == why and not holds
        left = [b for b in self.blocks if not gone[b[0]]]
        if left or why != BY_NAME:
            self.blocks = left
            return True
        return False

    def _read(self, html: str) -> None:
        stack, parts, links = [0], [], 0
        # By depth: the nearest element that holds text of its own, and its depth. By name: the depths of what is open.
        holders, depths, opened = [0], [0], {}
        parent, tag, cut = self.parent, self.tag, self.cut
        in_link, articles, at, end = 0, 0, 0, len(html)

        def flush() -> None:
            nonlocal parts, links
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.blocks.append((holders[-1], text, links))
                parts, links = [], 0

        def pop() -> None:
            nonlocal in_link, articles
            x = stack.pop()
            holders.pop()
            depths.pop()
            opened[tag[x]].pop()
            in_link -= tag[x] == "a"
            articles -= tag[x] in ("article", "main")

        def depth_of(name: str) -> int:
            """Of the innermost open element of the name, 0 if there is none."""
            return opened[name][-1] if opened.get(name) else 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                pop()

        while at < end:
            m = MARKUP.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text and not cut[stack[-1]]:
                parts.append(text)
                if in_link:
                    links += len(text.strip())
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            inline = name in INLINE
            if not inline:
                flush()
            elif name == "br" and not cut[stack[-1]]:
                parts.append(" ")
            if m[1] or m[4]:
                if name in VOID:
                    continue
                # An inline element is closed only within the block that it is in.
                depth = depth_of(name)
                if depth > (depths[-1] if inline else 0):
                    close(depth)
                continue
            for closed in CLOSES.get(name, ()):
                depth = depth_of(closed)
                if depth:
                    walls = WALLS.get(name, ())
                    if depth > max(map(depth_of, (*walls, *ANY_WALL) if closed == "p" else walls), default=0):
                        close(depth)
            if name in VOID:
                continue
            attributes = m[3] or m[6] or ""
            parent.append(stack[-1])
            tag.append(name)
            why = _is_cut(name, attributes, articles > 0)
            # The text of inline elements isn't held apart, so that they are cut at once.
            cut.append(cut[stack[-1]] or why == CERTAIN or why > 0 and inline)
            self.named.append(0 if cut[-1] else why)
            if name in RAW:
                last = re.compile(f"</{name}\\b[^>]*>", re.IGNORECASE).search(html, at)
                at = last.end() if last else end
                continue
            if attributes.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            stack.append(len(parent) - 1)
            opened.setdefault(name, []).append(len(stack) - 1)
            holders.append(holders[-1] if inline else stack[-1])
            depths.append(depths[-1] if inline else len(stack) - 1)
            in_link += name == "a"
            articles += name in ("article", "main")
        flush()

    def main_text(self) -> str:
        parent, tag = self.parent, self.tag
        n = len(parent)
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        for x, text, links in self.blocks:
            given = _points(text, links)
            y = parent[x] if tag[x] in ("p", "pre", "blockquote", "td", "li") or tag[x] in HEADINGS else x
            for share in SHARES:
                if y < 0:
                    break
                points[y] += given * share
                y = parent[y]
            size[x] += len(text)
            linked[x] += links
        for x in range(n - 1, 0, -1):
            size[parent[x]] += size[x]
            linked[parent[x]] += linked[x]
        if not size[0]:
            return ""

        def score(x: int) -> float:
            return points[x] * (1 - linked[x] / size[x]) if size[x] else 0.0

        best = max(range(n), key=lambda x: (score(x), -x))
        kept = {best}
        y = best
        while y >= 0 and tag[y] not in ("article", "main"):
            y = parent[y]
        if y >= 0:
            best = y
        elif tag[best] not in ("body", "html", "#root"):
            prose = {parent[x] for x, t, _ in self.blocks if tag[x] == "p" and len(t) > LONG_PROSE}
            best, far = self._climbed(best, score, lambda x: linked[x] / size[x] < PROSE_LINKS, prose)
            kept |= far
        kept.add(best)
        if tag[best] not in ("body", "html", "#root"):
            least = max(2.0, SIBLING_SHARE * score(best))
            prose = {x for x, t, _ in self.blocks if tag[x] == "p" and len(t) > LONG_PROSE}
            beside = [x for x in range(1, n) if parent[x] == parent[best] and size[x]]
            for k, x in reversed(list(enumerate(beside))):
                if linked[x] / size[x] >= PROSE_LINKS:
                    continue
                if score(x) >= least or x in prose or tag[x] in HEADINGS and beside[k + 1 : k + 2] and beside[k + 1] in kept:
                    kept.add(x)
        inside = [False] * n
        for x in range(n):
            inside[x] = x in kept or parent[x] >= 0 and inside[parent[x]]
        return "\n".join(text for x, text, _ in self.blocks if inside[x])


    def _climbed(self, best: int, score: Callable[[int], float], few: Callable[[int], bool], prose: set[int]) -> tuple[int, set[int]]:
        """The highest element below the body that holds best and others nearly as good, and
        the children of body, html and root that hold more of those."""
        parent, tag, n = self.parent, self.tag, len(self.parent)
        above, y = set(), best
        while y >= 0:
            above.add(y)
            y = parent[y]
        top, far = best, set()
        #: By element above best: the name of its child that holds best.
        beside = {parent[x]: tag[x] for x in above if x}
        # By element: the nearest element around it that holds best, and the child of that it is in.
        meets, branch = list(range(n)), list(range(n))
        for x in range(1, n):
            if x in above:
                continue
            y = parent[x]
            meets[x], branch[x] = (y, x) if y in above else (meets[y], branch[y])
            at = meets[x]
            # A section beside the one that holds best is a part of the same text if it has prose, however short.
            section = x in prose and tag[branch[x]] == "section" == beside.get(at)
            if at < best and (0 < NEARLY * score(best) <= score(x) or section and score(x) > 0) and few(x):
                if tag[at] in ("body", "html", "#root"):
                    far.add(branch[x])
                else:
                    top = min(top, at)
        if far:
            while tag[parent[top]] not in ("body", "html", "#root"):
                top = parent[top]
        return top, far


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (its code points) of every page."""
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]

    def make():
        def run(ids, urls, pages_):
            texts = [main_text(h) for h in pages_]
            return {id_col: ids, url_col: urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return map_rows(pages.select(id_col, url_col, html_col), f"{kinds[0]}, {kinds[1]}, text string, n_chars long", make)
