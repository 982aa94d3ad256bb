"""HTML trees of single pages: tags, generalised paths, content text and blocks."""

from __future__ import annotations

import re
from html import unescape

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript template iframe noembed noframes xmp textarea title svg object select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_TEXT = RAW_TEXT | frozenset("head nav aside footer form button menu dialog input canvas audio video annotation annotation-xml".split())
NOT_A_CONTAINER = HEADING | frozenset("p pre li ul ol dl dt dd table tbody thead tfoot tr blockquote figure figcaption span a b i em strong br".split())
NOTICE_TAGS = frozenset("div p small span center section".split())
#: Elements whose text is prose wherever they stand.
PROSE = HEADING | frozenset("p pre li dd dt blockquote td th figcaption caption".split())
#: A container holds at least this share of the page's content; up to TINY of it in plain boxes beside it in the body may stay outside.
MOST, TINY = 0.7, 0.05
PAGE_TAGS = frozenset("#root html body".split())
# Words in class, id and role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment commentlist comments complementary consent "
    "contentinfo cookie cookies dialog discussion disqus donate footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing "
    "shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags taboola teaser toc toolbar tooltip topbar widget widgets".split()
)
HEADER_WORDS = frozenset("header head".split())
# Of these words, those that also name parts of an article; such a part goes only if it reads like no prose.
AMBIGUOUS = frozenset(
    "alert banner byline dialog discussion donate form notice notices promotion related reply respond search share sharing skip social tags teaser toc widget "
    "widgets".split()
)
#: Elements that can be boilerplate by name; a heading, paragraph, item, cell or inline element cannot.
NAMED = frozenset("div section ul ol dl aside header footer details fieldset center table figure hgroup".split())
# Whole classes that mark an advert also on a paragraph, item or article.
ADVERTS = frozenset("ad ads adv advert advertisement adverts promo promoted sponsor sponsored".split())
# Words in the class of a header's paragraph that tell who wrote the article and when.
CREDITS = frozenset("author authors byline credit credits date dateline meta published time timestamp updated".split())
#: A header's paragraph that is a sentence belongs to the article.
SENTENCE = re.compile(r"\w.*[.!?…][\"'”’»)\]]*\s*\Z", re.DOTALL)
#: A short box outside the article that begins so is a notice.
NOTICE, NOTICE_SIZE = re.compile(r"\s*(?:©|&copy;|&#169;|\(c\)\s|copyright\b|all rights reserved)", re.IGNORECASE), 200
#: A part named by an ambiguous word is prose if it has so many characters outside links, and more than inside.
PROSE_SIZE = 200
# First words of classes that tell the state of a page, such as "has-sidebar".
STATE_WORDS = frozenset("has with without no is".split())
# An opening tag (left) ends an open element (right) that HTML lets end without its own tag.
ENDED_BY = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tr td th tbody thead tfoot", "table"),
    "option": ("option", "select"),
}
ENDED_BY = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDED_BY.items()}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.DOTALL
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"[0-9]+")


class Page:
    """Nodes in page order: tag, parent, path, whether it is outside the article; and the text pieces in between.

    ``pieces`` has (node, text, in a link); a text of None is a break between blocks.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.paths = ["#root"], [-1], [""]
        self.dropped, self.header, self.in_main, self.prose = [False], [False], [False], [False]
        self.pieces: list[tuple[int, str | None, bool]] = []
        self.totals: list[float] | None = None
        self.unsure: list[int] = []
        self.readers: list[int] = []
        self.credits: set[int] = set()
        self.read(html)
        notices = {n for n, text, _ in self.pieces if text and not self.in_main[n] and self.tags[n] in NOTICE_TAGS and NOTICE.match(text)}
        if self.unsure or self.readers or notices:
            self.settle(notices)
        self.leads = self.standfirsts() if "header" in self.tags else set()

    def open(self, tag: str, attributes: str, parent: int) -> int:
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        classes = found.get("class", "").split()
        step = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in classes})])
        structural = tag in NAMED or "-" in tag
        named = [WORDS.findall(c) for c in (*classes, found.get("id", ""), found.get("role", ""))] if found and structural else []
        words = {w.lower() for ws in named if ws and ws[0].lower() not in STATE_WORDS for w in (ws[0], ws[-1])} if named else set()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(f"{self.paths[parent]}/{step}" if tag in BLOCK else self.paths[parent])
        marks = words & BOILERPLATE
        unsure = bool(marks) and marks <= AMBIGUOUS and (self.in_main[parent] or tag == "section")
        own = {c.lower() for c in classes} if tag in ("article", "li", "p") else set()
        control = tag == "label" and not self.prose[parent]
        self.dropped.append(self.dropped[parent] or tag in NEVER_TEXT or control or hidden or bool(own & ADVERTS) or (bool(marks) and not unsure))
        self.prose.append(self.prose[parent] or tag in PROSE)
        self.header.append(self.header[parent] or tag == "header" or bool(words & HEADER_WORDS))
        self.in_main.append(self.in_main[parent] or tag in ("article", "main"))
        node = len(self.tags) - 1
        if unsure:
            self.unsure.append(node)
        if (tag == "li" or tag == "article" and self.in_main[parent]) and any(ws and ws[0].lower() == "comment" for ws in map(WORDS.findall, classes)):
            self.readers.append(node)
        if tag == "p" and self.header[parent] and {w.lower() for c in classes for w in WORDS.findall(c)} & CREDITS:
            self.credits.add(node)
        return node

    def settle(self, notices: set[int]) -> None:
        """Drop the parts with ambiguous names that hold little text or mostly links, readers' comments, and short notices.

        An item or article named a comment is a reader's unless it has half of the page's text.
        """
        free, linked = [0] * len(self.tags), [0] * len(self.tags)
        for node, text, link in self.pieces:
            if text and not self.dropped[node]:
                (linked if link else free)[node] += len(text.strip())
        for node in range(len(self.tags) - 1, 0, -1):
            free[self.parents[node]] += free[node]
            linked[self.parents[node]] += linked[node]
        for node in self.unsure:
            self.dropped[node] = self.dropped[node] or free[node] < PROSE_SIZE or linked[node] >= free[node]
        for node in self.readers:
            self.dropped[node] = self.dropped[node] or 2 * (free[node] + linked[node]) < free[0] + linked[0]
        for node in notices:
            self.dropped[node] = self.dropped[node] or free[node] + linked[node] <= NOTICE_SIZE and free[node] + linked[node] < free[0] + linked[0]
        for node in range(1, len(self.tags)):
            self.dropped[node] = self.dropped[node] or self.dropped[self.parents[node]]

    def standfirsts(self) -> set[int]:
        """Nodes of the paragraphs in an article's header that are sentences and no credits."""
        within = [-1] * len(self.tags)
        texts: dict[int, str] = {}
        for node in range(1, len(self.tags)):
            lead = self.tags[node] == "p" and self.header[node] and self.in_main[node] and node not in self.credits
            within[node] = node if lead else within[self.parents[node]]
        for node, text, _ in self.pieces:
            if text and within[node] >= 0 and not self.dropped[node]:
                texts[within[node]] = texts.get(within[node], "") + text
        return {node for node, text in texts.items() if SENTENCE.search(text)}

    def read(self, html: str) -> None:
        stack, tags = [0], self.tags
        at, links = 0, 0
        for m in iter(lambda: MARKUP.search(html, at), None):
            if m.start() > at:
                self.pieces.append((stack[-1], html[at : m.start()], links > 0))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:  # an end tag closes its element and what is open inside it
                if name == "br":
                    self.pieces.append((stack[-1], " ", False))
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        links -= sum(tags[n] == "a" for n in stack[k:])
                        del stack[k:]
                        break
                if name in BLOCK:
                    self.pieces.append((stack[-1], None, False))
                continue
            ends, scope = ENDED_BY.get(name, ((), ()))
            if name in BLOCK and name != "option":
                ends, scope = (*ends, "p"), (*scope, "button", "table", "td", "th", "li", "dd", "blockquote", "div", "section", "article", "body", "main", "aside")
            if name == "a":
                ends, scope = ("a",), ("td", "th", "div", "p", "li")
            if name in HEADING:
                ends = (*ends, *HEADING)
            if ends:
                for k in range(len(stack) - 1, 0, -1):
                    open_tag = tags[stack[k]]
                    if open_tag in ends:
                        links -= sum(tags[n] == "a" for n in stack[k:])
                        del stack[k:]
                        if name not in ENDED_BY:
                            break
                    elif open_tag in scope:
                        break
            if name in BLOCK:
                self.pieces.append((stack[-1], None, False))
            if name == "br":
                self.pieces.append((stack[-1], " ", False))
            if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW_TEXT:
                continue
            if name in RAW_TEXT:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                continue
            stack.append(self.open(name, m[3], stack[-1]))
            links += name == "a"
        if at < len(html):
            self.pieces.append((stack[-1], html[at:], links > 0))

    def outside(self, node: int, whole_page: bool = True) -> bool:
        """Whether the text of a node is not the article's: boilerplate, or a header's text that is no heading.

        The headings of a header, and its paragraphs that are sentences, count only inside an article, a main
        element or a smaller container.
        """
        if self.dropped[node] or (self.header[node] and whole_page and not self.in_main[node]):
            return True
        while self.header[node]:
            if self.tags[node] in HEADING or node in self.leads:
                return False
            node = self.parents[node]
            if not self.header[node]:
                return True
        return False

    def content(self) -> list[float]:
        """Content characters at or below each node: text outside boilerplate; link text counts a tenth."""
        if self.totals is None:
            n = len(self.tags)
            total, bare, solid, linked_text = ([0.0] * n for _ in range(4))
            skipped: dict[int, bool] = {}
            for node, text, linked in self.pieces:
                if text and not text.isspace():
                    if node not in skipped:
                        skipped[node] = self.outside(node)
                    if not skipped[node]:
                        size = len(text.strip())
                        total[node] += size * (0.1 if linked else 1.0)
                        (linked_text if linked else solid if self.prose[node] else bare)[node] += size
            for node in range(n - 1, 0, -1):
                for sums in (total, bare, solid, linked_text):
                    sums[self.parents[node]] += sums[node]
            self.totals, self.bare, self.solid, self.linked_text = total, bare, solid, linked_text
        return self.totals

    def best_container(self) -> tuple[str, int]:
        """(path, content characters) of the element that holds the content; the path is empty if there is none.

        It starts at the outermost article or main element with most of the content, or else at the page, and goes
        down only while what stays outside is lists of links, or in the body a little text in plain boxes: no heading,
        paragraph or other prose. It ends at an article. A first heading beside an article or main element counts as its own.
        """
        total = self.content()
        self.container = 0
        if total[0] <= 0:
            return "", 0
        children: list[list[int]] = [[] for _ in total]
        for node in range(1, len(total)):
            if total[node] > 0:
                children[self.parents[node]].append(node)
        most = MOST * total[0]
        at = next((node for node in range(1, len(total)) if self.tags[node] in ("article", "main") and total[node] >= most), 0)
        up = self.parents[at]
        if at and self.tags[up] not in ("html", "body", "#root") and any(self.tags[c] == "h1" for c in children[up]):
            self.container = up
            return self.paths[up], int(total[up])
        best = at
        while self.tags[at] != "article" and children[at]:
            heaviest = max(children[at], key=lambda c: total[c])
            left = self.bare[at] - sum(self.bare[c] for c in children[at])
            loose = self.solid[at] - sum(self.solid[c] for c in children[at])
            for c in children[at]:
                if c != heaviest and self.linked_text[c] <= self.bare[c] + self.solid[c]:
                    left, loose = left + self.bare[c], loose + self.solid[c]
            if total[heaviest] < most or loose > 0 or left > (TINY * total[0] if self.tags[at] in PAGE_TAGS else 0):
                break
            at = heaviest
            if self.tags[at] in BLOCK and self.tags[at] not in NOT_A_CONTAINER:
                best = at
        self.container = best
        return self.paths[best], int(total[best])

    def covers(self, path: str) -> bool:
        """Whether the elements with this path hold most of the page's content."""
        total = self.content()
        inside = [False] * len(total)
        held = 0.0
        for node in range(1, len(total)):
            mine = self.paths[node] == path and self.tags[node] in BLOCK
            held += total[node] if mine and not inside[self.parents[node]] else 0
            inside[node] = mine or inside[self.parents[node]]
        return held >= MOST * total[0]

    def blocks(self, path: str | None, only: int = 0) -> list[str]:
        """Blocks in page order below the elements with this generalised path (None: the whole page), or below ``only`` one of them."""
        inside = [path is None] * len(self.tags)
        for node in range(1, len(self.tags)):
            inside[node] = inside[self.parents[node]] or (node == only if only else self.paths[node] == path and self.tags[node] in BLOCK)
        out: list[str] = []
        held: list[str] = []
        skipped: dict[int, bool] = {}
        whole_page = path is None or path.rpartition("/")[2].split(".")[0] in ("html", "body")

        def flush() -> None:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

        for node, text, _ in self.pieces:
            if text is None:
                flush()
            else:
                if node not in skipped:
                    skipped[node] = not inside[node] or self.outside(node, whole_page)
                if not skipped[node]:
                    held.append(text)
        flush()
        return out
