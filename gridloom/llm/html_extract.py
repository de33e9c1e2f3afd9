"""Main text of web pages by scoring a light element tree."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import by_batch, pick

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title style script noscript template html head".split())
NEVER = frozenset("head script style template noscript iframe object svg math canvas audio video nav footer aside button select dialog menu search textarea title".split())
SECTIONED = frozenset(("article", "main"))
KEEPS_P = frozenset("td th tr tbody thead tfoot caption option optgroup html head body legend".split())
P_SCOPE = frozenset("table td th caption button article section div main blockquote".split())
TABLE_PARTS = frozenset("caption td th tr tbody thead tfoot table".split())
CELLS = frozenset(("table", "td", "th", "caption"))
#: Element to (what it ends, what shields those from it).
ENDED_BY = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th tbody thead caption", "table"), "tfoot": ("tr td th tbody thead caption", "table"),
}

# What class names and ids call parts that are no article.
COMMENTS = frozenset("comment comments commentlist commentform commentsection disqus respond replies".split())
ADVERTS = frozenset("ad ads adv advert adverts advertising advertisement advertisements adsense adbox adslot adunit sponsor sponsored sponsors related recommended recommendations outbrain taboola".split())
PARTS = (
    frozenset(
        "sidebar sidebars aside menu menus submenu nav navbar navigation navs breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer copyright banner banners billboard promo promos "
        "cookie cookies consent gdpr notice notices popup popups modal modals overlay lightbox newsletter newsletters subscribe signup login sharebar".split()
    )
    | COMMENTS
    | ADVERTS
)
#: These tell only as the whole of a name, or in front of a word of FILLERS.
WHOLE = frozenset("share sharing shares social subscription promotion promotions reply hidden header".split())
FILLERS = frozenset(
    "area author authors avatar bar body bottom box button buttons col column container content count entry footer form group head header heading icon icons inner item items label left line link links list main message "
    "meta notice outer panel policy post posts right row section side slot stories story tab text thread title tools top unit wrap wrapper zone block articles news warning".split()
)
WEAK = frozenset("widget widgets tags taglist toc rail legal skip foot follow discussion reviews teaser teasers".split())
NEGATED = frozenset("has no with without not non".split())
OWN_HEADER = frozenset("article entry post story content title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
WANTED = frozenset("article body content entry hentry main page post text blog story".split())

#: The rest of a tag after its name. Quotes count only where a value begins; a quote that is never closed counts as any character.
INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+""")
LOOSE = re.compile(r"[^>]*+")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
KEPT, SOFT, FORM, GONE = 0, 1, 2, 3


def judged(name: str, inside_article: bool) -> int:
    """KEPT, SOFT (size and links decide) or GONE for what one class name or id says.

    The last word of a compound says what a thing is, so article-comments are comments and
    a share-price is a price; with a filler at the end the first word does, as in
    sidebar-content.
    """
    whole, parts = name.lower(), [w.lower() for w in WORD.findall(name)]
    if len(parts) < 2 or parts[0] in NEGATED:
        telling = whole if len(parts) < 2 else ""
    else:
        while len(parts) > 1 and parts[-1].isdigit():
            parts.pop()
        telling = parts[-1] if parts[-1] in PARTS else whole if whole in PARTS else parts[0] if parts[-1] in FILLERS and parts[0] in PARTS | WHOLE else "header" if parts[-1] == "header" and parts[0] not in OWN_HEADER else ""
        if not telling and parts[-1] in WEAK:
            return SOFT
    if telling == "header" and inside_article:
        return KEPT
    return GONE if telling in PARTS or telling in WHOLE else SOFT if telling in WEAK else KEPT


class Page:
    """Element tree of one page: a parent and a score for each block element, and its text blocks.

    One pass over the source and a stack; the places of open elements are kept by name, so
    neither depth nor broken markup costs more than its length.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.state, self.bonus = ["#page"], [-1], [KEPT], [0.0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._stack: list[int] = [0]
        self._open: dict[str, list[int]] = {}
        self._text: list[str] = []
        self._links: list[str] = []
        self._owner, self._link = 0, 0  # element of the text so far; depth at which a link is open, 0 for none
        self._read(source)

    def _depth(self, names) -> int:
        """Depth of the innermost open element of these names, -1 if there is none."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _judge(self, tag: str, attributes: str) -> tuple[int, float]:
        inside = self._depth(SECTIONED) > 0
        state, bonus = (GONE if tag in NEVER or tag == "header" and not inside else FORM if tag == "form" else KEPT), 25.0 * (tag in SECTIONED)
        if state == GONE or not TELLING.search(attributes):
            return state, bonus
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape(value.strip("\"'")) if "&" in value else value.strip("\"'")
            if key in ("class", "id"):
                names = value.split()
                if tag not in ("html", "body", "main"):
                    found = max((judged(n, inside) for n in names), default=KEPT)
                    if tag == "article" and not any(w.lower() in COMMENTS | ADVERTS for n in names for w in WORD.findall(n)):
                        found = KEPT
                    state = max(state, found)
                bonus += 25.0 * any(w.lower() in WANTED for n in names for w in WORD.findall(n))
            elif key == "role":
                state = GONE if value.lower() in ROLES and tag != "body" else state
            elif key == "style":
                plain = value.lower().replace(" ", "")
                state = GONE if "display:none" in plain or "visibility:hidden" in plain else state
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "itemprop" and value.lower() == "comment":
                state = GONE
        return state, bonus

    def _push(self, tag: str, attributes: str) -> None:
        top = self._stack[-1]
        state, bonus = (GONE, 0.0) if self.state[top] == GONE else self._judge(tag, attributes)
        self.tags.append(tag)
        self.parents.append(top)
        self.state.append(state)
        self.bonus.append(bonus)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _cut(self, depth: int) -> None:
        """Take the elements from this depth on off the stack."""
        if self._text and self._owner >= self._stack[depth]:
            self._flush()
        while len(self._stack) > depth:
            self._open[self.tags[self._stack.pop()]].pop()
        if self._link > depth:
            self._link = 0

    def _close(self, names, scope=()) -> None:
        """Take the innermost open element of these names off, unless one of `scope` is inside it."""
        at = self._depth(names)
        if at > 0 and at > self._depth(scope):
            self._cut(at)

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.blocks.append((self._owner, text, len(" ".join("".join(self._links).split()))))
            self._text, self._links = [], []

    def _say(self, raw: str) -> None:
        if not raw:
            return
        if self.tags[self._stack[-1]] == "head" and raw.strip():
            self._cut(len(self._stack) - 1)
        if self.state[self._stack[-1]] != GONE:
            text = html.unescape(LONG_REFERENCE.sub("\ufffd", raw)) if "&" in raw else raw
            self._owner = self._stack[-1]
            self._text.append(text)
            if self._link:
                self._links.append(text)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                self._say(source[at:])
                break
            following = source[begin + 1 : begin + 2]
            ends = following == "/"
            name = TAG_NAME.match(source, begin + 1 + ends)
            if not name:
                if not (ends or following in ("!", "?")) or begin + 2 >= n and not ends:
                    self._say(source[at : begin + 1])  # a bare less-than sign
                    at = begin + 1
                    continue
                self._say(source[at:begin])
                if source.startswith("<!--", begin):
                    quick = re.compile("-?>").match(source, begin + 4)
                    end = source.find("-->", begin + 4)
                    at = quick.end() if quick else end + 3 if end >= 0 else n
                elif source.startswith("<![CDATA[", begin):
                    end = source.find("]]>", begin)
                    at = end + 3 if end >= 0 else n
                else:
                    end = source.find(">", begin)
                    at = end + 1 if end >= 0 else n
                continue
            self._say(source[at:begin])
            end = INSIDE.match(source, name.end()).end()
            if end < n and source[end] != ">":
                end = LOOSE.match(source, end).end()
            if end >= n:
                break  # cut inside a tag
            at = end + 1
            tag = name[0].lower()
            if ends:
                self._end(tag)
            else:
                self._start(tag, source[name.end() : end])
                if tag in RAW:
                    found = ENDS[tag].search(source, at)
                    at = found.start() if found else n
        self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        if self.tags[self._stack[-1]] == "head" and tag not in IN_HEAD:
            self._cut(len(self._stack) - 1)
        if tag == "br":
            if self._text:
                self._text.append(" ")
        elif tag == "a":
            self._link = len(self._stack) if re.search(r"\bhref\b", attributes, re.I) else 0
        elif tag in BLOCK or tag in NEVER and tag not in VOID:
            if tag in BLOCK and self.state[self._stack[-1]] != GONE:
                self._flush()
            if tag in BLOCK and tag not in KEEPS_P:
                self._close(("p",), P_SCOPE)
            if tag in HEADINGS and self.tags[self._stack[-1]] in HEADINGS:
                self._cut(len(self._stack) - 1)
            if tag in ENDED_BY:
                names, scope = ENDED_BY[tag]
                self._close(names.split(), scope.split())
            if tag not in VOID and not (tag in ("html", "body", "head") and tag in self._open):
                self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = 0
        elif tag == "br":
            self._text.append(" ")
        elif tag in HEADINGS:
            self._close(HEADINGS, CELLS)
        elif tag in ("html", "body"):
            self._flush()
        elif tag in BLOCK or tag in NEVER:
            if tag == "p" and not self._open.get("p"):
                self._flush()
            self._close((tag,), () if tag == "table" else ("table",) if tag in TABLE_PARTS else CELLS)

    def _settled(self) -> tuple[list[int], list[int]]:
        """(characters, those inside links) of each element, once forms and doubtful parts are settled."""
        n = len(self.tags)
        for last in (False, True):
            size, links, sections = [0] * n, [0] * n, [0] * n
            for element, text, linked in self.blocks:
                if self.state[element] != GONE:
                    size[element] += len(text)
                    links[element] += linked
            for i in range(n - 1, 0, -1):
                up = self.parents[i]
                size[up] += size[i]
                links[up] += links[i]
                sections[up] += sections[i] + (self.tags[i] in SECTIONED)
            if not last:
                for i in range(1, n):
                    state = self.state[i]
                    if self.state[self.parents[i]] == GONE or state == SOFT and (size[i] < 250 or links[i] * 3 > size[i]) or state == FORM and not sections[i] and (size[i] < 500 or size[i] * 2 < size[0]):
                        self.state[i] = GONE
        return size, links

    def main(self) -> list[str]:
        """Text blocks of the best container and of those siblings that look like more of it."""
        n = len(self.tags)
        size, links = self._settled()
        points = [0.0] * n
        for element, text, linked in self.blocks:
            if len(text) >= 25 and self.tags[element] not in HEADINGS and self.state[element] != GONE:
                gain = 1 + text.count(",") + min(len(text) // 100, 3)
                gain *= 1 - min(1.0, linked / len(text))
                up = self.parents[element] if self.tags[element] in ("p", "pre", "td", "li", "dd", "blockquote") else element
                level = 0
                while up > 0 and level < 5:
                    points[up] += gain / (1 if level == 0 else 2 if level == 1 else level * 3)
                    up, level = self.parents[up], level + 1
        score = [(points[i] + self.bonus[i]) * (1 - links[i] / size[i]) if size[i] and self.state[i] != GONE else 0.0 for i in range(n)]
        best = max(range(n), key=lambda i: (score[i], -i))
        if score[best] <= 0:
            best = 0
        articles, mains, up = [], [], best
        while up > 0:
            (articles if self.tags[up] == "article" else mains if self.tags[up] == "main" else []).append(up)
            up = self.parents[up]
        best = articles[-1] if articles else mains[-1] if mains else best  # an article or main element is taken whole
        roots = {best}
        if best > 0:
            limit, home = max(10.0, score[best] * 0.2), self.parents[best]
            for i in range(1, n):
                if self.parents[i] == home and (score[i] >= limit and self.tags[i] == self.tags[best] or self.tags[i] == "h1" and i < best or self.tags[i] == "p" and size[i] > 80 and links[i] * 4 < size[i]):
                    roots.add(i)
        inside = [False] * n
        for i in range(n):
            inside[i] = self.state[i] != GONE and (i in roots or i > 0 and inside[self.parents[i]])
        return [text for element, text, _ in self.blocks if inside[element]]


def main_text(source: str | None) -> str:
    """The article's blocks joined by \\n; empty for null, empty or text-free pages."""
    return "\n".join(Page(source).main()) if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) for each page.

    Paragraphs pass points for their length and commas to their ancestors, less the share
    of link text; the best container, widened to its article or main element, and siblings
    of its kind are kept. Menus, page headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and reader comments are left out by element, class, id and role; where
    a name leaves doubt, size and link density decide. A form around most of the page is
    its frame and stays. Broken pages are read much as browsers do: a tag, comment or script
    without an end takes the rest of the page. Time and memory grow with a page's length,
    whatever its depth. A null page has an empty text. Repeated rows give a row each; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = dict(rows.dtypes)
    return by_batch(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
