"""HTML extraction by tree scoring.

A page is read once into blocks of text and a tree of containers. Every paragraph passes points (one,
one for each comma, one for each hundred characters up to three) to its container, half of them to the
next one above, a quarter to the third, and so on to the root; a container's points are discounted by its
link density. From the container with the most points the search climbs while a parent adds text of low
link density, up to the enclosing article or main. What it comes to and those of its siblings that score
enough or read like paragraphs (within an article or main: any of low link density) are kept, and their blocks
are joined in page order. Elements that never hold article text (menus, footers, asides, forms,
scripts, styles, and containers whose class, id or role names such a thing) are skipped with all they
hold; a container that another of its names calls content is kept if it holds a paragraph, one for which only a part
of a compound name speaks (share-price) if it holds more prose than links. Names are split at hyphens, underscores and camel case.
Within what is kept, a list goes if each of its items is mostly a link. Controls (button, select, input) don't end
the block they stand in; a label or a phrase named as such things are stays in running text unless it holds a link. A page
without any block is read again without asking for names, then with the paragraphs of its forms.

Defined cases: null or empty html gives the empty string; unclosed and stray tags are repaired as
browsers do for the tags that matter (p closes p, li closes li, and so on; an unknown end tag is
ignored); a container that is to go for its names but is never closed loses all but its paragraphs;
attributes are read by the states of the HTML standard; a `<` that no `>` follows is text; a page without
any block gives the empty string; repeated rows are each extracted; nothing is cut or capped; the time
is linear in the page, at any depth of nesting.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meldwork.llm.common import map_rows

# One attribute, or the end of the tag; the states of the HTML standard: a quote opens a value only right behind the
# equals sign, and a quote that nothing closes is part of an unquoted value.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
#: Elements whose text up to the end tag isn't markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
#: Elements that hold no article text.
SKIP = RAW | {"nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "fieldset", "svg", "canvas", "object", "embed", "template", "dialog", "menu", "head", "audio", "video", "map", "datalist"}
#: Elements that open a block of their own.
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | SKIP
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINER = {"article", "main", "section", "div", "body", "td", "blockquote", "figure", "details", "header", "html", "center", "table", "tbody", "tr", "ul", "ol", "dl"}
#: Where the search for an open element ends.
SCOPES = {
    "flow": CONTAINER | SKIP, "list": {"ul", "ol"} | SKIP, "items": {"ul", "ol"}, "terms": {"dl"} | SKIP, "table": {"table"}, "row": {"tr", "table"}, "cell": {"td", "th"}, "select": {"select", "datalist"}, "block": BLOCK, "page": set(),
}
_SCOPES_OF = {n: tuple(k for k, v in SCOPES.items() if n in v) for n in BLOCK | CONTAINER | SKIP}
#: The open elements that a start tag closes, and the scope in which it looks for them.
CLOSES = {
    "p": ({"p"}, "flow"), "li": ({"li"}, "list"), "dt": ({"dt", "dd"}, "terms"), "dd": ({"dt", "dd"}, "terms"), "tr": ({"tr"}, "table"), "td": ({"td", "th"}, "row"), "th": ({"td", "th"}, "row"),
    "tbody": ({"thead", "tbody", "tr"}, "table"), "tfoot": ({"thead", "tbody", "tr"}, "table"), "option": ({"option"}, "select"), "a": ({"a"}, "block"),
}
#: Elements whose end tag may be missing: what follows closes them.
OMITTED = {"p", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "body", "html"}
#: Skipped elements that stand within a paragraph and don't end it.
PHRASE = {"button", "select", "option", "input", "label", "svg", "canvas", "object", "embed", "audio", "video", "map", "datalist", "template"} | RAW
CELLS = {"td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words in class, id or role that mark menus, notices, adverts, forms and reader comments.
UNLIKELY = re.compile(
    r"ads?|advert\w*|adbox|banner|breadcrumbs?|bylineshare|combx|comments?|commentlist|community|complementary|contentinfo|consent|cookies?|disqus|disclaimer|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promo\w*|recommended|related|replies|respond|search|share|sharing|shoutbox|sidebar|signup|skyscraper|social|sponsor\w*|subscribe|subscription|tags|teaser|toolbar|topbar|tracking|widget"
)
#: Of these, the words that decide at the end of any name (articleComments, weather-banner).
DECISIVE = re.compile(r"ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|disqus|footer|navbar|newsletter|popup|sidebar")
#: Words that say where or in what shape a thing stands, so that the rest of the name tells what it is.
NEUTRAL = set(
    "area article articles bar blog body bottom box block button buttons center col column container content count entry first form global group head header holder icon icons inline inner item items last left link links list main media message module outer page panel placeholder post posts primary reader right row secondary section site slot small stories story text thread title tools top unit user web wrap wrapper".split()
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Names that say how a wrapper is laid out, not what it is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[_-]\S+", re.I)
LIKELY = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("children", "links", "name", "parent", "points", "prose", "size")

    def __init__(self, name: str, parent: _Node | None, points: float = 0.0) -> None:
        self.name, self.parent, self.points, self.size, self.links, self.prose = name, parent, points, 0, 0, 0
        self.children: list[_Node] = []
        if parent is not None:
            parent.children.append(self)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of the tag whose name ends at `at`, and the place behind the tag; 0 where the page ends first."""
    found = []
    while at < len(page):
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            return found, at
        if m[2]:
            found.append((m[2].lower(), m[3] or m[4] or m[5] or ""))
    return found, 0


def _names(attributes: list[tuple[str, str]]) -> tuple[str, bool]:
    """What class, id and role say, and whether the element is hidden."""
    words, hidden = [], False
    for key, value in attributes:
        if key in ("class", "id", "role"):
            words.append(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            hidden = True
    return " ".join(words), hidden


def _start_points(name: str, words: str) -> float:
    base = {"article": 10.0, "main": 8.0, "div": 3.0, "section": 3.0, "blockquote": 2.0, "td": 2.0, "form": -3.0, "ul": -3.0, "ol": -3.0}.get(name, 0.0)
    return base + (5.0 if LIKELY.search(words) else 0.0)


def _verdict(name: str) -> int:
    """2 for one name that marks something to skip, 1 for one in which such a word stands beside others (share-price), else 0."""
    parts = [x for x in re.split(r"[_-]+", _CAMEL.sub("-", name).lower()) if x and not x.isdigit()]
    marked = [bool(UNLIKELY.fullmatch(x)) for x in parts]
    if not any(marked):
        return 0
    telling = [x for x in parts if x not in NEUTRAL]
    return 2 if all(m or x in NEUTRAL for m, x in zip(marked, parts, strict=True)) or DECISIVE.fullmatch(telling[-1]) else 1


def _unlikely(words: str) -> tuple[int, bool]:
    """The strongest verdict on the names, and whether one name of its own says that the element is content."""
    names = [(w, _verdict(w)) for w in LAYOUT.sub("", words).split()]
    most = max((v for _, v in names), default=0)
    return most, most > 0 and any(not v and LIKELY.search(w) for w, v in names)


class _Open:
    """The open elements, outermost first, with the places of each name and the last place of each scope."""

    def __init__(self, root: _Node) -> None:
        self.names, self.nodes = ["root"], [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: dict[str, list[int]] = {k: [0] for k in SCOPES}

    def push(self, name: str, node: _Node) -> None:
        at = len(self.names)
        self.places.setdefault(name, []).append(at)
        for k in _SCOPES_OF.get(name, ()):
            self.scopes[k].append(at)
        self.names.append(name)
        self.nodes.append(node)

    def cut(self, upto: int) -> None:
        for i in range(len(self.names) - 1, upto - 1, -1):
            name = self.names.pop()
            self.places[name].pop()
            for k in _SCOPES_OF.get(name, ()):
                self.scopes[k].pop()
        del self.nodes[upto:]

    def find(self, names: set[str], scope: str) -> int:
        """The place of the innermost open element of one of the names within the scope, or 0."""
        best = max((p[-1] for n in names if (p := self.places.get(n))), default=0)
        return best if best > self.scopes[scope][-1] else 0

    def outermost(self, names: set[str], scope: str) -> int:
        """The place of the outermost open element of one of the names within the scope, or 0."""
        bound = self.scopes[scope][-1]
        return min((p[i] for n in names if (p := self.places.get(n)) and (i := bisect_right(p, bound)) < len(p)), default=0)

    def has(self, *names: str) -> bool:
        return any(self.places.get(n) for n in names)


#: Why a container is in doubt: its names, names that disagree, a part of a compound name.
NAMED, SPARED, COMPOUND = range(3)


def _prose(text: str, in_links: int) -> int:
    """The characters that count as prose: all but the links', in a text of a line or more that isn't mostly links."""
    return len(text) - in_links if len(text) >= 25 and in_links * 4 < len(text) else 0


def _read(page: str, level: int = 0) -> tuple[list[_Node], list[tuple[_Node, str, int, str]]]:
    """The tree's nodes, parents first, and the page's blocks: (container or block element, text, characters in links, element).

    A skipped element stays among the open ones, and its subtree is followed by the same rules, so that
    whatever closes it ends the skip. A container that is to go for its names is in doubt: it is read, and its blocks go
    when its own end tag comes; where that is missing, its paragraphs stay. One whose names disagree stays
    if it holds a paragraph, and one for which only a part of a compound name speaks if it holds more prose than links.
    A phrase that is to go for its names, or a label, doesn't end the block around it: its text stays if it is the
    smaller part of the block and holds no link or control. At level 1 no element goes for its names, at level 2 forms are in doubt too.
    Every step costs the same at any depth, so the time is linear in the page.
    """
    root = _Node("root", None)
    tree, up = [root], _Open(root)
    blocks: list[tuple[_Node, str, int, str] | None] = []
    prose: list[int] = []  # numbers of blocks that are paragraphs
    other: list[int] = []  # and of the rest
    doubts: list[tuple[int, int, int, int, int]] = []  # place among the open elements, first block, kind, prose and links before
    parts: list[str] = []
    held: list[int] = []  # numbers of parts that come from doubtful phrases
    linked: list[int] = []
    link, skipped = 0, 0  # skipped: the skipped element's place among the open ones
    inline = False  # whether it stands in running text and goes for its names
    phrase = -1  # number of the first part of the phrase that is skipped now but held
    running = in_anchors = 0  # characters of prose and of links in the blocks so far
    unended: set[str] = set()

    def flush() -> None:
        nonlocal running, in_anchors
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if held and 2 * sum(len(parts[i].strip()) for i in held) > len(text):
            for i in held:
                parts[i] = ""
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            in_links, kind = min(len(text), sum(linked)), up.names[-1]
            (prose if kind == "p" and len(text) >= 25 and in_links * 4 < len(text) else other).append(len(blocks))
            blocks.append((up.nodes[-1], text, in_links, kind))
            running += _prose(text, in_links)
            in_anchors += in_links
        parts.clear()
        linked.clear()
        held.clear()

    def drop(numbers: list[int], begin: int) -> None:
        nonlocal running, in_anchors
        while numbers and numbers[-1] >= begin:
            _, text, in_links, _ = blocks[numbers[-1]]
            running -= _prose(text, in_links)
            in_anchors -= in_links
            blocks[numbers.pop()] = None

    def close(upto: int, name: str | None = None) -> None:
        """Close the elements from `upto` on; name is that of the end tag that does it."""
        nonlocal skipped, phrase
        if not skipped or upto < skipped:
            flush()
        while doubts and doubts[-1][0] >= upto:
            place, begin, kind, before, links = doubts.pop()
            ended = place == upto and name == up.names[place]
            if kind == SPARED and prose and prose[-1] >= begin or kind == COMPOUND and running - before > in_anchors - links:
                continue
            drop(other, begin)
            if ended or kind != NAMED:
                drop(prose, begin)
        up.cut(upto)
        if upto <= skipped:
            skipped, phrase = 0, -1

    def doubt(place: int, kind: int) -> None:
        doubts.append((place, len(blocks), kind, running, in_anchors))

    size, last = len(page), page.rfind(">")
    at = quoted_to_the_end = 0
    while at < size:
        begin = page.find("<", at)
        begin = size if begin < 0 else begin
        if begin > last:  # no tag can end, so what is left is text
            begin = size
        if begin > at and (not skipped or phrase >= 0):
            run = page[at:begin]
            if skipped:
                held.append(len(parts))
            parts.append(run)
            if link:
                linked.append(len(run.strip()))
        if begin == size:
            break
        sign = page[begin + 1]
        if sign in "!?":
            at = _COMMENT.match(page, begin).end()
            continue
        ends = sign == "/"
        m = _NAME.match(page, begin + 1 + ends)
        if m is None:
            at = begin + 1
            if ends:  # as the standard has it, a comment
                at = page.find(">", begin) + 1
            elif not skipped:
                parts.append("<")
            continue
        name, attributes, at = m[0].lower(), [], m.end()
        if page[at : at + 1] == ">":
            at += 1
        else:
            attributes, behind = ([], 0) if quoted_to_the_end else _attributes(page, at)
            if not behind:  # a quote has swallowed the last >: from here on tags end at the next one
                quoted_to_the_end, behind = 1, page.find(">", at) + 1
            at = behind
        if ends:
            if name in BLOCK:
                i = up.find({name}, "items" if name == "li" else "table" if name in CELLS else "page" if name == "table" else "cell")
            else:
                i = up.find({name}, "block") if up.places.get(name) else 0
            if i:
                close(i, name)
            elif name == "a":
                link = max(0, link - 1)
            elif name in BLOCK and not skipped:
                flush()
            continue
        if name in RAW and name not in unended:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            if end or name in ("script", "style"):
                at = end.end() if end else size
                continue
            unended.add(name)  # its text is read as markup, and skipped until the next block
        if skipped and up.names[skipped] in unended and name in BLOCK and name not in RAW:
            close(skipped)
        if name in BLOCK or skipped and name == "a":
            if phrase >= 0:  # a link or a control in it: the phrase is one
                for i in range(phrase, len(parts)):
                    parts[i] = ""
                phrase = -1
            if skipped and inline and name in CONTAINER | {"p"} and up.names[skipped] != "a":  # running text holds no blocks: it may never be closed
                flush()
                doubt(skipped, NAMED)
                skipped = 0
            if not skipped and name not in PHRASE:
                flush()
            gone, scope = CLOSES.get(name, (set(), "page") if name in PHRASE or name in ("html", "body") else ({"p"}, "flow"))
            i = (up.outermost if name in ("tbody", "tfoot") else up.find)(gone, scope) if gone else 0
            if i:
                close(i)
            if name in BLOCK and name != "html" and (name == "body" or name not in SKIP) and (i := up.find({"head"}, "page")):
                close(i)  # what can't be in a head ends it
        void = name in VOID or page[at - 2] == "/" and name not in BLOCK
        if skipped:
            if name == "main" and up.names[skipped] in ("nav", "footer", "aside", "header", "form"):  # these never hold it
                close(skipped)
            else:
                if not void:
                    up.push(name, up.nodes[-1])
                continue
        words, hidden = _names(attributes) if attributes else ("", False)
        verdict, spared = _unlikely(words) if words and not level and name not in ("html", "body", "article", "main") else (0, False)
        doubtful = verdict and name in CONTAINER and name not in OMITTED or level > 1 and name == "form"
        named = verdict == 2 and not doubtful
        if hidden or name in SKIP and not doubtful or name == "header" and not up.has("article", "main") or named:
            if not void:
                skipped, inline = len(up.names), named and not hidden and name not in BLOCK
                phrase = len(parts) if (inline and name != "a" or name == "label") and not hidden else -1
                up.push(name, up.nodes[-1])
            continue
        if name == "br":
            parts.append("\n")
        elif name == "a":
            link += 1
        elif name in BLOCK and name not in VOID:
            node = up.nodes[-1]
            if name in CONTAINER:
                node = _Node(name, node, _start_points(name, words))
                tree.append(node)
            if doubtful:
                doubt(len(up.names), SPARED if spared or name == "form" else NAMED if verdict == 2 else COMPOUND)
            up.push(name, node)
    close(1)
    return tree, [b for b in blocks if b is not None]


def _enclosing(node: _Node) -> _Node | None:
    """The nearest article or main around the node, or itself."""
    up: _Node | None = node
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    return up


def _climbed(best: _Node) -> _Node:
    """The highest container up to the enclosing article or main that adds text of low link density.

    Without one, what is added must be paragraphs for half of it at least, and body is the bound.
    """
    bound, at = _enclosing(best), best
    while at is not bound and at.parent is not None and (bound is not None or at.parent.name not in ("body", "html", "root")):
        up = at.parent
        size, links, prose = up.size - best.size, up.links - best.links, up.prose - best.prose
        if size and (links * 4 >= size or bound is None and prose < max(80, size / 2)):
            break
        at = up
        if size:
            best = up
    return best


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    for level in range(3):
        nodes, blocks = _read(page, level)
        if blocks:
            break
    else:
        return ""
    root, flow = nodes[0], {}
    for node, text, in_links, kind in blocks:
        points = 1 + text.count(",") + min(3, len(text) // 100) if len(text) >= 25 else 0
        flow[id(node)] = flow.get(id(node), 0.0) + points * (1 - in_links / len(text))
        node.prose += len(text) if kind == "p" and points and in_links * 4 < len(text) else 0
        node.size += len(text)
        node.links += in_links
    score: dict[int, float] = {}
    for node in reversed(nodes):  # children before their parents
        share, up = flow.get(id(node), 0.0), node.parent
        node.points += share
        score[id(node)] = node.points * (1 - node.links / node.size) if node.size else 0.0
        if up is not None:
            flow[id(up)] = flow.get(id(up), 0.0) + share / 2
            up.prose += node.prose
            up.size += node.size
            up.links += node.links
    best = max((n for n in nodes if n.size), key=lambda n: score[id(n)])
    while best.name in ("p", "ul", "ol", "tr", "tbody", "blockquote") and best.parent is not None and best.parent is not root:
        best = best.parent
    core, best = best, _climbed(best)
    kept = {id(best)}
    if best.parent is not None and best.name not in ("article", "main"):
        least = max(10.0, score[id(best)] * 0.2)
        short = 0 if _enclosing(best) is not None else 80
        kept |= {id(n) for n in best.parent.children if n.size and (score[id(n)] >= least or n.size > short and n.links / n.size < 0.25 and n.name not in ("ul", "ol", "header"))}
        loose = best.parent
    else:
        loose = None
    memo: dict[int, bool] = {id(n): True for n in nodes if id(n) in kept}
    # What the climb has added is kept branch by branch: not the branches that are mostly links.
    lower = {id(core)}
    while core is not best:
        core = core.parent
        memo |= {id(n): False for n in core.children if id(n) not in lower and n.size and n.links * 2 > n.size}
        lower.add(id(core))

    def keeps(node: _Node) -> bool:
        chain, up = [], node
        while up is not None and id(up) not in memo:
            chain.append(id(up))
            up = up.parent
        found = up is not None and memo[id(up)]
        for x in chain:
            memo[x] = found
        return found

    # A list goes if each of its items is mostly a link.
    items = {id(node) for node, text, in_links, _ in blocks if in_links * 2 <= len(text)}
    out = []
    for node, text, in_links, kind in blocks:
        own = keeps(node) or node is loose and (kind in ("p", "h1", "h2", "h3") and in_links * 4 < len(text))
        if own and not (kind == "li" and id(node) not in items):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(id_col, url_col, html_col)
    kinds = dict(rows.dtypes)
    return map_rows(rows, run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
