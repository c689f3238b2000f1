"""Main text of web pages by composite text density.

A page becomes a tree. Every node gets its characters per tag, adjusted by the share of characters and tags inside
links; the density sum of a node is the sum over its children. The node with the largest sum marks the body of the
article, and the smallest density on its path up to the body element is the threshold: wherever a node reaches it,
the subtree with the largest density sum below that node is content.

Elements inside a line (bold, links, line breaks) count as tags and characters of the block they stand in; only blocks
have sums of their own, else one bold word could outweigh its article. A best node that lies in an article or main
element stands for that whole element, so headings beside the text body stay.

Elements that by their meaning are never article text (menus, adverts, forms, scripts, comments of readers) are
cut out before densities are taken; their links still count for the page's share of link characters.

A word in a class or id is only a suspicion, as slugs like "related-work" name sections too. A suspect beside the article is
cut out. One that holds the first article is not, nor one with most of the text of a page that marks no article. One inside the article
is cut out if links are most of it, or if it is a mere container (not a section or a paragraph) that is named for adverts or
comments, or that has no heading and is less dense than the threshold found without suspects: sections may be short.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import chunks

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset(
    "script style title head nav aside footer form button select textarea input label fieldset iframe noscript noembed"
    " noframes template svg math canvas object audio video dialog menu".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag closes when they are still open, and those that stop the search for them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SCOPE = frozenset("td th table article section div body html li blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
NOTICE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promos?|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|cookies?|consent"
    r"|gdpr|popup|modal|notice|alert|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*"
    r"|comments?|commentlist|disqus|respond|reply|replies|footer|masthead|site-header|page-header|toolbar"
    r"|pagination|pager|skip-link)(?=$|[\s_-])",
    re.I,
)
#: Whole classes that leave no doubt: adverts and comments of readers.
NEVER_ARTICLE = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisements?|sponsored|comments|commentlist|disqus)(?=$|\s)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose id tells a role inside an article; ids of others, sections among them, are anchors.
CONTAINERS = frozenset("div ul ol table".split())
MARKED = ("article", "main")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"']|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<[!?][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _cut_out(name: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element with all below it is page furniture, and whether a word in its class or id makes it suspect (1: yes,
    2: beyond doubt).

    A header counts unless it heads an article.
    """
    if name in DROPPED or (name == "header" and not in_article):
        return True, 0
    if not attrs or name in ("html", "body", *MARKED):
        return False, 0
    suspect = 0
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "class" and NOTICE.search(value):
            suspect = 2 if NEVER_ARTICLE.search(value) else max(suspect, 1)
        if key == "id" and (name in CONTAINERS if in_article else name not in HEADINGS) and NOTICE.search(value):
            suspect = max(suspect, 1)
        if key == "role" and value.lower() in ROLES:
            return True, 0
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, 0
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, 0
    return False, suspect


class _Tree:
    """Nodes in page order: parent, tag, own text and whether the node is cut out; suspects, and those in an article."""

    def __init__(self) -> None:
        self.parent, self.tag, self.gone = [-1], ["body"], [False]
        self.pieces: list[tuple[int, str]] = []
        self.open = [0]
        self.suspects: list[int] = []
        self.sure: set[int] = set()
        self.inside: set[int] = set()
        # Articles and main elements that are open, by their places in ``open``.
        self.marked: list[int] = []

    def text(self, data: str) -> None:
        if data:
            self.pieces.append((self.open[-1], entities.unescape(data) if "&" in data else data))

    def start(self, name: str, attrs: str) -> None:
        if name in ENDS_PARAGRAPH:
            self._close({"p"}, SCOPE)
        if name in CLOSES:
            self._close(*CLOSES[name])
        if name in ("html", "body"):
            return
        top = self.open[-1]
        in_article = bool(self.marked)
        cut, suspect = _cut_out(name, attrs, in_article)
        self.parent.append(top)
        self.tag.append(name)
        self.gone.append(self.gone[top] or cut)
        node = len(self.tag) - 1
        if suspect and not self.gone[node]:
            self.suspects.append(node)
            if suspect > 1:
                self.sure.add(node)
            if in_article:
                self.inside.add(node)
        if name in BLOCK:
            self.pieces.append((node, " "))
        if name not in VOID and not attrs.endswith("/"):
            if name in MARKED:
                self.marked.append(len(self.open))
            self.open.append(node)

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == name:
                self._pop(k)
                return

    def _close(self, names: set[str], until: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if (tag := self.tag[self.open[k]]) in names:
                self._pop(k)
                return
            if tag in until:
                return

    def _pop(self, k: int) -> None:
        if any(self.tag[i] in BLOCK for i in self.open[k:]):
            self.pieces.append((self.open[k - 1], " "))
        del self.open[k:]
        while self.marked and self.marked[-1] >= k:
            self.marked.pop()


def _parse(page: str) -> _Tree:
    tree, at, low = _Tree(), 0, None
    while tag := TAG.search(page, at):
        tree.text(page[at : tag.start()])
        at = tag.end()
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if tag["close"]:
            tree.end(name)
            continue
        tree.start(name, tag["attrs"])
        if name in RAW and name not in VOID and not tag["attrs"].endswith("/"):
            low = page.lower() if low is None else low
            # lower() can change a text's length; then a search without case is needed.
            end = low.find(f"</{name}", at) if len(low) == len(page) else -1
            if len(low) != len(page) and (found := re.compile(f"</{name}", re.I).search(page, at)):
                end = found.start()
            end = len(page) if end < 0 else end
            tree.text(page[at:end])
            at = end
    tree.text(page[at:])
    return tree


def _densities(tree: _Tree) -> tuple[list[float], list[float], list[int], int]:
    """Density and density sum per node, the best sum in each subtree (a node), and the best node of all."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    all_chars = all_links = 0
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    for node, text in tree.pieces:
        size = len(text.strip())
        in_head = tree.tag[node] in RAW
        all_chars += 0 if in_head else size
        all_links += size if in_link[node] and not in_head else 0
        if not tree.gone[node]:
            chars[node] += size
            link_chars[node] += size if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        if not tree.gone[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    share = all_links / max(all_chars, 1)
    density = [0.0] * n
    for i in range(n):
        if c := chars[i]:
            t, lc, lt = max(tags[i], 1), link_chars[i], link_tags[i]
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            adjust = math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(base) if base > 1 + 1e-9 else 1.0
            density[i] = c / t * adjust
    sums = [0.0] * n
    for i in range(1, n):
        if not tree.gone[i] and tree.tag[i] in BLOCK:
            sums[tree.parent[i]] += density[i]
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        # At equal sums the node that comes first in the page stays.
        if not tree.gone[i] and sums[best[i]] >= sums[best[p]] and (sums[best[i]] > sums[best[p]] or best[p] != p):
            best[p] = best[i]
    return density, sums, best, best[0]


def _threshold(tree: _Tree, density: list[float], top: int) -> float:
    """Smallest density from the best node up to the body."""
    threshold, node = density[top], top
    while node > 0:
        node = tree.parent[node]
        threshold = min(threshold, density[node])
    return threshold


def _without(tree: _Tree, cut: set[int]) -> list[bool]:
    """What is gone when some nodes are cut out too."""
    gone = list(tree.gone)
    for i in range(1, len(gone)):
        gone[i] = gone[i] or i in cut or gone[tree.parent[i]]
    return gone


def _furniture(tree: _Tree) -> list[bool]:
    """What is gone once it is known which suspects are furniture."""
    n, hard = len(tree.tag), tree.gone
    density, _, _, _ = _densities(tree)
    chars, paragraphs, holds = [0] * n, [0] * n, [False] * n
    links, headings, in_link = [0] * n, [False] * n, [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
        headings[i] = tree.tag[i] in HEADINGS
    # The first article is the page's own; later ones may be comments or teasers.
    own = next((i for i in range(1, n) if tree.tag[i] in MARKED and not hard[i]), 0)
    node = own
    while node > 0:
        node = tree.parent[node]
        holds[node] = True
    for node, text in tree.pieces:
        if not hard[node]:
            chars[node] += len(text.strip())
            links[node] += len(text.strip()) if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        if not hard[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            headings[p] = headings[p] or headings[i]
            paragraphs[p] += paragraphs[i] + (tree.tag[i] == "p")
    doubtful = {i for i in tree.suspects if not holds[i]}
    tree.gone = _without(tree, doubtful)
    rest, _, _, top = _densities(tree)
    threshold = _threshold(tree, rest, top)
    tree.gone = hard

    def below_top(node: int) -> bool:
        while node > 0 and node != top:
            node = tree.parent[node]
        return node == top

    def within(i: int) -> bool:
        """Whether a suspect inside the article is furniture."""
        container = tree.tag[i] in CONTAINERS
        mere = container and (i in tree.sure or (not headings[i] and density[i] < threshold))
        return mere or 2 * links[i] > chars[i]

    cut = set()
    for i in doubtful:
        beside = i not in tree.inside if own else not below_top(i)
        most = not own and 2 * chars[i] > chars[0] and paragraphs[i] > 1
        if within(i) if not beside else (i in tree.sure or not most):
            cut.add(i)
    return _without(tree, cut)


def main_text(page: str | None) -> str:
    """The article of one page, white space as single spaces; empty for null, empty and text-free pages."""
    if not page:
        return ""
    tree = _parse(page)
    if tree.suspects:
        tree.gone = _furniture(tree)
    density, sums, best, top = _densities(tree)
    n = len(tree.tag)
    threshold = _threshold(tree, density, top)
    kept = [False] * n
    for wanted in MARKED:
        node = top
        while node > 0 and tree.tag[node] != wanted:
            node = tree.parent[node]
        if node > 0:
            kept[node] = True
            break
    # A page with text but no element inside its body has no sums: its body is the article.
    kept[top] = True
    for i in range(n):
        if not tree.gone[i] and density[i] >= threshold and density[i] > 0:
            kept[best[i]] = True
    for i in range(1, n):
        kept[i] = (kept[i] or kept[tree.parent[i]]) and not tree.gone[i]
    return " ".join("".join([t if kept[i] else " " for i, t in tree.pieces]).split())


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points) of the article.

    Null and empty html give an empty text. Columns of the input named text or n_chars are replaced. Pages are
    handled alone, in the tasks that read them: no shuffle, and a repeated task gives the same rows.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).alias("text"))
    schema = source.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [main_text(page) for page in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return source.mapInArrow(extract, schema)
