"""Main text of web pages by composite text density.

One pass over the tags builds the tree of elements (implied end tags, void and raw-text elements,
unclosed and stray tags). Elements that are boilerplate by name, role or class are left out. Each
node's composite density is its characters per tag, adjusted for the share of link text; the node
with the largest sum of its children's densities is the core of the article. An enclosing article
or main element bounds it; without one, the least density on the path from body to the core is
the threshold that other subtrees must reach to count as well.

Null html is empty and gives an empty text. Repeated rows stay repeated; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

TAG = re.compile(r"""<(?:!--(?P<note>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<odd>[!?/][^>]*+>?|[a-zA-Z][^>]*+>?))""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the second kind ends an open element of the first, up to the given bounds.
ENDS_P = BLOCK - frozenset("br body html caption dd dt li option optgroup td th tr tbody thead tfoot legend summary".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td"}, {"table"}), "body": ({"head"}, set())}
P_BOUND = frozenset("button table td th caption article section aside main body".split())
#: Boilerplate by element, by role, and by a word of class or id.
NOISE_TAGS = frozenset("nav footer aside form button select input menu dialog svg canvas object audio video template head datalist".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead reply share sharing social related recommended"
    " popup modal overlay newsletter subscribe subscription signup login pagination pager widget toolbar".split()
)
OUTSIDE_WORDS = frozenset(["header", "topbar"])
COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus respond replies".split())
NOISE_STARTS = ("advert", "adsby", "cookie", "sponsor", "newsletter", "sidebar", "breadcrumb", "popup")
WORD, CAMEL = re.compile(r"[a-z0-9]+"), re.compile(r"([a-z])([A-Z])")
OUT = "page_id long, url string, text string, n_chars long, n_blocks int, core string"


HARD, SOFT, COMMENT = 2, 1, 3


def _noise(tag: str, rest: str, in_article: bool) -> int:
    """0, or how sure it is that an element is boilerplate: HARD by its name or state, SOFT by the
    words of its class, which a wrapper of the article may also have, COMMENT of readers."""
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return HARD
    if not rest or rest.isspace():
        return 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return HARD
    if found.get("role", "").lower() in NOISE_ROLES:
        return HARD
    words = set(WORD.findall(CAMEL.sub(r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if words & COMMENT_WORDS and tag not in ("html", "body", "main"):
        return COMMENT
    if tag in ("html", "body", "main", "article"):
        return SOFT if tag == "article" and words & {"ad", "ads", "related"} else 0
    if words & NOISE_WORDS or any(w.startswith(NOISE_STARTS) for w in words) or not in_article and words & OUTSIDE_WORDS:
        return SOFT
    return 0


class Page:
    """Elements by number, parents before children, and the kept text with its element."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise, self.article = ["#root"], [-1], [0], [False]
        self.text: list[tuple[int, str]] = []  # (element, characters) or (-1, "") between blocks
        self._parse(source)
        self._decide()

    def _decide(self) -> None:
        """Elements that are SOFT by themselves hold the article if they wrap it or most of the text; then noise is inherited."""
        n = len(self.tag)
        size, wraps = [0] * n, [t in ("article", "main") and not q for t, q in zip(self.tag, self.noise, strict=True)]
        for i, t in self.text:
            if i >= 0:
                size[i] += len(t)
        for i in range(n - 1, 0, -1):
            if self.noise[i] not in (HARD, COMMENT):
                size[self.parent[i]] += size[i]
                wraps[self.parent[i]] |= wraps[i]
        for i in range(1, n):
            if self.noise[i] == SOFT and (wraps[i] or size[i] > 0.7 * size[0]):
                self.noise[i] = 0
            self.noise[i] = self.noise[i] or self.noise[self.parent[i]]
        self.text = [(i, t) for i, t in self.text if i < 0 or not self.noise[i]]

    def _parse(self, source: str) -> None:
        open_, at, n = [0], 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            self._say(open_[-1], source[at : m.start() if m else n])
            if not m:
                return
            at = m.end()
            if m["note"] is not None:
                end = source.find("-->", at)
                # an empty comment may end at once
                at = at + 1 if source.startswith(">", at) else n if end < 0 else end + 3
                continue
            if m["odd"] is not None:
                if m["odd"].startswith("![CDATA["):
                    end = source.find("]]>", m.start())
                    self._say(open_[-1], html.escape(source[m.start() + 9 : end if end >= 0 else n], quote=False))
                    at = n if end < 0 else end + 3
                continue
            tag, rest = m["name"].lower(), m["rest"]
            if tag in BLOCK:
                self.text.append((-1, ""))
            if m["end"]:
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == tag:
                        del open_[k:]
                        break
                continue
            if tag in CLOSES:
                self._close(open_, *CLOSES[tag])
            if tag in ENDS_P:
                self._close(open_, {"p"}, P_BOUND)
            if tag in ("article", "main"):  # an article doesn't stand in a menu or header: that one wasn't closed
                self._close(open_, {"nav", "header", "form", "head"}, {"article", "main"})
            up, node = open_[-1], len(self.tag)
            self.tag.append(tag)
            self.parent.append(up)
            in_article = self.article[up] or tag in ("article", "main")
            self.article.append(in_article)
            self.noise.append(HARD if self.noise[up] == HARD else _noise(tag, rest, in_article))
            if tag in VOID or rest.endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = end.start() if end else n
            open_.append(node)

    def _close(self, open_: list[int], tags: set[str], bounds: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if self.tag[open_[k]] in tags:
                del open_[k:]
                return
            if self.tag[open_[k]] in bounds:
                return

    def _say(self, node: int, raw: str) -> None:
        if raw and self.noise[node] != HARD:
            self.text.append((node, html.unescape(raw) if "&" in raw else raw))

    def core(self) -> tuple[set[int], str]:
        """The elements whose text counts, and the name of the densest one."""
        n = len(self.tag)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for i, t in self.text:
            if i >= 0:
                size = len("".join(t.split()))
                chars[i] += size
                links[i] += size * in_link[i]
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        if not chars[0]:
            return set(), ""
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        body = body if chars[body] else 0
        ratio = links[body] / chars[body]

        def density(i: int) -> float:
            c, lc, t, lt = chars[i], links[i], max(tags[i], 1), max(link_tags[i], 1)
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            inside = c / max(lc, 1) * t / lt
            return c / t * (math.log(inside) / math.log(base) if inside > 1 and base > 1.0001 else math.log(max(inside, 1.0)))

        dense = [0.0 if self.noise[i] else density(i) for i in range(n)]
        total = [0.0] * n
        for i in range(1, n):
            total[self.parent[i]] += dense[i]
        core = max((i for i in range(n) if chars[i] and not self.noise[i]), key=lambda i: (total[i], dense[i], -i))
        path, i = [core], core
        while i > body:
            i = self.parent[i]
            path.append(i)
        bound = [i for i in path if self.tag[i] in ("article", "main")]
        if bound:
            roots = {bound[-1]}
        else:
            threshold = min(dense[i] for i in path)
            roots = {core} | {i for i in range(1, n) if self.parent[i] in path and i not in path and not self.noise[i] and dense[i] >= threshold and links[i] * 2 < chars[i]}
            # text that stands in an element of the path itself is the article's own
            roots |= {-i - 1 for i in path}
        kept = set()
        for i in range(n):
            if not self.noise[i] and (i in roots or self.parent[i] in kept):
                kept.add(i)
        return kept | {-i - 1 for i in roots if i < 0}, self.tag[core]


def main_text(source: str) -> tuple[str, int, str]:
    """The article's text, its number of blocks, and the tag of the densest element."""
    page = Page(source)
    kept, core = page.core()
    blocks, now = [], []
    for i, t in [*page.text, (-1, "")]:
        if i >= 0:
            if i in kept:
                now.append(t)
        elif now:
            if words := "".join(now).split():
                blocks.append(" ".join(words))
            now = []
    return " ".join(blocks), len(blocks), core


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_blocks, core."""

    def run(batches):
        for batch in batches:
            found = [main_text(h.as_py() or "") for h in column(batch, "html")]
            text = pa.array([f[0] for f in found], pa.string())
            cols = [column(batch, "page_id").cast(pa.int64()), column(batch, "url").cast(pa.string()), text, pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "n_blocks", "core"])

    return pages.select("page_id", "url", "html").mapInArrow(run, OUT)
