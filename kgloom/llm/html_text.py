"""Main text of web pages by a site style tree.

The pages of a host are merged into one style tree. Its element nodes are branches: an element that holds text, told
apart by the labels (tag, id, classes) on its path. Elements that only shape a piece of text (paragraphs, headings,
list items, cells) belong to the element around them, so a branch is a menu, a footer, an advert or an article, not
a heading in it. An element goes if all branches in it go. Importances are entropies over the m distinct pages that a branch is on:

* presentation: with p the shares that its layouts (sequences of the paths of its texts) have of the pages, the entropy
  -sum p log_m p. Articles are laid out in many ways: up to 1. A menu or a footer in one: 0.
* content: a text on n of the pages is spread over them with entropy log_m n; content is one less the mean of that over all texts of
  the branch, each as often as it appears, a page counting a text once. Text of an article is on one page: 1. What all pages share: 0.

A branch's importance is the mean of both. It is low if that lies under a share of the best branch of its host, and low branches are removed
from each page. The share is set by what elements say of themselves: LIMITS. A text outside of articles that stands at
the same place on nearly all pages of the host (less than LEAST_BITS of information) is removed by itself.

What elements say is a prior: the share under which a branch goes. It decides alone in two cases. Elements whose tag or role is that of a menu,
footer, header outside of articles, side bar, dialog or control, hidden ones, and those named as readers' comments (which differ from page to page as
articles do) are noise on any page. And on a host of fewer than SEEN distinct pages, which has no tree, texts of the kind that says most for itself are
kept if they are at least half of the page's text: those in articles, else those without a suspicious name or form around them.
With hints=False nothing of this is used but what is never shown (scripts and the like): all elements are judged alike, by the tree.

Two passes over the pages: the first one gives hashes of branches, layouts and texts, which are counted; the second one
meets the low branches of its host, as a broadcast list if it is small, else by a join that adaptive execution can split.
Texts are never written or shuffled before that. A low branch is on at least SHARED of its host's pages, so a host's list is
no longer than the branches of a few pages.

Defined results: null or empty html, and a page without content, have empty text; a null url is a
host of its own name (empty); copies of a page count once in the tree; hosts of fewer than SEEN distinct pages
have none; repeated pages each give their row; broken markup ends at the end of the page; digits in labels
count as one, so numbered ids are one branch; other columns of the input, whatever their names, don't matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import drop_table, materialize, split_join

#: What is said of an element: noise, a suspicious name or a form, nothing, such a name within an article, an article; and the share of its host's best importance under which it goes.
NOISE, SUSPECT, PLAIN, DOUBTED, ARTICLE = 0, 1, 2, 3, 4
LIMITS = {NOISE: 0.9, SUSPECT: 0.9, PLAIN: 0.8, DOUBTED: 0.4, ARTICLE: 0.2}
#: Share of presentation in the importance of a branch.
LAYOUT = 0.5
#: A text is removed by itself if its place on a page says less than this: on over 87 % of the pages.
LEAST_BITS = 0.2
#: Distinct pages that a host must have to be judged, and the share of them that a branch must be on.
SEEN = 3
SHARED = 0.05
#: Rows, and entries in all, of the list of low branches up to which it is sent to all tasks.
SEND_ROWS, SEND_ENTRIES = 200_000, 2_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Start tags that end an open paragraph, and elements that end an open one of their kind.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an open element to end stops.
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html td".split())
#: Elements that shape texts and belong to the branch around them, where nothing is said against it.
SHAPES = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 hgroup pre blockquote center ul ol li dl dt dd dir table caption thead tbody tfoot tr td th figure figcaption details summary address".split())
DROPPED = frozenset("head title script style noscript template iframe object svg canvas math audio video map".split())
NOISE_TAGS = frozenset("nav footer aside button select textarea dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary dialog alert menu menubar".split())
#: Names of readers' comments, and names that only make an element suspicious.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond feedback".split())
SUSPECT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing social "
    "sidebar widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead toolbar pagination pager login signup signin search copyright legal disclaimer skip".split()
)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_DIGITS = re.compile(r"[0-9]+")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
_TELLING = frozenset("class id style role hidden aria-hidden".split())


def said(tag: str, given: dict[str, str | None], around: int) -> int:
    """What an element in such surroundings says of itself."""
    if "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style") or ""):
        return NOISE
    role = given.get("role")
    names = f"{given.get('class') or ''} {given.get('id') or ''}".lower().split()
    if tag in ("html", "body"):
        return PLAIN
    words = [_WORD.findall(n) for n in names]
    if tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and around < DOUBTED or any(w and (w[0] in COMMENT_WORDS or w[-1] in COMMENT_WORDS) for w in words):
        return NOISE
    if tag in ("article", "main") or role in ("main", "article"):
        return ARTICLE
    if tag in ("form", "fieldset") or role in ("form", "search") or any(x in SUSPECT_WORDS for w in words for x in w):
        return SUSPECT
    return PLAIN


def within(says: int, around: int) -> int:
    """What is said of an element that says so much, in such surroundings."""
    if says == NOISE:
        return NOISE
    if around >= DOUBTED:
        return DOUBTED if says == SUSPECT or around == DOUBTED and says != ARTICLE else ARTICLE
    return SUSPECT if around == SUSPECT and says == PLAIN else says


def _mix(above: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, seed=above)


class PageParser(HTMLParser):
    """Collects (branch, leaf, said, text) of each block: hashes of the paths of its branch and of itself.

    Each start tag costs the same, however deep it lies.
    """

    def __init__(self, hints: bool = True):
        super().__init__(convert_charrefs=True)
        self.hints = hints
        #: tag, path, branch, said; said is -1 for what is dropped
        self.open: list[tuple[str, int, int, int]] = [("", 0, 0, PLAIN)]
        self.count: dict[str, int] = {}
        self.blocks: list[tuple[int, int, int, str]] = []
        self.parts: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """`<![...` is a comment up to the next `>`."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        if _OPEN_TAG.match(self.rawdata):  # the page ends within a tag or a comment
            self.rawdata = ""
        super().close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        _, path, branch, says = self.open[-1]
        if text and says >= NOISE:
            self.blocks.append((branch, path, says, text))

    def end(self, tags: set[str] | frozenset[str], scope: frozenset[str] = frozenset()) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self.flush()
                for t, *_ in self.open[i:]:
                    self.count[t] -= 1
                del self.open[i:]
                return
            if self.open[i][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, path, branch, around = self.open[-1]
        inline = tag in INLINE
        if inline:
            if tag == "br":
                self.parts.append(" ")
            telling = around > 0 and self.hints and any(k in _TELLING for k, _ in attrs)
            if tag in VOID or not telling or said(tag, dict(attrs), around) != NOISE:
                return
        if tag == "body":  # whatever is open in the head ends
            self.end({"head"})
        if tag in ENDS_P:
            self.end({"p"}, SCOPE)
        if tag in SAME:
            self.end(SAME[tag], SCOPE)
        self.flush()
        if tag in VOID:
            return
        _, path, branch, around = self.open[-1]
        given = dict(attrs)
        label = tag
        if given.get("id"):
            label += f"#{given['id']}"
        if given.get("class"):
            label += "." + ".".join(sorted(given["class"].split()))
        own = _mix(path, _DIGITS.sub("0", label))
        if around < 0 or tag in DROPPED:
            says = -1
        elif not self.hints or not around:
            says = around
        else:
            says = within(said(tag, given, around), around)
        self.open.append((tag, own, branch if tag in SHAPES and says == around else own, says))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE and self.open[-1][0] != tag:
            return
        if tag == "p" and not self.count.get("p"):
            self.flush()
            return
        self.end({tag})

    def handle_data(self, data: str) -> None:
        if self.open[-1][3] >= NOISE:
            self.parts.append(data)


def blocks_of(html: str | None, hints: bool = True) -> list[tuple[int, int, int, str]]:
    """(branch, leaf, said, text) of the blocks."""
    parser = PageParser(hints)
    parser.feed(html or "")
    parser.close()
    return parser.blocks


def page_nodes(blocks: list[tuple[int, int, int, str]]) -> tuple[int, list[dict]]:
    """A hash of the page without its noise, and of each of its branches: branch, said, layout, and the content nodes (hashes of place and text)."""
    branches: dict[int, list] = {}
    for branch, leaf, says, text in blocks:
        known = branches.setdefault(branch, [says, xxhash.xxh64(), {}])
        known[1].update(leaf.to_bytes(8, "little"))
        known[2][_mix(leaf, text)] = None
    page, out = xxhash.xxh64(), []
    for branch, (says, layout, texts) in branches.items():
        if says > NOISE:
            page.update(layout.digest() + b"".join(t.to_bytes(8, "little") for t in texts))
        out.append({"branch": _signed(branch), "said": says, "layout": _signed(layout.intdigest()), "texts": [_signed(t) for t in texts]})
    return _signed(page.intdigest()), out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_site(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, html, host, site (a hash of the host) of each page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1))
    return rows.withColumn("host", host).withColumn("site", F.xxhash64("host"))


_NODES = pa.list_(pa.struct([("branch", pa.int64()), ("said", pa.int32()), ("layout", pa.int64()), ("texts", pa.list_(pa.int64()))]))


def nodes(rows: DataFrame, hints: bool = True) -> DataFrame:
    """site, host, page, branches of the distinct pages of each host that have blocks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_nodes(blocks_of(h.as_py(), hints)) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], _NODES)], ["site", "host", "page", "branches"])

    found = rows.select("site", "host", "html").mapInArrow(each, "site long, host string, page long, branches array<struct<branch:long,said:int,layout:long,texts:array<long>>>")
    return found.where(F.size("branches") > 0).dropDuplicates(["site", "host", "page"])


def style_tree(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The branches of all hosts (site, host, branch, said, pages, importance), and their content nodes (site, host, branch, key, said, n).

    presentation: with p the shares that a branch's layouts have of its m pages, the entropy -sum p log_m p.
    content: a text that is on n of the m pages is spread over them with entropy log_m n; one less the mean of that over the branch's texts, each
    as often as it appears. Both are 1 on a single page.
    """
    keys = ["site", "host", "branch"]
    each = seen.select("site", "host", F.explode("branches").alias("b")).select("site", "host", "b.*")
    layouts = each.groupBy(*keys, "layout").agg(F.max("said").alias("said"), F.count("*").alias("n"))
    texts = each.select(*keys, "said", F.explode("texts").alias("key")).groupBy(*keys, "key").agg(F.max("said").alias("said"), F.count("*").alias("n"))
    texts = materialize(texts, "content-nodes")
    n, m = F.col("n"), F.col("pages")
    # sum p ln p = (sum n ln n) / m - ln m
    shape = layouts.groupBy(*keys).agg(F.max("said").alias("said"), F.sum(n).alias("pages"), F.sum(n * F.log(n)).alias("repeats"))
    shape = shape.withColumn("presentation", F.when(m > 1, 1 - F.col("repeats") / (m * F.log(m))).otherwise(1.0))
    content = texts.groupBy(*keys).agg((F.sum(n * F.log(n)) / F.sum(n)).alias("spread"))
    tree = shape.join(content, keys).withColumn("content", F.when(m > 1, 1 - F.col("spread") / F.log(m)).otherwise(1.0))
    return tree.select(*keys, "said", "pages", (LAYOUT * F.col("presentation") + (1 - LAYOUT) * F.col("content")).alias("importance")), texts


def low_nodes(seen: DataFrame) -> DataFrame:
    """site, host, low: the hashes of the low branches and of the low content nodes of each host that has a tree; a written table."""
    tree, texts = style_tree(seen)
    tree = materialize(tree, "style-tree")
    hosts = seen.groupBy("site", "host").agg(F.count("*").alias("of")).where(F.col("of") >= SEEN)
    best = tree.where((F.col("pages") >= SEEN) & (F.col("said") > NOISE)).groupBy("site", "host").agg(F.max("importance").alias("best"))
    hosts = hosts.join(best, ["site", "host"])
    limit = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])[F.col("said")]
    judged = split_join(tree.where(F.col("pages") >= SEEN), hosts, ["site", "host"])
    low = (F.col("importance") < limit * F.col("best")) & (F.col("pages") >= SHARED * F.col("of"))
    branches = judged.where(low).select("site", "host", F.col("branch").alias("node"))
    outside = split_join(texts.where((F.col("n") >= SEEN) & (F.col("said") < ARTICLE)), hosts, ["site", "host"])
    leaves = outside.where(-F.log2(F.col("n") / F.col("of")) < LEAST_BITS).select("site", "host", F.col("key").alias("node"))
    gone = branches.union(leaves).groupBy("site", "host").agg(F.collect_set("node").alias("low"))
    judged = hosts.select(F.col("site").alias("_site"), F.col("host").alias("_host"))
    found = judged.join(gone, (F.col("_site") == gone["site"]) & (F.col("_host") == gone["host"]), "left")
    found = materialize(found.select(F.col("_site").alias("site"), F.col("_host").alias("host"), F.coalesce("low", F.array().cast("array<long>")).alias("low")), "low-nodes")
    for written in (texts, tree):
        drop_table(written)
    return found


def with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """The pages with the list of low nodes of their host, null if it has no tree."""
    size = low.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("entries")).first()
    if size.rows <= SEND_ROWS and size.entries <= SEND_ENTRIES:
        return rows.join(F.broadcast(low), ["site", "host"], "left")
    return split_join(rows, low, ["site", "host"], "left")


def kept_blocks(html: str | None, low: set[int] | None, hints: bool = True) -> tuple[list[str], int, int]:
    """The texts that stay of a page, how many of those that aren't noise the tree has removed, and how many of the rest what elements say.

    low is None on a host without a tree: then the kind of text that says most for itself stays, if it is half of the page's.
    """
    shown = [b for b in blocks_of(html, hints) if b[2] > NOISE]
    if low is not None:
        high = [b[3] for b in shown if _signed(b[0]) not in low and not (b[2] < ARTICLE and _signed(_mix(b[1], b[3])) in low)]
        return high, len(shown) - len(high), 0
    for least in (DOUBTED, PLAIN):
        best = [b[3] for b in shown if b[2] >= least]
        if best and hints and 2 * sum(map(len, best)) >= sum(len(b[3]) for b in shown):
            return best, 0, len(shown) - len(best)
    return [b[3] for b in shown], 0, 0


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_low (blocks that the tree removed), n_said (blocks that it left, and what elements say removed): one row per page."""
    rows = with_site(pages, id_col, url_col, html_col)
    seen = materialize(nodes(rows, hints), "page-nodes")
    low = low_nodes(seen)
    drop_table(seen)
    found = with_low(rows, low).select("id", "url", "html", "low")
    kinds = dict(found.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [kept_blocks(h.as_py(), set(low.as_py()) if low.is_valid else None, hints) for h, low in zip(b.column(2), b.column(3))]
            text = ["\n".join(x) for x, _, _ in kept]
            counts = [[len(t) for t in text], [n for _, n, _ in kept], [n for _, _, n in kept]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["page_id", "url", "text", "n_chars", "n_low", "n_said"])

    return found.mapInArrow(each, f"page_id {kinds['id']}, url {kinds['url']}, text string, n_chars long, n_low long, n_said long")
