"""HTML main-text extraction by wrapper induction.

Pages become trees of block elements (inline elements melt into the text around
them); runs of sibling elements with one label (paragraphs, list items, table rows) are
folded into one node, so a template with a varying number of repeats still aligns.

Every host has up to ``PIVOTS`` pivot pages, one of each of its commonest tree shapes.  A page is
aligned by simple tree matching with the pivot that it matches best.  Over all
pages of the host we count, for each pivot node and each text in it, on how many different pages
it stands: texts that most pages with the node agree on are template, all others fill slots.  (Pages are different
if what stands in their fullest nodes is: copies of a page count once, so that they do not make its article template.)
The host's content region is the node below which the slot text is: from the root down, as long as one
child holds most of it and no prose stands beside that child.

What tells slots apart where votes cannot (reader comments vary like an article does) is a vocabulary of element names that say
they are something else: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, reader comments.  Such elements are no content unless hardly any slot text stands elsewhere.
``article`` and the like decide only between children of which neither holds most, and for pages whose host has
too few pages, or which match no pivot's region.

Defined results: null or empty html gives empty text; a page without any block
outside such elements gives empty text; a null url counts as one host; pages and texts of any
length and depth are read whole; of shapes equally common the one of the least page comes first; repeated
rows each get their row; an empty table gives an empty table; other columns, whatever their names, are carried or not looked at.
Malformed markup never fails: unknown end tags are ignored, open elements end
with their parents, text after an unfinished tag is kept as text.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm import textops as X
from seriesloom.llm.common import bounded, forget, keep, tidy

PIVOTS = 4  # tree shapes of a host that pages are aligned with
CONSTANT = 0.8  # a text is template if it stands on so large a share of the different pages that have the node
LEAST_PAGES = 5  # and on so many; fewer pages tell no region either
MOST = 0.8  # a child that holds so large a share of the slot text holds the region
SIDE_SHARE = 0.95  # elements that say they are something else are believed unless they hold more of the slot text
WIDE = 1 << 20  # products of numbers of children above which equal labels are matched in order instead of best

# Element names and the words that class, id and role use for what is not the article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NEVER = RAW | set("head nav footer aside form button select option datalist dialog menu menuitem object audio video canvas map fieldset input search".split())
MAIN_WORDS = set("articlebody main content maincontent postcontent entrycontent articlecontent storybody".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments disqus reply replies respond pagination pager "
    "toolbar widget copyright disclaimer skip hidden".split()
)
NOT_SIDE = set("has with no without".split())
PROSE = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_SCOPE = {"button", "td", "th", "table", "caption", "object", "html", "body"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_CLOSE = {t: re.compile("</" + t, re.I) for t in RAW}


class Node:
    """A block element: ``items`` are texts (each a block of its own) and child nodes, in page order."""

    __slots__ = ("tag", "label", "items", "parent", "side", "main")

    def __init__(self, tag, label, parent, side, main):
        self.tag, self.label, self.items, self.parent, self.side, self.main = tag, label, [], parent, side, main


def _attributes(tag: str, raw: str) -> tuple[str, bool, bool]:
    """Label of an element, whether it says it is not the article, and whether it says it is."""
    if not raw or raw.isspace():
        return tag, tag in NEVER, tag in ("article", "main")
    names, side, main = [], tag in NEVER, tag in ("article", "main")
    for m in _ATTR.finditer(raw):
        key, value = m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role", "itemprop"):
            names.append(value)
            if key == "role":
                side |= value.strip() in ROLES
                main |= value.strip() in ("main", "article")
            elif key != "itemprop" and tag not in ("html", "body", "main"):
                for word in value.split():
                    parts = _PARTS.findall(word)
                    if parts and parts[0] not in NOT_SIDE and any(p in SIDE_WORDS for p in parts):
                        side = True
            if key in ("id", "class", "itemprop"):
                main |= any("".join(_PARTS.findall(w)) in MAIN_WORDS for w in value.split())
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            side = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            side = True
    return _NUMBER.sub("#", tag + "".join("." + n for n in names)), side, main


def parse(page: str | None) -> Node:
    """The block tree of a page; ``side`` holds for everything below an element that says it is something else."""
    root = Node("#root", "#root", None, False, False)
    stack, node, pending = [(None, root)], root, []
    open_ = Counter()  # tags on the stack
    inside = 0  # articles on the stack
    page = page or ""
    pos, last = 0, page.rfind(">")

    def flush():
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                node.items.append(text)

    def add(text):
        # a character reference does not go on beyond markup
        pending.append(_html.unescape(text) if "&" in text else text)

    def pop_to(k):
        nonlocal node, inside
        for name, n in stack[k:]:
            open_[name] -= 1
            if n is not None:
                flush()
                node = n.parent
                inside -= name in ("article", "main")
        del stack[k:]

    def close(tags, scopes):
        if any(open_[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return pop_to(k)
                if stack[k][0] in scopes:
                    return None

    while True:
        m = _TOKEN.search(page, pos) if pos <= last or "<!" in page[pos:] else None
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            close({tag}, ())
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in RAW:
            end = _CLOSE[tag].search(page, pos)
            if end is None:
                break
            shut = page.find(">", end.end())
            pos = len(page) if shut < 0 else shut + 1
            continue
        if tag in CLOSES_P:
            close({"p"}, P_SCOPE)
        if tag in SAME_LEVEL:
            close(SAME_LEVEL[tag], SCOPES[tag])
        if tag in VOID:
            continue
        open_[tag] += 1
        if tag in INLINE:
            stack.append((tag, None))
            continue
        flush()
        label, side, main = _attributes(tag, m[3] or m[6] or "")
        if tag == "header" and not inside:
            side = True
        inside += tag in ("article", "main")
        new = Node(tag, label, node, node.side or side, main)
        node.items.append(new)
        stack.append((tag, new))
        node = new
    flush()
    return root


def text_key(text: str) -> int:
    """64-bit name of a text."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def fold(root: Node) -> list[dict]:
    """Tree nodes, parents first, with runs of equal labels folded: label, parent, members, kids, own texts."""
    out = [{"label": root.label, "parent": -1, "members": [root]}]
    at = 0
    while at < len(out):
        cur = out[at]
        kids = []
        for member in cur["members"]:
            for item in member.items:
                if isinstance(item, Node):
                    if kids and kids[-1]["label"] == item.label:
                        kids[-1]["members"].append(item)
                    else:
                        kids.append({"label": item.label, "parent": at, "members": [item]})
        cur["kids"] = list(range(len(out), len(out) + len(kids)))
        cur["texts"] = [i for m in cur["members"] for i in m.items if isinstance(i, str)]
        out.extend(kids)
        at += 1
    return out


def skeleton(tree: list[dict]) -> dict:
    """What alignment and the choice of a region need of a folded tree."""
    first = [n["members"][0] for n in tree]
    return {"labels": [n["label"] for n in tree], "kids": [n["kids"] for n in tree], "side": [n.side for n in first], "main": [n.main for n in first], "prose": [n.tag in PROSE for n in first]}


def shape(tree: list[dict]) -> int:
    return text_key(json.dumps([[n["label"] for n in tree], [len(n["kids"]) for n in tree]]))


def _rows(a: dict, b: dict, i: int, j: int, weight: dict) -> list[list[int]]:
    """Table of the best matchings of the first kids of (i, j)."""
    x, y = a["kids"][i], b["kids"][j]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p, u in enumerate(x):
        row, new = table[p], table[p + 1]
        for q, v in enumerate(y):
            best = row[q + 1] if row[q + 1] > new[q] else new[q]
            got = weight.get((u, v))
            if got and row[q] + got > best:
                best = row[q] + got
            new[q + 1] = best
    return table


def _in_order(a: dict, b: dict, i: int, j: int) -> list[tuple[int, int]]:
    """Kids of (i, j) with equal labels, each with the next one that is left."""
    places: dict[str, list[int]] = {}
    for v in reversed(b["kids"][j]):
        places.setdefault(b["labels"][v], []).append(v)
    out, last = [], -1
    for u in a["kids"][i]:
        left = places.get(a["labels"][u], [])
        while left and left[-1] <= last:
            left.pop()
        if left:
            last = left.pop()
            out.append((u, last))
    return out


def align(a: dict, b: dict) -> list[tuple[int, int]]:
    """Simple tree matching of two skeletons: pairs of nodes in the largest matching that keeps order and parents.

    Without recursion, however deep the trees are; kids of very wide nodes are matched in order.
    """
    todo = [(0, 0)]
    for i, j in todo:
        if len(a["kids"][i]) * len(b["kids"][j]) > WIDE:
            todo += _in_order(a, b, i, j)
        else:
            by: dict[str, list[int]] = {}
            for v in b["kids"][j]:
                by.setdefault(b["labels"][v], []).append(v)
            todo += [(u, v) for u in a["kids"][i] for v in by.get(a["labels"][u], ())]
    weight: dict[tuple[int, int], int] = {}
    for i, j in reversed(todo):
        wide = len(a["kids"][i]) * len(b["kids"][j]) > WIDE
        weight[i, j] = 1 + (sum(weight[k] for k in _in_order(a, b, i, j)) if wide else _rows(a, b, i, j, weight)[-1][-1])
    pairs = [(0, 0)]
    for i, j in pairs:
        if len(a["kids"][i]) * len(b["kids"][j]) > WIDE:
            pairs += _in_order(a, b, i, j)
            continue
        x, y = a["kids"][i], b["kids"][j]
        table = _rows(a, b, i, j, weight)
        p, q = len(x), len(y)
        while p and q:
            if table[p][q] == table[p - 1][q]:
                p -= 1
            elif table[p][q] == table[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                pairs.append((x[p], y[q]))
    return pairs


class Aligner:
    """Alignments with the pivots of a host (a JSON list of skeletons); pages of one shape are aligned once."""

    def __init__(self):
        self.pivots, self.shapes = {}, {}

    def __call__(self, pivots: str, tree: list[dict]) -> tuple[int, list[tuple[int, int]]]:
        """The pivot that most nodes match (the first of equals), and the pairs of nodes."""
        if len(self.pivots) > 256 or len(self.shapes) > 4096:
            self.pivots, self.shapes = {}, {}
        if pivots not in self.pivots:
            self.pivots[pivots] = json.loads(pivots)
        key = (pivots, shape(tree))
        if key not in self.shapes:
            page = skeleton(tree)
            found = [(k, align(p, page)) for k, p in enumerate(self.pivots[pivots])]
            # nodes of the pivot that the page lacks count against it
            self.shapes[key] = max(found, key=lambda f: (2 * len(f[1]) - len(self.pivots[pivots][f[0]]["labels"]), -f[0]))
        return self.shapes[key]


def region(pivot: dict, slots: dict[int, int]) -> int:
    """The pivot node below which the slot text (characters per node) is, or -1 without any."""
    def below(counts):
        total = [counts(i) for i in range(len(pivot["labels"]))]
        for i in range(len(total) - 1, -1, -1):
            total[i] += sum(total[k] for k in pivot["kids"][i])
        return total

    all_, plain = below(lambda i: slots.get(i, 0)), below(lambda i: 0 if pivot["side"][i] else slots.get(i, 0))
    if not all_[0]:
        return -1
    believed = plain[0] >= (1 - SIDE_SHARE) * all_[0]
    mass, at = plain if believed else all_, 0
    while True:
        kids = [k for k in pivot["kids"][at] if mass[k] and not (believed and pivot["side"][k])]
        best = max(kids, key=lambda k: mass[k], default=None)
        if best is None or not pivot["kids"][best] and pivot["prose"][best] or slots.get(at, 0) > (1 - MOST) * mass[at]:
            return at
        beside = [k for k in kids if k != best]
        if mass[best] < MOST * mass[at]:
            # neither holds most: what says it is the article
            named = [k for k in kids if pivot["main"][k]]
            if len(named) != 1:
                return at
            best = named[0]
        elif any(pivot["prose"][k] for k in beside) or pivot["prose"][best]:
            return at
        at = best


def blocks(nodes: list[Node], template: set[tuple[int, int]], owner: dict[int, int], sides: bool) -> list[str]:
    """Texts below some nodes in page order, without template texts and (unless ``sides``) elements that say they are something else."""
    out, todo = [], [(n, None) for n in reversed(nodes)]
    top = {id(n) for n in nodes}
    while todo:
        cur, parent = todo.pop()
        if isinstance(cur, str):
            if not template or (owner.get(id(parent), -1), text_key(cur)) not in template:
                out.append(cur)
        elif sides or not cur.side or id(cur) in top:
            todo.extend((i, cur) for i in reversed(cur.items))
    return out


def alone(root: Node, template: set[tuple[int, int]], owner: dict[int, int]) -> str:
    """Main text of a page that no region is known for: its articles, or else the container of most of its text."""
    size: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        cur = todo.pop()
        order.append(cur)
        todo.extend(i for i in reversed(cur.items) if isinstance(i, Node))
    for n in reversed(order):
        own = 0 if n.side else sum(len(i) for i in n.items if isinstance(i, str) and not (template and (owner.get(id(n), -1), text_key(i)) in template))
        size[id(n)] = own + sum(size[id(i)] for i in n.items if isinstance(i, Node))
    for found in ([n for n in order if n.tag == "article" and not n.side], [n for n in order if n.main and not n.side]):
        inner = {id(n) for n in found}
        outer = []
        for n in found:
            up = n.parent
            while up is not None and id(up) not in inner:
                up = up.parent
            if up is None:
                outer.append(n)
        if sum(size[id(n)] for n in outer):
            return "\n".join(blocks(outer, template, owner, False))
    best = root
    while size[id(root)]:
        inner = [n for n in best.items if isinstance(n, Node) and not n.side and any(isinstance(i, Node) for i in n.items) and size[id(n)] >= MOST * size[id(root)]]
        if not inner:
            break
        best = inner[0]
    return "\n".join(blocks([best], template, owner, False))


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit("")))


def _shapes(batches):
    """(host, key, html) -> (host, key, shape)."""
    for batch in batches:
        for at, part in X.pieces(batch.column(2), 1 << 20):
            cut = batch.slice(at, len(part))
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array([shape(fold(parse(p))) for p in part.to_pylist()], pa.int64())], ["host", "key", "shape"])


def _skeletons(batches):
    for batch in batches:
        rows = [json.dumps(skeleton(fold(parse(p)))) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.string())], ["host", "rank", "pivot"])


def _votes(batches):
    """(host, html, pivots) -> for every pivot node and text (null: any text) its characters, by page."""
    aligner = Aligner()
    for batch in batches:
        for at, part in X.pieces(batch.column(1), 1 << 20):
            cut = batch.slice(at, len(part))
            cols: list[list] = [[], [], [], [], [], []]
            for h, page, pivots in zip(cut.column(0).to_pylist(), part.to_pylist(), cut.column(2).to_pylist()):
                tree = fold(parse(page))
                k, pairs = aligner(pivots, tree)
                # pages are told apart by what stands in the node with most text
                which = text_key("\n".join(max((n["texts"] for n in tree), key=lambda t: (sum(map(len, t)), t))))
                for i, j in pairs:
                    texts = tree[j]["texts"]
                    if texts:
                        for text in [None, *dict.fromkeys(texts)]:
                            n = sum(map(len, texts)) if text is None else len(text)
                            for col, x in zip(cols, (h, k, i, None if text is None else text_key(text), which, n)):
                                col.append(x)
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "rank", "node", "text", "page", "n"])


def _regions(batches):
    """(host, pivots, nodes) -> (host, pivots, regions, template) ."""
    for batch in batches:
        rows = []
        for pivots, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            skeletons = json.loads(pivots)
            slots: list[dict[int, int]] = [{} for _ in skeletons]
            pages = [0] * len(skeletons)
            template = []
            for x in nodes or []:
                slots[x["rank"]][x["node"]] = x["chars"]
                pages[x["rank"]] = max(pages[x["rank"]], x["pages"])
                template += [[x["rank"], x["node"], t] for t in x["texts"]]
            regions = [region(p, s) if n >= LEAST_PAGES else -1 for p, s, n in zip(skeletons, slots, pages)]
            # told as well: whether elements that say they are something else are to be believed
            rows.append(json.dumps({"regions": regions, "template": template}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.string())], ["host", "pivots", "rules"])


def induce(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """One wrapper per host: its pivots' skeletons, the region of each, and the texts in pivot nodes that are template."""
    bounded(pages.sparkSession)
    src = pages.select(host(url).alias("host"), F.col(key).cast("string").alias("key"), F.col(html).cast("string").alias("html")).filter("html is not null and html != ''")
    shapes = src.mapInArrow(tidy(_shapes), "host string, key string, shape bigint").groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("first"))
    # numbers of rows, not rows, are ranked, and Spark keeps only the first of each host before it deals them out
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "first", "shape"))
    chosen = keep(shapes.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).select("host", (F.col("rank") - 1).alias("rank"), F.col("first.key").alias("key")), "shapes")
    few = chosen.count() <= 200_000
    same = [F.col("s.host") == F.col("c.host"), F.col("s.key").eqNullSafe(F.col("c.key"))]
    picked = src.alias("s").join((F.broadcast(chosen) if few else chosen).alias("c"), same[0] & same[1]).groupBy("c.host", "c.rank").agg(F.min("s.html").alias("html"))
    pivots = picked.select("host", "rank", "html").mapInArrow(_skeletons, "host string, rank int, pivot string").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "pivot"))).alias("p"))
    # (a key that several rows have may stand for two ranks, or for none of its shape; order is all that matters)
    pivots = keep(pivots.select("host", F.concat(F.lit("["), F.array_join(F.col("p.pivot"), ","), F.lit("]")).alias("pivots")), "pivots")
    votes = src.join(_beside(pivots), "host").select("host", "html", "pivots").mapInArrow(tidy(_votes), "host string, rank int, node int, text bigint, page bigint, n bigint")
    # copies of a page vote once, however many there are
    once = votes.groupBy("host", "rank", "node", "text", "page").agg(F.max("n").alias("n"))
    per_text = keep(once.groupBy("host", "rank", "node", "text").agg(F.count("*").alias("pages"), F.sum("n").alias("chars")), "votes")
    node = ["host", "rank", "node"]
    every = per_text.filter("text is null").select(*node, F.col("pages").alias("of"), "chars")
    fixed = per_text.filter((F.col("text").isNotNull()) & (F.col("pages") >= LEAST_PAGES)).join(every.select(*node, "of"), node).filter(F.col("pages") >= CONSTANT * F.col("of"))
    fixed = fixed.groupBy(*node).agg(F.collect_list("text").alias("texts"), F.sum("chars").alias("fixed"))
    slots = every.join(fixed, node, "left").select("host", F.struct("rank", "node", F.greatest(F.col("chars") - F.coalesce("fixed", F.lit(0)), F.lit(0)).alias("chars"), F.col("of").alias("pages"), F.coalesce("texts", F.array().cast("array<bigint>")).alias("texts")).alias("x"))
    ruled = pivots.join(slots.groupBy("host").agg(F.collect_list("x").alias("nodes")), "host", "left").select("host", "pivots", "nodes")
    out = keep(ruled.mapInArrow(_regions, "host string, pivots string, rules string"), "wrappers")
    for t in (chosen, pivots, per_text):
        forget(t)
    return out


def _beside(hosts: DataFrame) -> DataFrame:
    """A table of hosts for a join with pages: broadcast if it has at most 32 MB, so that a hot host's pages stay where they are."""
    size = hosts.agg(*[F.sum(F.length(c)) for c in hosts.columns if c != "host"]).first()
    return F.broadcast(hosts) if sum(x or 0 for x in size) <= 32 << 20 else hosts


def apply(pages: DataFrame, wrappers: DataFrame, carry: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """``text``, ``n_chars`` and ``by_wrapper`` (whether a region of the host gave the text) beside carried columns for every page."""
    src = pages.select(F.struct(*carry).alias("carried"), host(url).alias("host"), F.col(html).cast("string").alias("html"))
    joined = src.join(_beside(wrappers), "host", "left").select("carried", "html", "pivots", "rules")

    def run(batches):
        aligner, known = Aligner(), {}
        for batch in batches:
            for at, part in X.pieces(batch.column(1), 1 << 20):
                cut = batch.slice(at, len(part))
                if len(known) > 256:
                    known.clear()
                rows = [main_text(p, v, r, aligner, known) for p, v, r in zip(part.to_pylist(), cut.column(2).to_pylist(), cut.column(3).to_pylist())]
                texts = [t for t, _ in rows]
                new = [pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64)), pa.array([b for _, b in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays([cut.column(0), *new], ["carried", "text", "n_chars", "by_wrapper"])

    schema = joined.select("carried").schema.add("text", "string").add("n_chars", "long").add("by_wrapper", "boolean")
    return joined.mapInArrow(tidy(run), schema).select("carried.*", "text", "n_chars", "by_wrapper")


def main_text(page: str | None, pivots: str | None = None, rules: str | None = None, aligner: Aligner | None = None, known: dict | None = None) -> tuple[str, bool]:
    """Main text of a page, and whether its host's wrapper gave it."""
    if not page:
        return "", False
    root = parse(page)
    template: set[tuple[int, int]] = set()
    owner: dict[int, int] = {}
    if pivots and rules:
        known = {} if known is None else known
        if rules not in known:
            got = json.loads(rules)
            texts: dict[int, set] = {}
            for k, i, t in got["template"]:
                texts.setdefault(k, set()).add((i, t))
            known[rules] = got["regions"], texts
        tree = fold(root)
        k, pairs = (aligner or Aligner())(pivots, tree)
        regions, texts = known[rules]
        template = texts.get(k, set())
        owner = {id(m): i for i, j in pairs for m in tree[j]["members"]}
        where = next((j for i, j in pairs if i == regions[k]), None)
        if where is not None:
            nodes = tree[where]["members"]
            # within a region that lies in an element that says it is something else, the vocabulary is not believed
            found = blocks(nodes, template, owner, nodes[0].side)
            if found:
                return "\n".join(found), True
    return alone(root, template, owner), False
