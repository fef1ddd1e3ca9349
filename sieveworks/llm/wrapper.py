"""HTML extraction by wrapper induction.

Pages become DOM trees. The pages of a host are grouped by layout, that is by the upper elements that hold their text
outside of articles; layouts of fewer than MIN_PAGES pages, cut off or empty pages among them, join the host's most
frequent one. Each page is aligned with the reference page of its layout by simple tree matching, which gives its elements
and its blocks of text their places in the reference. Over all the layout's different pages, two things are induced:

* regions. An element that repeats a kind of child in numbers that differ from page to page (none of them on CONSTANT of
  the pages) is a varying slot; the outermost such elements are the content, as far as they hold text other than links,
  and what lies around them is the frame, which is template whatever its words are. Only where they hold most of the
  layout's text does this decide.
* constants. A block that holds the same text on at least CONSTANT of the pages that have its place (of MIN_PAGES at
  least) is template; blocks whose text varies are content.

What the page's own marks say refines this: what stands in elements that are never part of an article (menus, headers,
footers, sidebars, forms, scripts, adverts, notices, reader comments) is left out, an article or main part around a region
is content as a whole, and where no region decides (hosts of few pages, pages unlike their host's) the marked article is
taken. A class, id or role tells such an element by a whole token ("sidebar") or one made of such words only
("cookie-notice"); a token that merely has one among others ("has-sidebar", "comments-open") decides nothing. No token drops the
page's body or main part, nor the elements around its only article. With marks=False induction alone decides.

Host statistics cover all pages and are sums over (host, layout, place, value), so that a host with very many pages is
spread over many tasks.

Defined results: null and empty pages have the empty text; pages without an address share the empty host; rows that
repeat are each extracted and count once for their host; unclosed elements end where their parent does, an unclosed tag,
comment or script at the end of the page; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.llm.common import cut

MIN_PAGES, CONSTANT = 8, 0.8
#: Shares of text: of a region to be content, in the largest region's; of all content regions to decide, in the layout's.
REGION, DECISIVE = 0.25, 0.5
#: Bytes of reference pages, and number of hosts, that may be broadcast; beyond them the joins are left to the planner.
BROADCAST_BYTES, BROADCAST_HOSTS = 16_000_000, 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = RAW | frozenset("nav footer aside form head button select option input svg canvas object embed audio video dialog menu map".split())
#: Words in a class, id or role that mark what is not part of an article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond related share sharing social widget toolbar login search pagination pager complementary contentinfo skip".split())
#: Marks of elements whose articles are other ones than the page's, and elements that no mark drops.
FOREIGN = frozenset("hidden ad ads adv advert adverts advertisement advertisements advertising adsense comment comments commentlist disqus reply replies respond related".split())
WHOLE = frozenset("html body main".split())
#: An open element of the key's name ends where an element of one of these names begins.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_PLAIN = re.compile(r"[^A-Za-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "children", "name", "parent", "shape")

    def __init__(self, name, parent, attrs=""):
        self.name, self.parent, self.attrs, self.children, self.shape = name, parent, attrs, [], None


def parse(page: str) -> Node:
    """The tree of a page: nodes, and in their children also strings of text with character references undecoded."""
    root = now = Node("", None)
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            now.children.append(page[at:])
            break
        if lt > at:
            now.children.append(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if re.match(r"</?[A-Za-z]", page[lt : lt + 3]):  # a tag cut off at the end of the page
                break
            now.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        name = name.lower()
        if closing:
            up = now
            while up is not root and up.name != name:
                up = up.parent
            if up is not root:
                now = up.parent
            continue
        while now.name in CLOSES and name in CLOSES[now.name] or now.name not in BLOCK and now is not root and name in BLOCK and _closable(now):
            now = now.parent
        node = Node(name, now, attrs)
        now.children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
        elif name not in VOID and not attrs.endswith("/"):
            now = node
    return root


def _closable(node: Node) -> bool:
    """Whether an inline element stands in a paragraph, which a block would end."""
    while node is not None and node.name not in BLOCK:
        node = node.parent
    return node is not None and node.name == "p"


def _marks(node: Node) -> set[str]:
    """The tokens of MARKS words alone in an element's class, id and role; "hidden" if it is not shown."""
    out: set[str] = set()
    for m in _ATTR.finditer(node.attrs or ""):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id", "role"):
            for token in value.split():
                if _PLAIN.sub("", token).lower() in MARKS:
                    out.add(_PLAIN.sub("", token).lower())
                elif MARKS.issuperset(parts := [w.lower() for w in _SPLIT.split(token) if w and not w.isdigit()]):
                    out.update(parts)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("hidden")
    return out


def _marked(node: Node) -> bool:
    return node.name not in WHOLE and bool(_marks(node))


def _foreign(node: Node) -> bool:
    """Whether an article in it, or it itself, is certainly not the page's."""
    return node.name not in WHOLE and not FOREIGN.isdisjoint(_marks(node))


def _is_main(node: Node) -> bool:
    return node.name == "main" or re.search(r"role\s*=\s*[\"']?main\b", node.attrs or "", re.I) is not None


def _articles(root: Node) -> list[Node]:
    """The outermost elements that a page marks as its article, else as its main part, else those in or with a mark, else the whole page."""
    for wanted, skipped in ((lambda n: n.name == "article", _marked), (_is_main, _marked), (lambda n: n.name == "article", _foreign), (_is_main, _foreign)):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and (node.name in DROPPED or skipped(node)):
                continue
            if wanted(node):
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if not isinstance(c, str)]
        if found:
            return found
    return [root]


def blocks(root: Node, tops: list[Node] | None = None, marks: bool = True) -> list[tuple[Node, str]]:
    """(element, text) of each block of the article, or of the elements tops, in page order; empty blocks are left out."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []

    def flush(owner):
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((owner, text))

    # entries: (node, owner, headings only) or, to end a block, (None, owner, ...)
    for top in tops or (_articles(root) if marks else [root]):
        todo = [(top, top, False)]
        while todo:
            node, owner, only = todo.pop()
            if node is None:
                flush(owner)
                continue
            if isinstance(node, str):
                if not only or owner.name in HEADINGS:
                    parts.append(node)
                continue
            if node is not top and marks:
                if node.name in DROPPED or _marked(node) and node.name not in HEADINGS:
                    continue
                if node.name == "header":
                    only = True
            elif node.name in RAW:
                continue
            if node.name == "br":
                parts.append("\n")
                continue
            if node.name in BLOCK:
                flush(owner)
                todo.append((None, node, False))
                owner = node
            todo += [(c, owner, only) for c in reversed(node.children)]
        flush(top)
    return out


def skeleton(root: Node) -> str:
    """The element names of a tree, as nested text."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(f"{x.name}(")
            todo.append(")")
            todo += [c for c in reversed(x.children) if not isinstance(c, str)]
    return "".join(out)


def from_skeleton(text: str) -> Node:
    root = now = Node("*", None)
    for m in re.finditer(r"([^()]*)\(|\)", text):
        if m.group() == ")":
            now = now.parent
        else:
            node = Node(m.group(1), now)
            now.children.append(node)
            now = node
    return root.children[0] if root.children else root


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def align(page: Node, reference: Node) -> dict[int, Node]:
    """Simple tree matching: id() of page nodes to the reference nodes that they match; the most nodes with equal names and order."""
    for tree in (page, reference):  # shapes from the leaves up
        order, todo = [], [tree]
        while todo:
            n = todo.pop()
            order.append(n)
            todo += _elements(n)
        for n in reversed(order):
            if n.shape is None:
                n.shape = hash((n.name, *(c.shape for c in _elements(n))))
    weights: dict[tuple[int, int], int] = {}

    def size(n):
        key = (id(n), 0)
        if key not in weights:
            total, todo = 0, [n]
            while todo:
                x = todo.pop()
                total += 1
                todo += _elements(x)
            weights[key] = total
        return weights[key]

    def weight(a, b, depth):
        if a.name != b.name:
            return 0
        if a.shape == b.shape:
            return size(a)
        key = (id(a), id(b))
        if key not in weights:
            weights[key] = 1 + (sum(weight(x, y, depth + 1) for x, y in pairs(a, b, depth + 1)) if depth < 200 else 0)
        return weights[key]

    def pairs(a, b, depth):
        """The best order-preserving pairing of two nodes' children."""
        xs, ys = _elements(a), _elements(b)
        head = 0
        while head < min(len(xs), len(ys)) and xs[head].shape == ys[head].shape:
            head += 1
        tail = 0
        while tail < min(len(xs), len(ys)) - head and xs[-1 - tail].shape == ys[-1 - tail].shape:
            tail += 1
        found = list(zip(xs[:head], ys[:head], strict=True)) + [(xs[-1 - k], ys[-1 - k]) for k in range(tail)]
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if xs and ys:
            best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            w = [[weight(x, y, depth) for y in ys] for x in xs]
            for i in range(1, len(xs) + 1):
                row, above, own = best[i], best[i - 1], w[i - 1]
                for j in range(1, len(ys) + 1):
                    row[j] = max(above[j], row[j - 1], above[j - 1] + own[j - 1])
            i, j = len(xs), len(ys)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((xs[i], ys[j]))
        return found

    match: dict[int, Node] = {}
    todo = [(page, reference, 0)]
    while todo:
        a, b, depth = todo.pop()
        if a.name == b.name:
            match[id(a)] = b
            todo += [(x, y, depth + 1) for x, y in pairs(a, b, depth + 1)]
    return match


class Reference:
    """A reference page: its tree, numbered in page order, and where each element's subtree ends."""

    def __init__(self, text: str):
        self.root = from_skeleton(text)
        self.number, self.end, todo = {}, {}, [(self.root, False)]
        while todo:
            n, left = todo.pop()
            if left:
                self.end[self.number[id(n)]] = len(self.number)
                continue
            self.number[id(n)] = len(self.number)
            todo.append((n, True))
            todo += [(c, False) for c in reversed(_elements(n))]

    def places(self, page: Node) -> dict[int, int]:
        """id() of page elements to the numbers of the reference's elements that they match."""
        return {k: self.number[id(n)] for k, n in align(page, self.root).items()}

    def regions(self, varying: list[tuple[int, int]], total: int) -> list[int]:
        """The content among varying slots (number, characters of text other than links), or none if they do not decide."""
        outer, end = [], 0
        for k, plain in sorted(varying):
            if k >= end:
                outer.append((k, plain))
                end = self.end.get(k, k + 1)
        most = max((plain for _, plain in outer), default=0)
        kept = [(k, plain) for k, plain in outer if plain and plain >= REGION * most]
        return [k for k, _ in kept] if kept and kept[0][0] and sum(plain for _, plain in kept) >= DECISIVE * total else []


def _slots(places: dict[int, int], found) -> list[str | None]:
    """For each found block its element's place in the reference and its number among that element's blocks, or None."""
    seen, out = {}, []
    for node, _ in found:
        k = places.get(id(node))
        if k is not None:
            seen[k] = seen.get(k, 0) + 1
        out.append(None if k is None else f"{k}.{seen[k]}")
    return out


def _label(node: Node) -> str:
    """An element's name with those of its classes that have no digits."""
    return ".".join([node.name, *sorted({w for k, *v in _ATTR.findall(node.attrs or "") if k.lower() == "class" for w in "".join(v).split() if not re.search("[0-9]", w)})])


def _repeats(root: Node, places: dict[int, int]) -> list[tuple[int, str, int]]:
    """(place, repeated kinds of children with their numbers, characters of text other than links) of the page's whole, and
    of the elements that have repeated children."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += _elements(n)
    plain: dict[int, int] = {}
    out = []
    for n in reversed(order):
        plain[id(n)] = sum(len(c.strip()) if isinstance(c, str) else 0 if c.name == "a" else plain[id(c)] for c in n.children)
        kinds: dict[str, int] = {}
        if len(n.children) > 1 or n is root:
            for c in _elements(n):
                kinds[_label(c)] = kinds.get(_label(c), 0) + 1
            kinds = {k: v for k, v in kinds.items() if v > 1}
        if n is root or kinds and id(n) in places:
            out.append((places.get(id(n), 0), ",".join(f"{k}={v}" for k, v in sorted(kinds.items())), plain[id(n)]))
    return out


def _tops(root: Node, places: dict[int, int], regions: set[int], marks: bool) -> list[Node]:
    """The page's elements at the regions, or the article or main part around them, in page order; with marks none in
    elements that are never part of an article."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if marks and n is not root and (n.name in DROPPED or _marked(n)):
            continue
        if places.get(id(n)) in regions:
            up = n
            while marks and up is not None and up.name not in ("article", "main"):
                up = up.parent
            if (up or n) not in out:
                out.append(up or n)
        else:
            todo += reversed(_elements(n))
    return out


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class _References(dict):
    """Parsed reference pages by their skeleton text; a bounded memory of one worker."""

    def __missing__(self, text):
        if len(self) > 256:
            self.clear()
        self[text] = Reference(text)
        return self[text]


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def _has_text(root: Node) -> bool:
    todo = [root]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                if not c.isspace():
                    return True
            elif c.name != "head":
                todo.append(c)
    return False


def layout(root: Node, marks: bool = True) -> str:
    """A hash of the block elements, four levels deep and down to articles (without marks three), with their class names; "" without any text."""
    if not _has_text(root):
        return ""
    paths, todo = set(), [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for c in _elements(node):
            if c.name in BLOCK and not (marks and c.name in DROPPED):
                own = f"{path}/{c.name if c.name in ('html', 'body', 'article') else _label(c)}"
                paths.add(own)
                if depth < (3 if marks else 2) and c.name != "head" and not (marks and c.name == "article"):
                    todo.append((c, own, depth + 1))
    return _hash("\n".join(sorted(paths)))


def _with_layout(pages: DataFrame, marks: bool) -> DataFrame:
    """pages with _layout; null and empty pages have the layout of no text."""
    schema = T.StructType([*pages.schema.fields, T.StructField("_layout", T.StringType())])
    at = pages.columns.index("_html")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([layout(parse(h), marks) if h else "" for h in b.column(at).to_pylist()], pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)


def _references(pages: DataFrame, id_col: str, marks: bool) -> DataFrame:
    """_host, _layout, _group, _ref: for each layout of a host of MIN_PAGES pages at least the group whose reference it
    is aligned with, and its skeleton, that of the group's page with the smallest id."""
    w = Window.partitionBy("_host")
    first = Window.partitionBy("_host").orderBy((F.col("_layout") == ""), F.desc("_n"), F.desc("_size"), F.col("_id").asc_nulls_last(), "_layout")
    seen = _with_layout(pages.where(F.col("_html").isNotNull()), marks).groupBy("_host", "_layout").agg(F.count(F.lit(1)).alias("_n"), F.max(F.length("_html")).alias("_size"), F.min(id_col).alias("_id"))
    seen = seen.withColumns({"_all": F.sum("_n").over(w), "_main": F.first("_layout").over(first)}).where(f"_all >= {MIN_PAGES}")
    group = F.when((F.col("_n") >= MIN_PAGES) & (F.col("_layout") != ""), F.col("_layout")).otherwise(F.col("_main"))
    layouts = cut(seen.select("_host", "_layout", group.alias("_group"), "_id"), "layouts")
    wanted = layouts.where("_layout = _group and _layout <> ''").select("_host", "_layout", F.col("_id").alias(id_col))
    small = F.broadcast if layouts.count() <= BROADCAST_HOSTS else (lambda d: d)
    # the id alone narrows the pages before their layouts are found again
    chosen = _with_layout(pages.where(F.col("_html").isNotNull()).join(small(wanted.select("_host", id_col).distinct()), ["_host", id_col], "left_semi"), marks).join(small(wanted), ["_host", "_layout", id_col], "left_semi").select("_host", "_layout", "_html")
    schema = T.StructType([T.StructField("_host", T.StringType()), T.StructField("_group", T.StringType()), T.StructField("_ref", T.StringType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([skeleton(parse(h)) for h in b.column(2).to_pylist()], pa.string())], names=schema.names)

    skeletons = chosen.mapInArrow(run, schema).groupBy("_host", "_group").agg(F.min("_ref").alias("_ref"))
    return layouts.select("_host", "_layout", "_group").join(skeletons, ["_host", "_group"])


def _looked_up(pages: DataFrame, known: DataFrame, columns: list[str], marks: bool):
    """(pages with what a worker needs to find the row of known for a page, and the function that finds it there).

    known, by _host and _layout, goes to the workers as a whole if its texts are small, and a page's layout is found where
    the page is parsed anyway; beyond that the rows are joined."""
    size = known.agg(F.coalesce(F.sum(F.length("_host") + sum((F.length(F.to_json(F.struct(c))) for c in columns), F.lit(64))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        rows = {(r["_host"], r["_layout"]): tuple(r[c] for c in columns) for r in known.select("_host", "_layout", *columns).toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(rows)
        none = (None,) * len(columns)
        return pages, lambda root, batch, i: shared.value.get((batch.column("_host")[i].as_py(), layout(root, marks)), none)
    joined = _with_layout(pages, marks).join(known, ["_host", "_layout"], "left").select(*pages.columns, *columns)
    return joined, lambda root, batch, i: tuple(batch.column(c)[i].as_py() for c in columns)


def _template(pages: DataFrame, references: DataFrame, marks: bool) -> DataFrame:
    """_host, _group, _constant (the place:text hash entries that are template), _varying (the places of varying slots and
    the text in them) and _total (all text)."""
    schema = T.StructType([T.StructField("_host", T.StringType()), T.StructField("_group", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("entries", T.ArrayType(T.StringType())), T.StructField("repeats", T.ArrayType(T.StringType()))])
    rows, find = _looked_up(pages.where(F.col("_html").isNotNull()).select("_host", "_html"), references, ["_group", "_ref"], marks)

    def run(batches):
        known = _References()
        for b in batches:
            hosts, groups, digests, entries, repeats = [], [], [], [], []
            for i, page in enumerate(b.column("_html").to_pylist()):
                root = parse(page)
                group, ref = find(root, b, i)
                if ref is None:
                    continue
                found, places = blocks(root, None, marks), known[ref].places(root)
                hosts.append(b.column("_host")[i].as_py())
                groups.append(group)
                digests.append(_hash("\n\n".join(t for _, t in found)))
                entries.append(sorted({f"{s}:{_hash(t)}" for s, (_, t) in zip(_slots(places, found), found, strict=True) if s}))
                repeats.append([f"{k}:{plain}:{_hash(kinds) if kinds else ''}" for k, kinds, plain in _repeats(root, places)])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(groups, pa.string()), pa.array(digests, pa.string()), pa.array(entries, pa.list_(pa.string())), pa.array(repeats, pa.list_(pa.string()))], names=schema.names)

    key = ["_host", "_group"]
    seen = cut(rows.mapInArrow(run, schema).groupBy(*key, "digest").agg(F.first("entries").alias("entries"), F.first("repeats").alias("repeats")), "entries")  # equal articles count once
    totals = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("total")).where(f"total >= {MIN_PAGES}")
    counts = seen.select(*key, F.explode("entries").alias("entry")).groupBy(*key, "entry").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.substring_index("entry", ":", 1))
    slots = counts.groupBy(*key, "slot").agg(F.sum("n").alias("pages"))  # a page has one text in a slot
    # what is on fewer pages is never constant; without it a slot of many different texts does not meet in one task
    const = counts.where(F.col("n") >= CONSTANT * MIN_PAGES).join(totals, key, "left_semi").join(slots, [*key, "slot"]).where(F.col("n") >= CONSTANT * F.greatest("pages", F.lit(MIN_PAGES)))
    const = const.groupBy(*key).agg(F.array_sort(F.collect_list("entry")).alias("_constant"))
    part = F.split("r", ":")
    kinds = seen.select(*key, F.explode("repeats").alias("r")).groupBy(*key, part[0].cast("int").alias("place"), part[2].alias("kinds")).agg(F.count(F.lit(1)).alias("n"), F.sum(part[1].cast("long")).alias("plain"))
    # pages without an entry for a place have no repeated children there
    per = kinds.groupBy(*key, "place").agg(F.max(F.when(F.col("kinds") != "", F.col("n"))).alias("most"), F.sum(F.when(F.col("kinds") != "", F.col("n"))).alias("some"), F.sum("plain").alias("plain")).join(totals, key)
    per = per.withColumn("varies", F.coalesce(F.greatest("most", F.col("total") - F.col("some")) < CONSTANT * F.col("total"), F.lit(False)))
    varying = per.groupBy(*key).agg(F.max(F.when(F.col("place") == 0, F.col("plain"))).alias("_total"), F.array_sort(F.collect_list(F.when(F.col("varies"), F.struct("place", "plain")))).alias("_varying"))
    return varying.join(const, key, "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """One row per page: id, url, text (blocks joined by empty lines), n_chars."""
    plain = pages.select(F.col(id_col), F.col(url_col), host(url_col).alias("_host"), F.col(html_col).cast("string").alias("_html"))
    references = cut(_references(plain, id_col, marks), "references")
    template = cut(_template(plain, references, marks).join(references, ["_host", "_group"]), "template")  # at most 1 / CONSTANT entries a slot of the reference
    rows, find = _looked_up(plain, template, ["_ref", "_constant", "_varying", "_total"], marks)
    schema = T.StructType([*(rows.schema[c] for c in (id_col, url_col)), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        known = _References()
        for b in batches:
            texts = []
            for i, page in enumerate(b.column("_html").to_pylist()):
                root = parse(page or "")
                ref, constant, varying, total = find(root, b, i)
                regions = set(known[ref].regions([tuple(v.values()) if isinstance(v, dict) else tuple(v) for v in varying or ()], total or 0)) if ref else set()
                places = known[ref].places(root) if constant or regions else {}
                found = blocks(root, _tops(root, places, regions, marks), marks)
                if constant:
                    drop = set(constant)
                    found = [f for s, f in zip(_slots(places, found), found, strict=True) if not s or f"{s}:{_hash(f[1])}" not in drop]
                texts.append("\n\n".join(t for _, t in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
