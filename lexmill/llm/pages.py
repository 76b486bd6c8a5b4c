"""Main text of web pages by wrapper induction.

Pages of a host are parsed to DOM trees, in which successive siblings of one label (tag and class) are one repeated node.
Every page's tree is aligned with that of the host's first page by simple tree matching: the largest common tree that
keeps order and parents. Over all pages of the host, blocks whose text stays constant belong to the template; pages with the same main text count
once there, so a block is not template because whole pages repeat; aligned nodes whose text varies are slots. The slot that holds the article is the content node of the host: an article or main
element if the wrapper has one, else the deepest node with most of the varying text outside of links, menus, headers,
footers, sidebars, notices, adverts and forms. A page's text is what its element at the content node has in blocks that
are not template, page order kept.

Class, id and role words settle what no comparison shows (an advert varies like an article): a block is out if all words of
such a name are of menus, adverts and the like or say nothing; what stands in a line is never out for its name. From four
distinct pages of a host on, a block of half of them is template also within the article.

Cases: null and empty pages give an empty text; a page that does not have the host's content node is judged by its own
tree, and so is a page whose url is null or has no host, which is compared with no other; a host with one page has no
constants; pages without an html skeleton are read as a fragment; broken, unclosed and crossing tags close what they
must, a tag without an end is left out with what follows; pages are used whole, of any depth and length, at a cost in
proportion: a node of over 64 runs of children has one node a label, and long rows of siblings are aligned near the
diagonal; repeated rows give the same text; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pages of a host from which a block can be template, and the share of them that has it.
LEAST_PAGES, SHARE = 4, 0.5

#: What begins a tag, a declaration or a comment.
_BEGUN = re.compile("<[a-zA-Z/!?]")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The attributes of a tag, quoted values whole; never gives back what it has taken.
_INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
#: Characters of a tag in which quotes are heeded; a longer tag, or one with an open quote, ends at its first >.
TAG_CHARS = 1 << 16
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[\s ]+")
#: HTML's elements without content, with text that has no markup, and those that stand in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element of the key ends an open one of these, up to the nearest of its bounds.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Blocks that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that are never part of the main text, and words of a class, id or role that mark such.
OUT_TAGS = frozenset("script style noscript template head nav footer aside form button select option textarea input iframe object svg canvas dialog menu title".split())
OUT_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget header masthead footer cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments disqus pagination pager skip search toolbar contentinfo complementary disclaimer".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
#: Words that say nothing beside such a word; any other makes a class or id of several words another thing.
PLAIN_WORDS = frozenset("area article articles bar block body bottom box btn button buttons center col column container content desktop entry fixed form global group header hidden inner item items large left link links list main mobile outer page panel posts post primary row section secondary site slot small stories sub text top unit widget widgets wrap wrapper zone right".split())
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"([a-z])([A-Z])")


def is_out(token: str) -> bool:
    """Whether a class, id or role names what is never main text: all its words do or say nothing, and it does not end in a word for an article."""
    words = [w for w in _WORD.findall(_HUMP.sub(r"\1 \2", token).lower()) if not w.isdigit()]
    return bool(words) and not OUT_WORDS.isdisjoint(words) and all(w in OUT_WORDS or w in PLAIN_WORDS for w in words) and words[-1] not in ("article", "entry", "post", "story")


class El:
    __slots__ = ("tag", "label", "out", "kids", "hint")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.out, self.hint = tag, [], tag in OUT_TAGS, tag in ("article", "main")
        self.label = tag
        if attrs and not attrs.isspace():
            got = {}
            for k, v in _ATTR.findall(attrs):
                got.setdefault(k.lower(), v.strip("\"'"))
            names = [t for k in ("class", "id", "role") for t in got.get(k, "").split()]
            if got.get("class", "").split():
                self.label = f"{tag}.{got['class'].split()[0]}"
            if names and tag not in ("html", "body", "article", "main"):
                # What stands in a line is part of its sentence, whatever it is called.
                self.out = self.out or tag not in INLINE and any(is_out(t) for t in names)
                self.hint = self.hint or any(not MAIN_WORDS.isdisjoint(_WORD.findall(_HUMP.sub(r"\1 \2", t).lower())) for t in names)
            if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""):
                self.out = True


def tokens(text: str):
    """(text before, tag name or None, whether it ends an element, attributes, where the tag ends) in order; a declaration or comment has no name, a CDATA section's text comes as text. Every character is passed a bounded number of times."""
    at = held = 0
    n = len(text)
    last = text.rfind(">")  # behind it no tag can close
    while True:
        lt = text.find("<", at)
        if lt < 0 or lt > last:
            m = _BEGUN.search(text, lt) if lt >= 0 else None
            yield text[held : m.start() if m else n], None, False, "", n
            return
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            yield text[held:lt], None, False, "", (at := n if end < 0 else end + 3)
        elif text.startswith("<![CDATA[", lt):
            end = text.find("]]>", lt + 9)
            end = n if end < 0 else end
            yield text[held:lt] + _html.escape(text[lt + 9 : end]), None, False, "", (at := min(n, end + 3))
        elif text.startswith(("<!", "<?"), lt):
            yield text[held:lt], None, False, "", (at := text.find(">", lt) + 1)
        else:
            m = _NAME.match(text, lt)
            if m is None:
                at = lt + 1
                continue
            end = _INSIDE.match(text, m.end(), m.end() + TAG_CHARS).end()
            if end >= n or text[end] != ">":
                end = text.find(">", m.end())
            to = yield text[held:lt], m[2].lower(), bool(m[1]), text[m.end() : end], (at := end + 1)
            if to is not None:
                at = to
                yield None
        held = at


def parse(text: str) -> El:
    """The tree of a page: kids are elements and strings (still with their references)."""
    root = El("#page")
    stack, n = [root], len(text)
    open_tags: Counter = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            open_tags[x.tag] -= 1
        del stack[k:]

    walk = tokens(text)
    for before, tag, ends, attrs, at in walk:
        if before:
            stack[-1].kids.append(before)
        if not tag:
            continue
        if ends:
            if open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in ("article", "body", "td", "table", "div", "section", "main") and tag in INLINE:
                        break  # an inline end tag does not close blocks
            continue
        if tag in ("html", "body") and open_tags[tag] > 0:
            continue
        if tag in CLOSES_P and open_tags["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in ENDS and any(open_tags[t] > 0 for t in ENDS[tag][0]):
            own, bound = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bound:
                    break
                if stack[k].tag in own:
                    close(k)
                    break
        el = El(tag, attrs)
        stack[-1].kids.append(el)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            el.kids.append(text[at : end.start() if end else n])
            walk.send(end.end() if end else n)
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(el)
            open_tags[tag] += 1
    return root


def clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", _html.unescape("".join(parts))).strip()


def blocks(el: El) -> list[str]:
    """Texts of an element's blocks in order, without what is never main text."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            t = clean(line)
            line.clear()
            if t:
                out.append(t)

    walk = [(iter(el.kids), False)]
    while walk:
        kids, block = walk[-1]
        for k in kids:
            if type(k) is str:
                line.append(k)
            elif k.out:
                if k.tag not in INLINE:
                    flush()
            elif k.tag == "br":
                line.append(" ")
            else:
                own = k.tag not in INLINE and k.tag != "img"
                if own:
                    flush()
                walk.append((iter(k.kids), own))
                break
        else:
            walk.pop()
            if block:
                flush()
    flush()
    return out


#: Runs of siblings of a node from which all children of a label are one node, whatever stands between them.
MANY_RUNS = 64


class Node:
    """A node of the collapsed tree: all successive siblings of one label."""

    __slots__ = ("label", "els", "kids", "out", "hint", "index")

    def __init__(self, label: str, els: list[El]):
        self.label, self.els, self.kids, self.index = label, els, [], 0
        self.out, self.hint = all(e.out for e in els), any(e.hint for e in els)

    def grow(self) -> None:
        runs: list[tuple[str, list[El]]] = []
        for e in self.els:
            for k in e.kids:
                if type(k) is str or k.tag in INLINE or k.tag in ("br", "head", "script", "style"):
                    continue
                if runs and runs[-1][0] == k.label:
                    runs[-1][1].append(k)
                else:
                    runs.append((k.label, [k]))
        if len(runs) > MANY_RUNS:
            merged: dict[str, list[El]] = {}
            for label, els in runs:
                merged.setdefault(label, []).extend(els)
            runs = list(merged.items())
        self.kids = [Node(a, b) for a, b in runs]


def tree(page: El) -> Node:
    """Nodes are numbered parents first, in page order."""
    root = Node("#page", [page])
    number = 0
    todo = [root]
    while todo:
        x = todo.pop()
        x.index = number
        number += 1
        x.grow()
        todo += reversed(x.kids)
    return root


#: Cells of a table of two nodes' children from which only those near its diagonal are filled, and how near.
TABLE_CELLS, BAND = 1 << 14, 64


def _near(i: int, na: int, nb: int) -> tuple[int, int]:
    """Which children of b row i of the table looks at."""
    if na * nb <= TABLE_CELLS:
        return 0, nb
    mid = i * nb // na
    return max(0, mid - BAND), min(nb, mid + BAND)


def matching(a: Node, b: Node, memo: dict) -> int:
    """Nodes of the largest common tree with a and b as roots (simple tree matching); pairs are worked through children first, without recursion."""
    if a.label != b.label:
        return 0
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        key = (id(x), id(y))
        if key in memo:
            continue
        if not x.kids or not y.kids:
            memo[key] = 1
        elif ready:
            memo[key] = _table(x, y, memo)[-1][-1] + 1
        else:
            todo.append((x, y, True))
            by: dict[str, list[tuple[int, Node]]] = {}
            for j, q in enumerate(y.kids):
                by.setdefault(q.label, []).append((j, q))
            for i, p in enumerate(x.kids):
                lo, hi = _near(i, len(x.kids), len(y.kids))
                todo += [(p, q, False) for j, q in by.get(p.label, ()) if lo <= j < hi]
    return memo[(id(a), id(b))]


def _table(a: Node, b: Node, memo: dict) -> list[list[int]]:
    """Longest common sequence of children, each pair worth its matching, which the memo has."""
    nb = len(b.kids)
    m = [[0] * (nb + 1)]
    for i, x in enumerate(a.kids):
        lo, hi = _near(i, len(a.kids), nb)
        up, best = m[-1], 0
        row = up[: lo + 1] if lo else [0]
        best = row[-1]
        for j in range(lo, hi):
            y = b.kids[j]
            best = max(best, up[j + 1])
            if x.label == y.label:
                best = max(best, up[j] + memo[(id(x), id(y))])
            row.append(best)
        row += [max(best, v) for v in up[hi + 1 :]]
        m.append(row)
    return m


def align(a: Node, b: Node) -> dict[int, Node]:
    """Index of each node of a that simple tree matching aligns -> node of b."""
    memo: dict = {}
    matching(a, b, memo)
    out = {a.index: b}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x.kids or not y.kids:
            continue
        m = _table(x, y, memo)
        i, j = len(x.kids), len(y.kids)
        while i and j:
            if m[i][j] == m[i][j - 1]:
                j -= 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                p, q = x.kids[i - 1], y.kids[j - 1]
                out[p.index] = q
                todo.append((p, q))
                i, j = i - 1, j - 1
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def own_lengths(root: Node) -> dict[int, int]:
    """Length of main text, without white space, less twice that of links, under each node that can hold the article. Each element is summed once, children first."""
    length: dict[int, int] = {}
    todo = [(root.els[0], False, False)]
    while todo:
        x, inside, ready = todo.pop()
        if ready:
            n = 0
            for k in x.kids:
                if type(k) is str:
                    n += len("".join(k.split())) * (-1 if inside else 1)
                else:
                    n += length.get(id(k), 0)
            length[id(x)] = n
        elif not x.out:
            todo.append((x, inside, True))
            todo += [(k, inside or k.tag == "a", False) for k in x.kids if type(k) is not str]
    out = {}
    nodes = [root]
    while nodes:
        x = nodes.pop()
        if x.out:
            continue
        out[x.index] = max(0, sum(length.get(id(e), 0) for e in x.els))
        if x.kids and x.label not in ("ul", "ol", "table", "p"):
            nodes += x.kids
    return out


def content_node(root: Node, length: dict[int, float]) -> int | None:
    """Index of the content node: see the module's text. length: varying text of each node over the pages."""
    total = length.get(root.index, 0)
    if total <= 0:
        return None
    best, todo = None, [root]
    while todo:
        x = todo.pop()
        if x.out or x.index not in length:
            continue
        if x.hint and length[x.index] >= 0.3 * total:
            if best is None or length[x.index] > best[0] or x.label in ("article", "main"):
                best = (length[x.index], x.index)
                if x.label.split(".")[0] == "article":
                    return x.index
        todo += x.kids
    if best is not None:
        return best[1]
    x = root
    while True:
        down = max((k for k in x.kids if not k.out and k.index in length and k.kids), key=lambda k: length[k.index], default=None)
        if down is None or length[down.index] < 0.7 * total:
            return x.index
        x = down


def page_key(root: Node, length: dict[int, int]) -> int:
    """Digest of the text of the page's own content node; of all its text where it has none."""
    own, node, todo = content_node(root, length), root, [root]
    while own is not None and todo:
        x = todo.pop()
        if x.index == own:
            node = x
            break
        todo += x.kids
    return digest("\n".join(t for e in node.els if own is None or not e.out for t in blocks(e)))


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _sources(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    common.small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{html_col}`").alias("_html"), _host(f"`{url_col}`").alias("_host"))


class Wrappers:
    """Parsed first pages of hosts, kept by a task."""

    def __init__(self, most: int = 2000):
        self.most, self.kept = most, {}

    def root(self, host: str, page: str | None) -> Node:
        if host not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[host] = tree(parse(page or ""))
        return self.kept[host]


def induce(src: DataFrame) -> DataFrame:
    """_host, first string (html of the host's first page), pages long, content int (index of the content node; null: none), constants array<long>: a written table.

    Statistics of all pages: each task sums what it sees of a host before the shuffle, so a host of very many pages is
    no hot group; a host's rows after that are bounded by its first page's nodes and by the blocks that half its pages have.
    Blocks are counted over distinct pages, told apart by the text of the page's own content node, copies and mirrors being one.
    """
    src = src.where("_host <> ''")
    first = common.written(src.groupBy("_host").agg(F.min_by("_html", F.struct("_id", "_html")).alias("first"), F.count(F.lit(1)).alias("pages")), "first-pages")
    both = src.select("_host", "_html").join(common.sent_if_small(first.select(F.col("_host").alias("_h"), "first")), F.col("_host") == F.col("_h")).select("_host", "_html", "first")
    schema = pa.schema([("_host", pa.string()), ("node", pa.int32()), ("block", pa.int64()), ("page", pa.int64()), ("n", pa.int64())])

    def run(batches):
        wrappers, seen = Wrappers(), Counter()

        def flush():
            rows = list(seen.items())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.int64()), pa.array([k[3] for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                host, page = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                root = tree(parse(page or ""))
                pairs = align(wrappers.root(host, batch.column(2)[i].as_py()), root)
                length = own_lengths(root)
                for k, x in pairs.items():
                    if x.index in length:
                        seen[(host, k, None, None)] += length[x.index]
                own = page_key(root, length)
                seen[(host, -1, None, own)] = 1
                for d in {digest(t) for t in blocks(root.els[0])}:
                    seen[(host, -1, d, own)] = 1
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    stats = both.mapInArrow(common.tidy(run), "_host string, node int, block long, page long, n long").groupBy("_host", "node", "block", "page").agg(F.sum("n").alias("n"))
    stats = common.written(stats.groupBy("_host", "node", "block").agg(F.sum(F.when(F.col("node") >= 0, F.col("n")).otherwise(1)).alias("n")), "page-counts")
    distinct = common.written(stats.where("node < 0 and block is null").select(F.col("_host").alias("_h"), F.col("n").alias("pages")), "distinct-pages")
    stats = stats.where("node >= 0 or block is not null").join(common.sent_if_small(distinct), F.col("_host") == F.col("_h")).drop("_h")
    kept = stats.where((F.col("node") >= 0) | ((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("pages"))))
    lists = kept.groupBy("_host").agg(F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "n"))).alias("lengths"), F.collect_list(F.when(F.col("node") < 0, F.col("block"))).alias("constants"))
    table = first.join(lists, "_host", "left")

    def choose(batches):
        for batch in batches:
            content = []
            for page, lengths in zip(batch.column("first").to_pylist(), batch.column("lengths").to_pylist()):
                content.append(content_node(tree(parse(page or "")), {x["node"]: x["n"] for x in lengths or []}))
            yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("first"), batch.column("pages"), pa.array(content, pa.int32()), batch.column("constants")], ["_host", "first", "pages", "content", "constants"])

    return common.written(table.select("_host", "first", "pages", "lengths", "constants").mapInArrow(choose, "_host string, first string, pages long, content int, constants array<long>"), "wrappers")


def page_text(page: str | None, first: Node, content: int | None, constants: frozenset[int]) -> str:
    if not page:
        return ""
    root = tree(parse(page))
    node = align(first, root).get(content) if content is not None else None
    if node is None:
        own = content_node(root, own_lengths(root))
        if own is None:
            return ""
        todo = [root]
        while todo:
            x = todo.pop()
            if x.index == own:
                node = x
            todo += x.kids
    found = [t for e in node.els if not e.out for t in blocks(e)]
    return "\n".join(t for t in found if digest(t) not in constants) if constants else "\n".join(found)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text for every row."""
    src = _sources(df, id_col, url_col, html_col)
    wrappers = induce(src)
    side = common.sent_if_small(wrappers.select(F.col("_host").alias("_h"), "first", "content", "constants"))
    both = src.join(side, F.col("_host") == F.col("_h"), "left").select("_id", "_url", "_html", "_host", "first", "content", "constants")
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        kept, constants = Wrappers(), {}
        for batch in batches:
            ids, urls, htmls, hosts, firsts, contents, lists = (batch.column(k) for k in range(7))
            out = []
            for i in range(batch.num_rows):
                host = hosts[i].as_py()
                if host not in kept.kept:
                    constants.pop(host, None)
                first = kept.root(host, firsts[i].as_py())
                if host not in constants:
                    constants[host] = frozenset(lists[i].as_py() or ())
                out.append(page_text(htmls[i].as_py(), first, contents[i].as_py(), constants[host]))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string())], ["_id", "_url", "text"])

    return both.mapInArrow(common.tidy(run), f"_id {kind}, _url string, text string").withColumnsRenamed({"_id": id_col, "_url": url_col})


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    out = main_text(common.documents(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
