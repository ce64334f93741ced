"""HTML extraction by wrapper induction.

Pages of one host are laid over each other by simple tree matching (the largest order-preserving
mapping of two labelled trees). Every page's block-level tree, with runs of equal siblings folded,
is merged into the host's wrapper; each wrapper node is a slot. Over all distinct pages of the host
it is counted which texts each slot holds. A text that SHARE of the pages with the slot have, at
least LEAST of them, is template; the other text varies. (Pages with the same longest block are
copies of one another and count as one, so that copied articles don't look like template.)

The wrapper chooses the content region: from the root it goes down into the container below that
holds DOMINANT of the varying text, as long as that container isn't one of a run of siblings, and
takes along headings and paragraphs that stand before it. A page's text is the varying text of its
nodes in the region. A page that has no node there, or whose host has no other page, gets its region
in the same way from its own text alone.

Priors beside the wrapper: elements whose tag, or whole class, id or role, says that they are one of
the kinds that are never content (DROPPED_TAGS, KINDS) hold no content, and text in main and article
elements weighs MAIN_WEIGHT as much in the choice of the region.

All pages take part: trees are folded and made distinct first, then merged in groups of at most
FAN trees, and the results again, so a host with most of the pages meets in no task; counts are
partial aggregates. A host's wrapper and template texts reach a task once: broadcast while they
have together at most BROADCAST_BYTES, else sorted in front of the host's pages, which are
dealt over tasks. No text is cut and trees may be of any depth.

A null html is an empty page: text "" and n_chars 0. A null or hostless url forms a host of its
own with all such pages. Repeated rows are pages like any other (equal ones count once in the
statistics); ties between containers go to the first. An empty table gives no rows. Other columns
are not looked at."""

from __future__ import annotations

import hashlib
import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import stash

# Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li", "body", "html"}
#: A start tag ends an open element of these kinds ...
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
#: ... unless one of these lies between.
SCOPE = set("ul ol dl table select menu body article section".split())
DROPPED_TAGS = set("nav aside footer form button select option menu dialog script style noscript template iframe textarea title svg head".split())
#: The kinds of parts that are no article, as whole names of elements.
KINDS = set("ad ads advert adverts banner comment comments cookie cookies footer form forms menu menus nav navbar notice notices sidebar".split())
#: Elements that may be the content region, and those that are taken along in front of it.
CONTAINERS = set("html body main article section div center table tbody tr td details".split())
LEADS = set("h1 h2 h3 h4 h5 h6 header hgroup p blockquote figure".split())
SHARE, LEAST, DOMINANT, MAIN_WEIGHT, REPEATED = 0.8, 5, 0.6, 4, 1.25
#: Trees merged in one task at a time, pages of a host in one task, and the most that is broadcast.
FAN, HOST_PAGES, BROADCAST_BYTES = 256, 5_000, 32 << 20
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


# ---------------------------------------------------------------- pages


class Node:
    """A block-level element. texts: (number of the block on the page, text)."""

    __slots__ = ("tag", "name", "names", "children", "texts", "parent", "key", "fold", "slot", "main", "gone", "inside")

    def __init__(self, tag: str, name: str, names: set, parent):
        self.tag, self.name, self.names, self.parent = tag, name, names, parent
        self.children: list[Node] = []
        self.texts: list[tuple[int, str]] = []


def whole_name(name: str) -> set[str]:
    """The words of a class, id or role if each of them is one of KINDS (numbers aside), else the name
    as it is: cookie-banner and comment-12 are of these kinds, no-sidebar is not."""
    words = {w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w and not w.isdigit()}
    return words if words <= KINDS else {name.lower()}


def parse(page: str) -> list[Node]:
    """The block-level elements in page order, the root first, with the text blocks of each. Text
    between two block-level tags is a block; void, raw and misnested tags are as in HTML."""
    root = Node("html", "", set(), None)
    nodes = [root]
    stack: list[Node | str] = [root]  # inline elements stand as their names
    opened: dict[str, int] = {}  # how many elements of each name are on the stack
    here, run, count, at, end = root, [], 0, 0, len(page)

    def flush():
        nonlocal run, count
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run = []
            if text:
                here.texts.append((count, text))
                count += 1

    def name(x) -> str:
        return x.tag if isinstance(x, Node) else x

    def close(depth: int):
        nonlocal here
        for x in reversed(stack[depth:]):
            opened[name(x)] -= 1
            here = x.parent if isinstance(x, Node) else here
        del stack[depth:]

    def find(kinds: set, stop: set) -> int:
        if not any(opened.get(k) for k in kinds):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            tag = name(stack[i])
            if tag in kinds:
                return i
            if tag in stop:
                break
        return 0

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCK or tag == "head":
                flush()
            i = find({tag}, set())
            if i:
                if any(isinstance(x, Node) for x in stack[i:]):
                    flush()
                close(i)
            continue
        if tag in RAW:
            if attrs.rstrip().endswith("/") and tag in ("script", "style"):
                continue
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag in BLOCK or tag == "head":
            flush()
            if tag == "html":
                continue
            if tag in CLOSES_P and (i := find({"p"}, {"button", "table", "td", "th"})):
                close(i)
            if tag in IMPLIED and (i := find(IMPLIED[tag], SCOPE - {tag})):
                close(i)
            found = {k.lower(): v.strip("\"'") for k, v in _NAMES.findall(attrs)}
            names = {x for v in found.values() for n in v.split() for x in whole_name(n)}
            label = (found.get("class", "").split() or found.get("id", "").split() or [""])[0]
            here = Node(tag, re.sub(r"\d+", "", label), names, here)
            here.parent.children.append(here)
            nodes.append(here)
            stack.append(here)
        elif not attrs.endswith("/"):
            stack.append(tag)
        else:
            continue
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    for node in nodes:  # parents come first
        up = node.parent
        node.main = up is not None and (up.main or up.tag in ("article", "main") or up.name == "main")
        node.gone = up is not None and up.gone or dropped(node, node.main)
    return nodes


def dropped(node: Node, in_main: bool) -> bool:
    """Whether the element is by its own tag or names no content; body, main and article never are."""
    if node.tag in DROPPED_TAGS:
        return True
    if node.tag in ("html", "body", "main", "article"):
        return False
    if node.names & KINDS:
        return True
    return not in_main and (node.tag == "header" or "header" in node.names and not node.names & {"article", "entry", "post"})


def folded(nodes: list[Node]) -> tuple[str, list[list[Node]]]:
    """(shape, places): the tree with runs of equal sibling trees as one, in preorder as depth:label
    words, and the nodes that stand at each place of it."""
    keys: dict = {}
    for node in reversed(nodes):  # children come first
        node.fold = []
        for child in node.children:
            if node.fold and node.fold[-1][0].key == child.key:
                node.fold[-1].append(child)
            else:
                node.fold.append([child])
        node.key = keys.setdefault((node.tag, node.name, tuple(g[0].key for g in node.fold)), len(keys))
    words, places, todo = [], [], [(0, [nodes[0]])]
    while todo:
        depth, group = todo.pop()
        words.append(f"{depth}:{group[0].tag}.{group[0].name}")
        places.append(group)
        for i in range(len(group[0].fold) - 1, -1, -1):
            todo.append((depth + 1, [c for g in group for c in g.fold[i]]))
    return " ".join(words), places


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _weight(node: Node, text: str) -> int:
    """What a text counts in the choice of the region."""
    inside = node.main or node.tag in ("article", "main")
    return 0 if node.gone else len(text) * (MAIN_WEIGHT if inside else 1)


# ---------------------------------------------------------------- trees


class Tree:
    """label, kids, size (nodes) and key: trees are equal if their keys in the same `known` are."""

    __slots__ = ("label", "kids", "size", "key")

    def __init__(self, label: str, kids: list["Tree"], known: dict):
        self.label, self.kids, self.size = label, kids, 1 + sum(k.size for k in kids)
        self.key = known.setdefault((label, *[k.key for k in kids]), len(known))

    def places(self, slot: int) -> list[tuple["Tree", int]]:
        """The kids with their preorder numbers, if this node's is slot."""
        return list(zip(self.kids, accumulate([k.size for k in self.kids], initial=slot + 1)))


def tree_of(shape: str, known: dict) -> Tree:
    open_: list[tuple[str, list[Tree]]] = []

    def close(depth: int):
        while len(open_) > depth:
            label, kids = open_.pop()
            tree = Tree(label, kids, known)
            if not open_:
                return tree
            open_[-1][1].append(tree)
        return None

    for word in shape.split(" "):
        depth, label = word.split(":", 1)
        close(int(depth))
        open_.append((label, []))
    return close(0)


def shape_of(tree: Tree) -> str:
    words, todo = [], [(0, tree)]
    while todo:
        depth, node = todo.pop()
        words.append(f"{depth}:{node.label}")
        todo += [(depth + 1, k) for k in reversed(node.kids)]
    return " ".join(words)


def match(a: Tree, b: Tree, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: (nodes of the largest mapping, pairs of kids in it). Equal kids at either
    end are in some largest mapping, so only those between are compared."""
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = (x.key, y.key)
        if key in memo:
            todo.pop()
            continue
        if x.label != y.label:
            memo[key] = (0, [])
            continue
        n, m, head, tail = len(x.kids), len(y.kids), 0, 0
        while head < min(n, m) and x.kids[head].key == y.kids[head].key:
            head += 1
        while tail < min(n, m) - head and x.kids[n - 1 - tail].key == y.kids[m - 1 - tail].key:
            tail += 1
        left, right = x.kids[head : n - tail], y.kids[head : m - tail]
        open_ = {(c.key, d.key): (c, d) for c in left for d in right if c.label == d.label and (c.key, d.key) not in memo}
        if open_:
            todo += open_.values()
            continue
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, c in enumerate(left):
            for j, d in enumerate(right):
                both = memo[c.key, d.key][0] if c.label == d.label else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + both)
        pairs, i, j = [(n - 1 - k, m - 1 - k) for k in range(tail)], len(left), len(right)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((head + i, head + j))
        pairs += [(k, k) for k in range(head - 1, -1, -1)]
        ends = sum(k.size for k in [*x.kids[:head], *x.kids[n - tail :]])
        memo[key] = (1 + ends + best[len(left)][len(right)], pairs[::-1])
    return memo[a.key, b.key]


def merge(wrapper: Tree, tree: Tree, memo: dict, known: dict) -> Tree:
    """The wrapper with the tree laid over it: matched nodes are one, others are put in between."""

    def plan(x: Tree, y: Tree) -> list:
        out, i, j = [], 0, 0
        for p, q in [*match(x, y, memo)[1], (len(x.kids), len(y.kids))]:
            out += x.kids[i:p] + y.kids[j:q]
            if p < len(x.kids):
                out.append((x.kids[p], y.kids[q]))
            i, j = p + 1, q + 1
        return out

    frames = [(wrapper.label, [(wrapper, tree)], [])]
    while True:
        label, items, done = frames[-1]
        if len(done) == len(items):
            frames.pop()
            if not frames:
                return done[0]
            frames[-1][2].append(Tree(label, done, known))
            continue
        item = items[len(done)]
        if isinstance(item, Tree):
            done.append(item)
        elif item[0].key == item[1].key:
            done.append(item[0])
        else:
            frames.append((item[0].label, plan(*item), []))


def aligned(wrapper: Tree, tree: Tree, memo: dict) -> list[int]:
    """The slot of each node of the tree in preorder; -1 where the wrapper has none."""
    out: list[int] = []
    todo: list[tuple] = [(wrapper if wrapper.label == tree.label else None, 0, tree)]
    while todo:
        over, slot, node = todo.pop()
        if over is None:
            out += [-1] * node.size
            continue
        out.append(slot)
        places = over.places(slot)
        to = {j: places[i] for i, j in match(over, node, memo)[1]}
        todo += [(*to.get(j, (None, 0)), node.kids[j]) for j in range(len(node.kids) - 1, -1, -1)]
    return out


def region(tree: Tree, mass: dict[int, int], nodes: dict[int, int], pages: dict[int, int]) -> list[tuple[int, int]]:
    """The content region as (first slot, slot after the last) of its subtrees. mass: weight of each
    slot's own varying text; nodes, pages: how many nodes stand in it, and on how many pages."""
    sums = list(accumulate((mass.get(i, 0) for i in range(tree.size)), initial=0))
    at, slot, leads = tree, 0, []
    while at.kids:
        places = at.places(slot)
        weights = [sums[s + k.size] - sums[s] for k, s in places]
        i = max(range(len(weights)), key=weights.__getitem__)
        kid, place = places[i]
        repeated = nodes.get(place, 0) > REPEATED * pages.get(place, 1)
        if kid.label.split(".")[0] not in CONTAINERS or repeated or weights[i] < DOMINANT * max(sums[slot + at.size] - sums[slot], 1):
            break
        leads += [(s, s + k.size) for (k, s), w in zip(places[:i], weights) if w and k.label.split(".")[0] in LEADS]
        at, slot = kid, place
    return [*leads, (slot, slot + at.size)]


class Template:
    """A host's wrapper, content region and template texts (slot, digest), ready for its pages."""

    def __init__(self, wrapper: str, roots: list[int], constant):
        self.known: dict = {}
        self.tree, self.memo, self.slots = tree_of(wrapper, self.known), {}, {}
        self.region = list(zip(roots[::2], roots[1::2]))
        self.constant = set(constant)

    def place(self, shape: str) -> list[int]:
        if shape not in self.slots:
            if len(self.slots) > 10_000:
                self.slots.clear()
                self.memo.clear()
            self.slots[shape] = aligned(self.tree, tree_of(shape, self.known), self.memo)
        return self.slots[shape]


def extract(page: str, template: Template | None = None) -> list[str]:
    """The content blocks of a page, given its host's template."""
    nodes = parse(page)
    shape, places = folded(nodes)
    slots = template.place(shape) if template else [-1] * len(places)
    constant = template.constant if template else ()
    for slot, group in zip(slots, places):
        for node in group:
            node.slot = slot

    def varies(node: Node, text: str) -> bool:
        return not constant or (node.slot, _digest(text)) not in constant

    numbers, roots = slots, template.region if template else []
    if not roots or roots[-1][0] not in slots:  # the page's own region
        own = [sum(_weight(n, t) for n in group for _, t in n.texts if varies(n, t)) for group in places]
        count = {i: len(group) for i, group in enumerate(places)}
        numbers, roots = range(len(places)), region(tree_of(shape, {}), dict(enumerate(own)), count, {})
    out = []
    for number, group in zip(numbers, places):
        for node in group:  # a node that the wrapper lacks is where its parent is
            above = node.parent is not None and node.parent.inside
            node.inside = any(a <= number < b for a, b in roots) if number >= 0 else above
            if node.inside and not node.gone:
                out += [x for x in node.texts if varies(node, x[1])]
    return [t for _, t in sorted(out)]


# ---------------------------------------------------------------- hosts


def host_column(url="url"):
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def induce(pages: DataFrame) -> DataFrame:
    """host, pages (distinct ones), wrapper (its shape), roots (first and last slots of the region, in
    turn) and constant (array of slot, digest) of every host of two pages or more. pages: url, html."""

    found_schema = "host string, shape string, copy long, width array<int>, texts array<array<long>>, mass array<array<int>>"

    def digest(batches):
        arrow = pa.schema([
            ("host", pa.string()), ("shape", pa.string()), ("copy", pa.int64()), ("width", pa.list_(pa.int32())),
            ("texts", pa.list_(pa.list_(pa.int64()))), ("mass", pa.list_(pa.list_(pa.int32()))),
        ])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for host, page in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    nodes = parse(page or "")
                    shape, places = folded(nodes)
                    once = [{_digest(t): _weight(n, t) for n in group for _, t in n.texts} for group in places]
                    longest = max((t for n in nodes if not n.gone for _, t in n.texts), key=len, default="")
                    rows.append({
                        "host": host, "shape": shape, "copy": _digest(longest), "width": [len(g) for g in places],
                        "texts": [list(x) for x in once], "mass": [list(x.values()) for x in once],
                    })
                yield pa.RecordBatch.from_pylist(rows, arrow)

    found = pages.select(host_column().alias("host"), "html").mapInArrow(digest, found_schema)
    found = stash(found.distinct(), "shapes")  # equal pages count once
    shapes = found.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    counts = shapes.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
    shapes = shapes.join(counts, "host").withColumn("salt", F.pmod(F.xxhash64("shape"), F.col("groups")))
    shapes = stash(shapes, "salted")

    def merged(key, table):
        known: dict = {}
        out, memo = None, {}
        order = sorted(zip(table.column("pages").to_pylist(), table.column("shape").to_pylist()), key=lambda x: (-x[0], x[1]))
        for _, shape in order:
            tree = tree_of(shape, known)
            out = tree if out is None else merge(out, tree, memo, known)
        return pa.table({"host": [key[0].as_py()], "shape": [shape_of(out)], "pages": pa.array([sum(n for n, _ in order)], pa.int64())})

    parts = shapes.groupBy("host", "salt").applyInArrow(merged, "host string, shape string, pages long")
    while True:
        parts = stash(parts, "wrappers")
        several = parts.groupBy("host").agg(F.count("*").alias("n"))
        if (several.agg(F.max("n")).head()[0] or 0) <= 1:
            break
        salt = F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / FAN))
        parts = parts.join(several, "host").withColumn("salt", salt).groupBy("host", "salt").applyInArrow(merged, "host string, shape string, pages long")
    wrappers = parts.where("pages >= 2").select("host", F.col("shape").alias("wrapper"), "pages")

    def place(key, table, wrapper):
        known, memo = {}, {}
        names = table.column("shape").to_pylist()
        if not names or not wrapper.num_rows:
            names, slots = [], []
        else:
            tree = tree_of(wrapper.column("wrapper")[0].as_py(), known)
            slots = [aligned(tree, tree_of(s, known), memo) for s in names]
        host = [key[0].as_py()] * len(names)
        return pa.table({"host": pa.array(host, pa.string()), "shape": pa.array(names, pa.string()), "slots": pa.array(slots, pa.list_(pa.int32()))})

    # A wrapper meets its host's shapes once for each group of them.
    salted = wrappers.join(counts, "host").select("host", "wrapper", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))
    slots = shapes.groupBy("host", "salt").cogroup(salted.groupBy("host", "salt")).applyInArrow(place, "host string, shape string, slots array<int>")
    held = found.join(slots, ["host", "shape"])
    held = held.select("host", "copy", F.explode(F.arrays_zip("slots", "width", "texts", "mass")).alias("x")).select("host", "copy", "x.*").where("slots >= 0")
    seen = held.groupBy("host", "slots").agg(
        F.count("*").alias("on"), F.sum("width").alias("nodes"), F.count_distinct(F.when(F.size("texts") > 0, F.col("copy"))).alias("copies")
    )
    texts = held.select("host", "slots", "copy", F.explode(F.arrays_zip("texts", "mass")).alias("x")).select("host", "slots", "copy", "x.*")
    texts = texts.groupBy("host", "slots", "texts").agg(F.count_distinct("copy").alias("n"), F.sum("mass").alias("mass"))
    # Texts of few copies are no template; they are summed up before they meet their slot's counts.
    rare = texts.where(F.col("n") < LEAST).groupBy("host", "slots").agg(F.sum("mass").alias("rare"))
    often = texts.where(F.col("n") >= LEAST).join(seen.select("host", "slots", "copies"), ["host", "slots"])
    same = F.col("n") >= SHARE * F.col("copies")
    # The template texts of a slot are at most 1 / SHARE times as many as its texts on a page.
    often = often.groupBy("host", "slots").agg(F.sum(F.when(~same, F.col("mass"))).alias("often"), F.collect_list(F.when(same, F.col("texts"))).alias("constant"))
    texts = rare.join(often, ["host", "slots"], "full").withColumn("mass", F.coalesce("rare", F.lit(0)) + F.coalesce("often", F.lit(0)))
    stats = seen.join(texts, ["host", "slots"], "left").select("host", F.struct("slots", "on", "nodes", "mass", "constant").alias("x"))
    stats = stats.groupBy("host").agg(F.collect_list("x").alias("stats"))  # a row for each node of the wrapper

    def choose(batches):
        for batch in batches:
            rows = []
            for host, n, wrapper, stats in zip(*(c.to_pylist() for c in batch.columns)):
                mass, nodes, on = ({x["slots"]: x[k] or 0 for x in stats} for k in ("mass", "nodes", "on"))
                roots = [i for r in region(tree_of(wrapper, {}), mass, nodes, on) for i in r]
                constant = [{"slot": x["slots"], "digest": d} for x in stats for d in x["constant"] or ()]
                rows.append({"host": host, "pages": n, "wrapper": wrapper, "roots": roots, "constant": constant})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("host", pa.string()), ("pages", pa.int64()), ("wrapper", pa.string()), ("roots", pa.list_(pa.int32())),
                ("constant", pa.list_(pa.struct([("slot", pa.int32()), ("digest", pa.int64())]))),
            ]))

    out = wrappers.join(stats, "host").select("host", "pages", "wrapper", "stats").mapInArrow(
        choose, "host string, pages long, wrapper string, roots array<int>, constant array<struct<slot:int,digest:long>>"
    )
    return stash(out, "templates")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(pa.string())), ("text", pa.string())]))


def _template(row) -> Template:
    return Template(row["wrapper"], row["roots"], [(c["slot"], c["digest"]) for c in row["constant"]])


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and blocks (array of the content blocks) of every page."""
    spark, templates = pages.sparkSession, induce(pages)
    out = "page_id long, url string, blocks array<string>, text string"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_column().alias("host"))

    def row(page_id, url, page, template):
        blocks = extract(page or "", template)
        return {"page_id": page_id, "url": url, "blocks": blocks, "text": "\n".join(blocks)}

    size = F.length("wrapper") + 24 * F.size("constant") + 8 * F.size("roots") + F.length("host") + 100
    if (templates.agg(F.sum(size)).head()[0] or 0) <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r["host"]: r.asDict(True) for r in templates.toLocalIterator()})

        def run(batches):
            known: dict[str, Template] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    done = []
                    for page_id, url, page, host in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                        if host not in known and host in shared.value:
                            if len(known) > 200:
                                known.clear()
                            known[host] = _template(shared.value[host])
                        done.append(row(page_id, url, page, known.get(host)))
                    yield _batch(done)

        return rows.mapInArrow(run, out)

    def sorted_run(batches):
        host, template = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                done = []
                for r in batch.slice(at, 64).to_pylist():
                    if r["first"]:
                        host, template = r["host"], _template(r)
                    else:
                        done.append(row(r["page_id"], r["url"], r["html"], template if r["host"] == host else None))
                yield _batch(done)

    salts = templates.select("host", F.ceil(F.col("pages") / HOST_PAGES).alias("salts"))
    rows = rows.join(salts, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1)))).drop("salts")
    first = templates.join(salts, "host").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts", "pages")
    both = rows.withColumn("first", F.lit(False)).unionByName(first.withColumn("first", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("host", "salt").sortWithinPartitions("host", "salt", F.desc("first"))
    return both.mapInArrow(sorted_run, out)
