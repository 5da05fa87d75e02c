"""Main text of web pages by inferred union-free regular expressions (wrappers).

A page becomes a tree of elements and text slots. A wrapper is such a tree whose children are a regular expression without
unions: items in order, each once, optional, repeated, or both; an item is one kind of element or a group of kinds. Pages
of a host are aligned one after the other: items that only one side has become optional, and what comes back at another
place folds, with all that stands between, into a repeated group. So kinds stand once under their parent, and a wrapper
grows with the kinds of its host, not with its pages. Under a parent of more than `KINDS` kinds, kinds are tags alone.

Each slot keeps what its texts have in common over all pages, how many distinct pages have it (up to three), and its
length. Text that all of three or more distinct pages repeat in their slot is the host's template and goes; what varies
is content. The main region is the element that holds the varying text: an article or main element that varies, else the
smallest container of two thirds of it, outside of what the HTML standard sets aside. Class, id and role names are hints:
one drops an element only if the wrapper gives that element less than a third of the region's text.

Wrappers are aligned in the map tasks, then in salted parts of a host, then for the host, so that a hot host is neither
collected nor aligned in one task. Null html and pages without main text give an empty text. A null url is a host of its
own. Repeated pages each get a row and count once in a wrapper. Broken markup is read as far as its tags end; unclosed
elements end with their parent; below `DEPTH` open elements text belongs to the last of them. Pages are held one at a
time, whole. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marlstone.llm import common

# Elements of the HTML standard by their role.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "title", "iframe")
ASIDE = frozenset("head nav header footer aside form button select option script style noscript template svg iframe dialog textarea label fieldset menu object video audio canvas title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd blockquote pre ul ol dl table".split())
MAIN = ("article", "main")
#: Names by which authors mark what is not content, and names that only tell of layout beside them.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe widget complementary contentinfo search alert".split()
)
LAYOUT = frozenset("area bar block bottom box buttons button container content global group inner item items left link links list main page primary right secondary section site top wrap wrapper".split())

KINDS, DEPTH, PAGES = 40, 60, 3
BROADCAST_BYTES = 32 << 20

_ATTRS = r"(?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<raw>" + "|".join(RAW) + rf")\b(?:{_ATTRS}|[^<>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|</(?P<close>[a-zA-Z][\w:-]*)[^>]*>|<(?P<open>[a-zA-Z][\w:-]*)(?P<attrs>{_ATTRS}(?=>)|[^<>]*(?=>)|(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*(?=>))>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_AGAIN = frozenset("li dt dd tr td th option".split())


def hinted(name: str) -> bool:
    """Whether one class, id or role is a hint: all of its words, not just one of them."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return bool(HINTS.intersection(parts)) and all(x in HINTS or x in LAYOUT for x in parts)


class Slot:
    """The texts directly inside one kind of element: size in all pages, what all share, up to PAGES digests of pages."""

    __slots__ = ("chars", "links", "count", "shared", "pages")

    def __init__(self, chars=0, links=0, count=0, shared=None, pages=()):
        self.chars, self.links, self.count, self.pages = chars, links, count, list(pages)
        self.shared = {int(k): n for k, n in (shared or {}).items()}

    def join(self, other: Slot) -> None:
        if self.pages and other.pages:
            self.shared = {k: n for k, n in self.shared.items() if k in other.shared}
        else:  # one page: its own texts
            self.shared |= other.shared
        self.chars, self.links, self.count = self.chars + other.chars, self.links + other.links, self.count + other.count
        self.pages = sorted({*self.pages, *other.pages})[:PAGES]

    def fixed(self) -> bool:
        """Whether all of three or more distinct pages share at least half of these texts."""
        return len(self.pages) >= PAGES and 2 * self.count * sum(self.shared.values()) >= self.chars

    def varying(self) -> int:
        """Characters outside links that are not the template's."""
        return 0 if self.fixed() else max(0, self.chars - self.links)


class Node:
    """An element: its kind, its children as a list of [mark, nodes], and its slot."""

    __slots__ = ("kind", "items", "slot")

    def __init__(self, kind: str):
        self.kind, self.items, self.slot = kind, [], None

    @property
    def tag(self) -> str:
        return self.kind.split(".", 1)[0].split("#", 1)[0].split("@", 1)[0]

    def children(self):
        return (n for _, nodes in self.items for n in nodes)

    def add(self, child: Node) -> None:
        """One more child element of a page, folded at once."""
        self.items = _fold([*self.items, ["", [child]]])

    def regex(self) -> str:
        """The wrapper in writing, such as <body>(<p>#</p>)+</body>."""
        parts = "".join((f"({x})" if mark else x) + mark for mark, nodes in self.items for x in ["".join(f"({n.regex()})?" if len(nodes) > 1 else n.regex() for n in nodes)])
        return f"<{self.kind}>" + ("#" if self.slot else "") + parts + f"</{self.tag}>"

    def dump(self) -> list:
        s = self.slot
        slot = [s.chars, s.links, s.count, s.shared, s.pages] if s else None
        return [self.kind, slot, [[m, [n.dump() for n in nodes]] for m, nodes in self.items]]

    @classmethod
    def load(cls, data: list) -> Node:
        node = cls(data[0])
        if data[1]:
            node.slot = Slot(*data[1])
        node.items = [[m, [cls.load(n) for n in nodes]] for m, nodes in data[2]]
        return node


def _both(a: str, b: str) -> str:
    """The mark of an item with mark a on one side and b on the other."""
    optional, repeated = "?" in (a, b) or "*" in (a, b), "+" in (a, b) or "*" in (a, b)
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def _optional(mark: str) -> str:
    return _both(mark, "?")


def _union(groups: list[list[Node]]) -> list[Node]:
    out: dict[str, Node] = {}
    for nodes in groups:
        for n in nodes:
            if n.kind in out:
                align(out[n.kind], n)
            else:
                out[n.kind] = n
    return list(out.values())


def _fold(items: list) -> list:
    """Fold what stands twice, with all between, into a repeated group: kinds are unique afterwards."""
    place: dict[str, int] = {}
    out: list = []
    for mark, nodes in items:
        at = min((place[n.kind] for n in nodes if n.kind in place), default=len(out))
        if at == len(out):
            out.append([mark, nodes])
        else:
            marks = [m for m, _ in out[at:]] + [mark]
            every = "*" if all(m in ("?", "*") for m in marks) else "+"
            out[at:] = [[every, _union([x for _, x in out[at:]] + [nodes])]]
        for n in out[at][1]:
            place[n.kind] = at
    return out


def _coarse(items: list) -> list:
    """Children by tag alone, and without names if even tags are too many."""
    for name in (lambda n: n.tag, lambda n: "*"):
        if sum(len(nodes) for _, nodes in items) <= KINDS:
            break
        for _, nodes in items:
            for n in nodes:
                n.kind = name(n)
        items = _fold([[m, _union([nodes])] for m, nodes in items])
    return items


def align(a: Node, b: Node) -> Node:
    """Widen wrapper a, so that it covers b as well; b is used up."""
    if b.slot:
        if a.slot:
            a.slot.join(b.slot)
        else:
            a.slot = b.slot
    x, y = a.items, b.items
    if y and not x:
        a.items = [[_optional(m), n] for m, n in y]
    elif x and not y:
        a.items = [[_optional(m), n] for m, n in x]
    elif x and y:
        kx, ky = ["|".join(n.kind for n in nodes) for _, nodes in x], ["|".join(n.kind for n in nodes) for _, nodes in y]
        if kx == ky:
            a.items = [[_both(m, w), _union([n, v])] for (m, n), (w, v) in zip(x, y)]
        else:
            out: list = []
            for what, i, j, k, m in SequenceMatcher(None, kx, ky, autojunk=False).get_opcodes():
                if what == "equal":
                    out += [[_both(s, t), _union([n, v])] for (s, n), (t, v) in zip(x[i:j], y[k:m])]
                else:
                    out += [[_optional(s), n] for s, n in x[i:j] + y[k:m]]
            a.items = _fold(out)
    if sum(len(nodes) for _, nodes in a.items) > KINDS:
        a.items = _coarse(a.items)
    return a


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _kind(tag: str, attrs: str) -> tuple[str, bool]:
    """(kind, hidden): the tag with its class, id and role names, without digits."""
    kind, found, hidden = tag, {}, False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        found.setdefault(name, value)
        if tag not in ("html", "body") and (name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", ""))):
            hidden = True
    names = sorted({re.sub(r"[^a-z_-]+", "", x).strip("-_") for x in found.get("class", "").split()} - {""})[:4]
    own = re.sub(r"[^a-z_-]+", "", found.get("id", "")).strip("-_")
    if names:
        kind += "." + ".".join(names)[:60]
    if own and (not names or hinted(own)):
        kind += "#" + own[:40]
    if found.get("role"):
        kind += "@" + re.sub(r"[^a-z]+", "", found["role"])[:20]
    return kind, hidden


def scan(page: str) -> tuple[list[tuple[tuple[str, ...], str]], Node | None]:
    """The blocks of a page, (kinds from the outside, text), and its tree; (blocks, None) where it has no text."""
    root = Node("")
    stack: list[tuple[str, Node, bool]] = []  # tag, node, set aside
    blocks: list[tuple[tuple[str, ...], str]] = []
    held: list[str] = []
    at = linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text and not (stack and stack[-1][2]):
            node = stack[-1][1] if stack else root
            if node.slot is None:
                node.slot = Slot()
            node.slot.join(Slot(len(text), min(linked, len(text)), 0, {_hash(text): len(text)}))
            blocks.append((tuple(n.kind for _, n, _ in stack), text))
        linked = 0

    def close() -> None:
        _, node, _ = stack.pop()
        (stack[-1][1] if stack else root).add(node)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m["open"] or m["close"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:-3])
            continue
        attrs = m["attrs"] or ""
        if tag in INLINE:
            if tag == "a":
                in_link = bool(m["open"])
            if tag == "br":
                held.append(" ")
            if m["open"]:
                if tag in VOID or not _kind(tag, attrs)[1]:
                    continue
            elif not (stack and stack[-1][0] == tag):
                continue
        flush()
        if m["open"]:
            if stack and stack[-1][0] == "p" and tag not in INLINE or stack and stack[-1][0] == tag and tag in _AGAIN:
                close()
            if tag not in VOID and not attrs.rstrip().endswith("/") and len(stack) < DEPTH:
                kind, hidden = _kind(tag, attrs)
                inside = any(t in MAIN for t, _, _ in stack)
                aside = hidden or (tag in ASIDE and not (tag == "header" and inside)) or bool(stack and stack[-1][2])
                stack.append((tag, Node(kind), aside))
        elif any(t == tag for t, _, _ in stack):
            while stack[-1][0] != tag:
                close()
            close()
    held.append(page[at:])
    flush()
    while stack:
        close()
    if not blocks:
        return blocks, None
    digest = _hash("\0".join(text for _, text in blocks))

    def sign(node: Node) -> None:
        if node.slot:
            node.slot.count, node.slot.pages = 1, [digest]
        for n in node.children():
            sign(n)

    sign(root)
    return blocks, root


def _paths(node: Node, path: tuple[str, ...] = ()):
    """(path, node) of every element below the root, from the outside to the inside."""
    for n in node.children():
        yield (*path, n.kind), n
        yield from _paths(n, (*path, n.kind))


def _total(node: Node, measure) -> int:
    return (measure(node.slot) if node.slot else 0) + sum(_total(n, measure) for n in node.children())


def _prose(node: Node) -> int:
    """Varying text below a node, but headings."""
    return 0 if node.tag in HEADINGS else (node.slot.varying() if node.slot else 0) + sum(map(_prose, node.children()))


def _key(path: tuple[str, ...]) -> int:
    return _hash("/".join(path))


def plan(wrapper: Node) -> dict:
    """What extraction needs of a wrapper: region, template, dropped elements, main kind, parents with coarse kinds."""
    every = list(_paths(wrapper))
    body = lambda s: s.chars

    def outermost(tag: str):
        found = [(p, n) for p, n in every if n.tag == tag]
        return [(p, n) for p, n in found if not any(p != q and p[: len(q)] == q for q, _ in found)]

    regions: list[tuple[tuple[str, ...], Node]] = []
    sizes = {tag: sum(_prose(n) for _, n in outermost(tag)) for tag in MAIN}
    for tag in sorted(MAIN, key=lambda t: 3 * sizes["article"] < sizes["main"] and t == "article"):
        regions = [(p, n) for p, n in outermost(tag) if _total(n, body)]
        if regions and (sizes[tag] or not _prose(wrapper)):
            break
        regions = []
    dense = not regions
    if dense:
        path, node = (), wrapper
        while True:
            inside = max(node.children(), key=_prose, default=None)
            if inside is None or inside.tag in LEAVES or 3 * _prose(inside) < 2 * _prose(node) or not _prose(node):
                break
            path, node = (*path, inside.kind), inside
        regions = [(path, node)]
    size = sum(_total(n, body) for _, n in regions)
    drop = []
    for path, n in every:
        if any(path[: len(p)] == p and path != p for p, _ in regions):
            text = _total(n, body)
            names = re.split(r"[.#@]", n.kind)[1:]
            links = dense and n.tag not in LEAVES and text and 5 * _total(n, lambda s: s.links) > 4 * text
            if links or (any(map(hinted, names)) and 3 * text <= size):
                drop.append(_key(path))
    template = [
        _key(path) ^ text for path, n in [((), wrapper), *every] if n.slot and len(n.slot.pages) >= PAGES for text in n.slot.shared
    ]
    main = 0
    if dense:
        path, node = regions[0]
        best = max(node.children(), key=_prose, default=None)
        if best is not None and _prose(best):
            main = _key((*path, best.kind))
    coarse = [_key(path) for path, n in [((), wrapper), *every] if len(list(n.children())) and all(c.kind in (c.tag, "*") for c in n.children())]
    return {"region": [_key(p) for p, _ in regions if p], "drop": drop, "template": template, "main": main, "depth": len(regions[0][0]) if dense else 0, "coarse": coarse}


_EMPTY = {"region": [], "drop": [], "template": [], "main": 0, "depth": 0, "coarse": []}


def _resolve(path: tuple[str, ...], known: set[int], coarse: set[int]) -> list[int]:
    """The keys of the elements of a path; under a coarse parent by tag."""
    out, now = [], ()
    for kind in path:
        if _key(now) in coarse:
            tag = Node(kind).tag
            kind = tag if kind == tag or _key((*now, kind)) not in known else kind
        now = (*now, kind)
        out.append(_key(now))
    return out


def extract(page: str | None, how: dict | None = None) -> str:
    """The text of a page by the plan of its host's wrapper."""
    how = how or _EMPTY
    region, drop, template, coarse = (set(how[k]) for k in ("region", "drop", "template", "coarse"))
    known = region | drop | {how["main"]}
    resolved: dict[tuple[str, ...], list[int]] = {}
    blocks = []
    for path, text in scan(page or "")[0]:
        keys = resolved.get(path)
        if keys is None:
            keys = resolved[path] = _resolve(path, known, coarse)
        blocks.append((path, keys, text))
    if region:
        inside = [b for b in blocks if region.intersection(b[1])]
        blocks = inside or blocks
    blocks = [b for b in blocks if not drop.intersection(b[1])]
    own = [b for b in blocks if ((b[1][-1] if b[1] else _key(())) ^ _hash(b[2])) not in template]
    # A page of nothing but its host's template has that as its text.
    blocks = own or blocks
    if how["main"]:
        run = [k for k, b in enumerate(blocks) if how["main"] in b[1]]
        if run:
            # Beside the main run stand headings and whole sentences; labels and menus are short.
            blocks = [
                b for k, b in enumerate(blocks)
                if run[0] <= k <= run[-1] or len(b[2]) >= 80 or b[2][-1] in ".!?…。" or any(Node(x).tag in HEADINGS for x in b[0])
            ]
    return "\n".join(b[2] for b in blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def infer(pages: DataFrame, salts: int = 16, hosts: int = 2000) -> DataFrame:
    """(host, wrapper as JSON, its plan as JSON) of every host; a map task holds the wrappers of at most `hosts` hosts."""

    def write(found: dict[str, Node]):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(n.dump()) for n in found.values()], pa.string())], ["host", "wrapper"])

    def map_side(batches):
        found: dict[str, Node] = {}
        for batch in batches:
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = scan(p or "")[1]
                if tree is None:
                    continue
                if h in found:
                    align(found[h], tree)
                    continue
                if len(found) >= hosts:
                    yield write(found)
                    found = {}
                found[h] = tree
        yield write(found)

    def join_sorted(batches):
        """Rows come sorted by host: align them as they arrive, holding one wrapper."""
        now, node = None, None
        for batch in batches:
            for h, text in zip(*(batch.column(k).to_pylist() for k in (batch.schema.get_field_index("host"), batch.schema.get_field_index("wrapper")))):
                new = Node.load(json.loads(text))
                if h != now:
                    if now is not None:
                        yield write({now: node})
                    now, node = h, new
                else:
                    align(node, new)
        if now is not None:
            yield write({now: node})

    def plans(batches):
        for batch in batches:
            got = [json.dumps(plan(Node.load(json.loads(w)))) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], ["host", "wrapper", "plan"])

    schema = "host string, wrapper string"
    first = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(map_side, schema)
    # A salt is worth its task only where a host comes from many map tasks.
    salted = first.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")

    def join_salted(batches):
        def renamed():
            for batch in batches:
                names = [f"{h}\0{s}" for h, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], ["host", "wrapper"])

        for batch in join_sorted(renamed()):
            yield pa.RecordBatch.from_arrays([pa.array([h.rsplit("\0", 1)[0] for h in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["host", "wrapper"])

    parts = salted.select("host", "wrapper", "salt").mapInArrow(join_salted, schema)
    whole = parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(join_sorted, schema)
    return common.stored(whole.mapInArrow(plans, "host string, wrapper string, plan string"), "wrappers")


def main_text(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, how in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if how is not None and how not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[how] = json.loads(how)
                texts.append(extract(page, known.get(how)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    plans = wrappers.select("host", "plan")
    size = plans.agg(F.sum(F.length("host") + F.length("plan"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        plans = F.broadcast(plans)
    # Beyond that size both sides are dealt by host, and the adaptive skew join splits the pages of a hot host.
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    return rows.join(plans, "host", "left").select("page_id", "url", "html", "plan").mapInArrow(run, "page_id long, url string, text string, n_chars long")
