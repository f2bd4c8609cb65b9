"""Main text of web pages by wrappers: regular expressions without unions, inferred from pages of one host.

A page becomes a well-formed stream of block tags and texts. Within an element, neighbouring equal groups
fold into one repeated group. Streams of one host and template (the kinds of parts that its body has) are
aligned one after the other: where they differ, tags become optional groups and texts become slots. Every
page of a host takes part: tasks align theirs into partial wrappers, which are then aligned with each other.
The wrapper says which of its parts hold the article, by the text that its slots took over all pages; names
of elements only tip the scales. A page is read along its wrapper, and what the wrapper doesn't know is
judged by where it stands.
"""

from __future__ import annotations

import html
import json
import operator
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, join_unique

#: Bytes of wrappers that are broadcast, and of those that a task holds before it hands them on.
BROADCAST_BYTES, HELD_BYTES = 8 << 20, 16 << 20
#: Partial wrappers of one template that are aligned in one group, in a tree of such groups.
MERGE_GROUPS = 16
#: How often the parts between two aligned ones are aligned again.
DEEPEST_GAP = 12
LONGEST_GROUP = 3
#: Distinct pages that a fixed text needs to count as template where nothing names itself the article, at least.
TEMPLATE_PAGES = 3
#: Fixed texts longer than this are kept as a digest.
LONGEST_TEXT = 100
#: Share of the slots' text that one child needs so that the article is looked for below it alone; that an
#: element which names itself the article needs; and under which a part named as no article is none.
DOMINANT, CREDIBLE, MINOR = 0.7, 0.25, 0.3
#: Texts of so many characters count as paragraphs where the article is looked for outside of parts named away.
PARAGRAPH = 20
#: Elements nested deeper belong to the one at this depth.
DEEPEST = 150

# Element names of HTML by their part in a page.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark object picture q s samp small span strike strong sub sup time tt u var video wbr "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics svg circle ellipse g line path polygon rect text tspan".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select button".split())
BOILERPLATE = frozenset("nav header footer aside form fieldset menu dialog head".split())
MAIN = ("article", "main")
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role that name what is no article. Fixed values.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disqus footer form header masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted recommended related respond replies share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Those of them whose parts are dropped at any size; the others may name an article's box as well. Fixed values.
NEVER_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus newsletter promo promoted recommended related respond replies share sharing sidebar social sponsor sponsored subscribe subscription".split()
)
MAIN_WORDS = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NUMBER = re.compile(r"[-_]*[0-9]+[-_0-9]*")
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


class Node:
    """An element: name, words of its class, id and role, and children, which are nodes and texts."""

    __slots__ = ("children", "marks", "name")

    def __init__(self, name: str, marks: tuple[str, ...] = ()):
        self.name, self.marks, self.children = name, marks, []


def _marks(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        # numbered ids tell parts of one kind apart, which is not wanted
        found += _WORD.findall(_NUMBER.sub(" ", value) if m[1].lower() == "id" else value)
    return tuple(sorted(set(found)))


def parse(page: str) -> Node:
    """The page's block elements as a tree; inline markup is gone, unclosed elements end with their parent."""
    root = Node("")
    open_ = [root]
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                open_[-1].children.append(words)

    at, size = 0, len(page)
    lower = None
    too_deep: dict[str, int] = {}
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                lower = page.lower() if lower is None else lower
                # lower-casing may change lengths of some letters; those pages are searched as they are
                end = (lower if len(lower) == size else page).find("</" + name, at)
                at = size if end < 0 else end
            continue
        if name == "br":
            text.append(" ")
        if name in INLINE or name == "br":
            continue
        flush()
        if closing and too_deep.get(name):
            too_deep[name] -= 1
            continue
        if closing:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    del open_[k:]
                    break
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "td", "th", "tr"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, ())
            while len(open_) > 1 and (open_[-1].name == "p" or open_[-1].name in same):
                open_.pop()
        if len(open_) >= DEEPEST:
            too_deep[name] = too_deep.get(name, 0) + (name not in VOID)
            continue
        node = Node(name, _marks(m[3]))
        open_[-1].children.append(node)
        if name not in VOID and not m[3].endswith("/"):
            open_.append(node)
    flush()
    return root


# A wrapper is made of JSON values:
#   {"tag": name, "marks": [...], "in": [parts], "opt": bool, "many": bool} an element,
#   {"text": fixed text or None for a slot, "opt": bool, "size": characters seen, "pages": pages that have it} a text.
# Pages and characters are weighted, a page of m copies by 1 / m.


def fixed(text: str) -> str:
    return text if len(text) <= LONGEST_TEXT else "\0" + xxhash.xxh64_hexdigest(text.encode())


def _key(part: dict) -> tuple:
    return ("text",) if "tag" not in part else (part["tag"], *part["marks"])


def _of(node: Node, weight: float = 1.0) -> dict:
    parts = [{"text": fixed(c), "opt": False, "size": weight * len(c), "pages": weight} if isinstance(c, str) else _of(c, weight) for c in node.children]
    return {"tag": node.name, "marks": list(node.marks), "in": _folded(parts), "opt": False, "many": False}


def _folded(parts: list[dict]) -> list[dict]:
    """Neighbouring equal groups of up to LONGEST_GROUP parts made one repeated group."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[dict] = []
        for part in parts:
            out.append(part)
            if len(out) >= 2 * size and [_key(p) for p in out[-size:]] == [_key(p) for p in out[-2 * size : -size]] and ("text",) not in map(_key, out[-size:]):
                again = out[-size:]
                del out[-size:]
                for k, p in enumerate(again):
                    out[k - size] = _merged(out[k - size], p, max) | {"many": True}
        parts = out
    return parts


def _merged(a: dict, b: dict, count: Callable[[float, float], float]) -> dict:
    """The wrapper of what either accepts; both have one key. count is add for parts of different pages, else max."""
    if "tag" not in a:
        same = a["text"] is not None and a["text"] == b["text"]
        return {"text": a["text"] if same else None, "opt": a["opt"] or b["opt"], "size": a["size"] + b["size"], "pages": count(a["pages"], b["pages"])}
    return {"tag": a["tag"], "marks": a["marks"], "in": _aligned(a["in"], b["in"], count), "opt": a["opt"] or b["opt"], "many": a["many"] or b["many"]}


def _aligned(a: list[dict], b: list[dict], count: Callable[[float, float], float]) -> list[dict]:
    keys_a, keys_b = [_key(p) for p in a], [_key(p) for p in b]
    out: list[dict] = []
    if keys_a == keys_b:
        return [_merged(x, y, count) for x, y in zip(a, b, strict=True)]
    i = j = 0
    for x, y in (*common(keys_a, keys_b), (len(a), len(b))):
        out += [p | {"opt": True} for p in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merged(a[x], b[y], count))
        i, j = x + 1, y + 1
    return _folded(out)


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence, in order: equal ends, then the longest one of the n-th parts of each kind on
    both sides, and what lies between those again. n log n for n parts, but for DEEPEST_GAP repetitions."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, i2, j, j2, depth = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            found.append((i2, j2))
        if i == i2 or j == j2 or depth > DEEPEST_GAP:
            continue
        pairs = _increasing(_numbered(a, i, i2), _numbered(b, j, j2))
        if pairs:
            found += pairs
            edges = [(i - 1, j - 1), *pairs, (i2, j2)]
            todo += [(x + 1, x2, y + 1, y2, depth + 1) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False) if x2 > x + 1 and y2 > y + 1]
    return sorted(found)


def _numbered(keys: list, lo: int, hi: int) -> dict[tuple, int]:
    """(key, how many there were before) -> place."""
    seen: dict = {}
    out = {}
    for k in range(lo, hi):
        n = seen[keys[k]] = seen.get(keys[k], -1) + 1
        out[keys[k], n] = k
    return out


def _increasing(a: dict[tuple, int], b: dict[tuple, int]) -> list[tuple[int, int]]:
    """The longest run of what both have that is in order on both sides."""
    ends: list[int] = []  # the least last place in b of a run of each length
    tips: list[int] = []
    pairs, before = [], []
    for key, x in a.items():
        if (y := b.get(key)) is None:
            continue
        n = bisect_left(ends, y)
        before.append(tips[n - 1] if n else -1)
        ends[n : n + 1], tips[n : n + 1] = [y], [len(pairs)]
        pairs.append((x, y))
    at, out = tips[-1] if tips else -1, []
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def aligned(wrappers: list[dict]) -> dict:
    out = wrappers[0]
    for w in wrappers[1:]:
        out = _merged(out, w, operator.add)
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of a template's pages, aligned one after the other; copies of a page count once."""
    pages = list(dict.fromkeys(pages))
    return judged(aligned([_of(parse(p)) for p in pages] or [_of(parse(""))]), len(pages))


def template(root: Node) -> int:
    """A digest of the kinds of parts that a page's body has."""
    at = root
    while (inner := [c for c in at.children if not isinstance(c, str) and c.name in ("html", "body")]) and at.name != "body":
        at = inner[-1]
    kinds = sorted({(c.name, *c.marks) for c in at.children if not isinstance(c, str)})
    return xxhash.xxh64_intdigest(repr(kinds).encode()) >> 1


def _no_article(tag: str) -> bool:
    """Elements whose meaning in HTML is to be no part of the article."""
    return tag in BOILERPLATE


def _named_away(part: dict) -> bool:
    return not NOT_MAIN.isdisjoint(part["marks"])


def _never(part: dict) -> bool:
    """Whether _flagged has set part aside."""
    return part.get("never", False)


def _flagged(part: dict) -> None:
    """Set aside what names itself comments, adverts and the like, of any size, unless what names itself the article lies inside."""
    for p in part["in"]:
        if "tag" in p:
            if not NEVER_MAIN.isdisjoint(p["marks"]) and not any(map(_mains, p["in"])):
                p["never"] = True
            else:
                _flagged(p)


def _paragraphs(part: dict) -> bool:
    """Whether a slot that isn't set aside takes texts of PARAGRAPH characters on average."""
    if "tag" not in part:
        return part["text"] is None and part["size"] >= PARAGRAPH * part["pages"]
    return not _no_article(part["tag"]) and not _never(part) and any(map(_paragraphs, part["in"]))


def _unflagged(part: dict) -> None:
    for p in part["in"]:
        if p.pop("never", False) is False and "tag" in p:
            _unflagged(p)


def _mass(part: dict) -> float:
    """Characters in the slots below, without parts that are no article."""
    if "tag" not in part:
        return part["size"] if part["text"] is None else 0.0
    return 0.0 if _no_article(part["tag"]) or _never(part) else sum(map(_mass, part["in"]))


def _weight(part: dict) -> float:
    """Mass, by which a part is chosen; a name that speaks against it halves it."""
    return _mass(part) * (0.5 if _named_away(part) else 1.0)


def _mark(part: dict, whole: float) -> None:
    """keep on part and on what is below; not on minor parts that are named as no article."""
    part["keep"] = True
    for p in part.get("in", ()):
        if "tag" in p and (_no_article(p["tag"]) or _never(p) or (_named_away(p) and _mass(p) < MINOR * whole)):
            continue
        _mark(p, whole)


def _mains(part: dict) -> list[dict]:
    """Outermost elements that name themselves the article."""
    if "tag" not in part or _no_article(part["tag"]):
        return []
    inner = [m for p in part["in"] for m in _mains(p)]
    if part["tag"] == "article" or not MAIN_WORDS.isdisjoint(part["marks"]):
        return [part]
    return inner or ([part] if part["tag"] == "main" or "main" in part["marks"] else [])


def judged(wrapper: dict, pages: float) -> dict:
    """keep on each part that holds the article.

    The article is what names itself so, if the slots there took a credible share of all text that varies
    from page to page, and all of it that isn't named away. Else it is the smallest element that took nearly all of that
    text, without the texts that nearly all of so many pages share. The texts of a lone page are all slots.
    """
    if pages < 1.5:
        _open(wrapper)
    _flagged(wrapper)
    if not _paragraphs(wrapper):  # such a part is the box of everything there is
        _unflagged(wrapper)
    total = _mass(wrapper)
    mains = _mains(wrapper)
    named = bool(mains)
    if not mains or sum(map(_mass, mains)) < CREDIBLE * total:
        at, rest = wrapper, total
        while rest and (best := max((p for p in at["in"] if "tag" in p), key=_weight, default=None)) and _mass(best) >= DOMINANT * rest and any("tag" in c for c in best["in"]):
            at, rest = best, _mass(best)
        mains, named = [at], False
    for main in mains:
        _mark(main, sum(map(_mass, mains)))
        for p in () if named else _texts(main):
            if p["text"] is not None and pages > TEMPLATE_PAGES - 0.5 and 10 * p["pages"] >= 9 * pages and total:
                p["keep"] = False
    return wrapper


def _open(part: dict) -> None:
    """Every text below a slot."""
    for p in part["in"]:
        if "tag" in p:
            _open(p)
        else:
            p["text"] = None


def _texts(part: dict) -> Iterator[dict]:
    """Texts below that no page lacks."""
    for p in part.get("in", ()):
        if p["opt"]:
            continue
        if "tag" in p:
            yield from _texts(p)
        else:
            yield p


def read(wrapper: dict, page: str) -> list[str]:
    """Blocks of the page's main text, in order; of a page without any by this wrapper, those by its own."""
    return _read(wrapper, parse(page))


def _read(wrapper: dict | None, root: Node) -> list[str]:
    return (wrapper and _blocks(wrapper, root)) or _blocks(judged(_of(root), 1), root)


def _blocks(wrapper: dict, root: Node) -> list[str]:
    out: list[str] = []

    def children(parts: list[dict], node: Node, keep: bool) -> None:
        # parts are in order; a child takes the next part of its key, and a repeated or passed one again
        at, by_key = 0, {}
        for k, p in enumerate(parts):
            by_key.setdefault(_key(p), []).append(k)
        for c in node.children:
            key = ("text",) if isinstance(c, str) else (c.name, *c.marks)
            places = by_key.get(key, ())
            k = next((k for k in places if k >= at), places[-1] if places else None)
            part = None if k is None else parts[k]
            if part is not None:
                at = max(at, k if part.get("many") or "tag" not in part else k + 1)
            if isinstance(c, str):
                # a fixed text counts as template only where it is that text
                known = keep if part is None or (part["text"] is not None and part["text"] != fixed(c)) else part.get("keep", False)
                if known:
                    out.append(c)
            elif _no_article(c.name) or (part is None and not NOT_MAIN.isdisjoint(c.marks)):
                continue
            elif part is None:
                names_itself = c.name in MAIN or not MAIN_WORDS.isdisjoint(c.marks)
                children([], c, keep or names_itself)
            else:
                children(part["in"], c, part.get("keep", False))

    children(wrapper["in"], root, wrapper.get("keep", False))
    return out


@lru_cache(maxsize=256)
def _wrapper(stored: bytes) -> dict:
    return json.loads(stored)


def _stored(wrapper: dict) -> bytes:
    return json.dumps(wrapper, ensure_ascii=False).encode()


_PARTIAL = "host string, template long, wrapper binary, pages double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "template", "wrapper", "pages"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the pages that a task has of each host and template."""
    held: dict[tuple, list] = {}
    size = 0
    for b in batches:
        for host, page, copies in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            root = parse(page)
            own = _of(root, 1.0 / copies)
            key = (host, template(root))
            if key in held:
                held[key] = [_merged(held[key][0], own, operator.add), held[key][1] + 1.0 / copies]
            else:
                held[key] = [own, 1.0 / copies]
                size += len(page)  # more than its wrapper mostly has
            if size > HELD_BYTES:
                yield _batch([(*k, _stored(w), n) for k, (w, n) in held.items()])
                held, size = {}, 0
    if held:
        yield _batch([(*k, _stored(w), n) for k, (w, n) in held.items()])


def _align(final: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("wrapper").to_pylist(), table.column("pages").to_pylist(), strict=True))
        wrapper, pages = aligned([json.loads(w) for w, _ in rows]), sum(n for _, n in rows)
        first = table.slice(0, 1)
        return pa.Table.from_batches([_batch([(first.column("host")[0].as_py(), first.column("template")[0].as_py(), _stored(judged(wrapper, pages) if final else wrapper), pages)])])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template, wrapper, pages (without copies): one row for each host and template of pages (host, html)."""
    page = F.xxhash64("html").alias("page")
    copies = cut(pages.groupBy("host", page).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    counted = join_unique(pages.select("host", "html", page), copies, ["host", "page"], "copies", pages.count())
    each = counted.select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(_partial, _PARTIAL)
    each = cut(each)
    # a tree: groups of about MERGE_GROUPS partial wrappers, until no template has more
    most = each.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > MERGE_GROUPS:
        most = -(-most // MERGE_GROUPS)
        group = F.pmod(F.xxhash64("wrapper", F.lit(most)), F.lit(most)).alias("g")
        each = each.groupBy("host", "template", group).applyInArrow(_align(False), _PARTIAL)
    return each.groupBy("host", "template").applyInArrow(_align(True), _PARTIAL)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for each row of pages, whole pages.

    Blocks are joined by two line feeds. A null page is empty and has the empty text; pages with a null or
    unreadable url share one host. Rows that repeat an id, or have none, are extracted each. An empty table
    gives no rows; other columns are ignored, whatever they are called.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    found = cut(wrappers(own.select("host", "html")))
    # a page brings its host's wrappers along, of templates that several pages have: a lone page is its own wrapper
    several = found.filter("pages > 1.5")
    known = several.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("template", "wrapper"))).alias("wrappers"), F.sum("pages").alias("weight"))
    size = several.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    small = (1 << 62) if size <= BROADCAST_BYTES else 0
    joined = join_unique(own, cut(known), ["host"], "weight", own.count(), small=small).select("id", "url", "html", "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                texts = []
                for k, page in enumerate(part.column(2).to_pylist()):
                    root = parse(page)
                    own = dict(part.column(3)[k].as_py() or ())
                    stored = own.get(template(root))
                    texts.append("\n\n".join(_read(_wrapper(stored) if stored else None, root)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = joined.mapInArrow(run, f"id {dict(own.dtypes)['id']}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
