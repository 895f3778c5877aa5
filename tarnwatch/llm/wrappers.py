"""HTML main text by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream (tags with their class, and text slots) is well-formed after implied ends are added, so it is kept as a
tree. A wrapper is such a tree with repeated and optional groups. Two streams are aligned level by level: neighbours of one
kind are folded into a repeated group, what only one side has becomes an optional group, and all text at a place is one
slot. Aligning is done by pieces of a host's pages first and then over the pieces, on distinct streams, so a host of any
size takes part with all its pages and no task holds them.

Every slot then knows its share of the host's text and whether the text there varies between pages. The wrapper's main group is
the article or main element if there is one, else the innermost group that holds most of the varying text. A page's text
are the slots under that group, without menus, headers, footers, sidebars, notices, adverts, forms and comments.

Defined results: a null or empty html has empty text; pages without a host (null url) share one wrapper; unclosed, misnested
or cut tags end where their parent ends; a page without the main group of its host is judged by itself; blocks are
separated by block elements and line breaks; equal rows get equal texts; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnwatch.llm.batches import small_batches
from tarnwatch.llm.urls import url_parts
from tarnwatch.plans.freeze import freeze

PIECES = 16                 # pieces of a host that are aligned by themselves
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var".split())
# Elements that an opening tag of one of these ends, up to the nearest of their holders.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
           "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu button fieldset object audio video canvas head".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_.-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe|subscription|paywall|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|topbar|comments?|commentlist|discussion|disqus|respond|reply|replies|related|recommended|share|sharing|"
    r"social|widget|toolbar|pagination|pager|skip|login|signup|search|complementary|contentinfo|form)(?:$|[\s_.-])", re.I)
MAIN = re.compile(r"(?:^|[\s_.-])(?:main|articlebody|article-body|post-content|entry-content|story-body)(?:$|[\s_.-])", re.I)


def signature(tag: str, attributes: str) -> str:
    """Tag with its class, id and role; numbers don't count."""
    if not attributes:
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(SPACE.sub(" ", re.sub(r"\d+", "", found.get(k, ""))).strip() for k in ("class", "id", "role", "itemprop"))
    names = SPACE.sub(" ", names).strip().replace("/", "").replace(">", "")
    return f"{tag} {names}" if names else tag


def is_boilerplate(sig: str, path: tuple[str, ...]) -> bool:
    tag, _, names = sig.partition(" ")
    inside = any(p.split(" ")[0] == "article" for p in path)
    if tag in BOILERPLATE_TAGS or (tag == "header" and not inside):
        return True
    return tag not in ("html", "body", "main") and bool(names) and bool(BOILERPLATE.search(names))


def is_main(sig: str) -> bool:
    tag, _, names = sig.partition(" ")
    return tag in ("article", "main") or bool(names and MAIN.search(names))


def read(html: str) -> tuple[list, list[tuple[tuple[str, ...], bool, str]]]:
    """The tree of a page ([signature, children], with "#" for text), and its blocks: (path, boilerplate, text)."""
    root: list = ["", []]
    stack, path, shut = [root], [], [False]
    blocks, words = [], []

    def flush() -> None:
        if words:
            text = SPACE.sub(" ", unescape("".join(words))).strip()
            words.clear()
            if text:
                blocks.append((tuple(path), shut[-1], text))
                if not stack[-1][1] or stack[-1][1][-1] != "#":
                    stack[-1][1].append("#")

    def leave(depth: int) -> None:
        flush()
        del stack[depth + 1:], path[depth:], shut[depth + 1:]

    for token in TOKEN.finditer(html):
        tag = token[3]
        if tag is None:
            if token[1] is None and not token[0].startswith(("<!", "<?", "</")):
                words.append(token[0])
            continue
        tag = tag.lower()
        if tag == "br":
            flush()
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if token[2]:
            for depth in range(len(path) - 1, -1, -1):
                if path[depth].split(" ", 1)[0] == tag:
                    leave(depth)
                    break
            else:
                flush()
            continue
        flush()
        for depth in range(len(path) - 1, -1, -1):      # a block ends an open paragraph
            name = path[depth].split(" ", 1)[0]
            if name == "p":
                leave(depth)
                break
            if name in ("td", "li", "div", "article", "section"):
                break
        if tag in IMPLIED:
            ends, holders = IMPLIED[tag]
            for depth in range(len(path) - 1, -1, -1):
                name = path[depth].split(" ", 1)[0]
                if name in holders.split():
                    break
                if name in ends.split():
                    leave(depth)
                    break
        sig = signature(tag, token[4])
        node = [sig, []]
        stack[-1][1].append(node)
        shut.append(shut[-1] or is_boilerplate(sig, tuple(path)))
        stack.append(node)
        path.append(sig)
        if token[4].rstrip().endswith("/") and tag not in ("p", "div"):
            leave(len(path) - 1)
    flush()
    return root, blocks


# --- wrappers: [signature, "1" | "?" | "+" | "*", children]; slots are ["#", kind, []] -----------------------------------

OPTIONAL = {"1": "?", "?": "?", "+": "*", "*": "*"}
REPEATED = {"1": "+", "?": "*", "+": "+", "*": "*"}


def _either(a: str, b: str) -> str:
    repeated, optional = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if optional else "+") if repeated else ("?" if optional else "1")


def _walk(first):
    """The result of a walk that yields the walks it waits for. They are kept in a list, so no depth of a page is too large."""
    stack, got = [first], None
    while stack:
        try:
            stack.append(stack[-1].send(got))
            got = None
        except StopIteration as done:
            stack.pop()
            got = done.value
    return got


def wrapped(tree) -> list:
    """A page's tree as a wrapper: neighbours of one kind are one repeated group."""
    return _walk(_wrapped(tree))


def align(a: list, b: list) -> list:
    """The least wrapper that both fit: slots and groups that only one side has become optional."""
    return _walk(_align(a, b))


def _wrapped(tree):
    if tree == "#":
        return ["#", "1", []]
    children = []
    for child in tree[1]:
        children.append((yield _wrapped(child)))
    return [tree[0], "1", (yield _folded(children))]


def _folded(children: list):
    out: list = []
    for child in children:
        if out and out[-1][0] == child[0]:
            both = yield _align(out[-1], child)
            out[-1] = [both[0], REPEATED[both[1]], both[2]]
        elif len(out) >= 2 and out[-2][0] == child[0] and out[-1][1] in "?*":
            both = yield _align(out[-2], child)         # a child, something optional, the child again
            out[-2] = [both[0], REPEATED[both[1]], both[2]]
        else:
            out.append(child)
    return out


def _align(a: list, b: list):
    return [a[0], _either(a[1], b[1]), (yield _folded((yield _aligned(a[2], b[2]))))]


def _aligned(a: list, b: list):
    out: list = []
    if [x[0] for x in a] == [x[0] for x in b]:
        for x, y in zip(a, b):
            out.append((yield _align(x, y)))
        return out
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append((yield _align(a[i], b[j])))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], OPTIONAL[a[i][1]], a[i][2]])
            i += 1
        else:
            out.append([b[j][0], OPTIONAL[b[j][1]], b[j][2]])
            j += 1
    return out


def packed(wrapper: list) -> str:
    """The wrapper as a flat JSON list: signature, mark and number of children of each node, parents first."""
    out, stack = [], [wrapper]
    while stack:
        name, mark, children = stack.pop()
        out += [name, mark, len(children)]
        stack += reversed(children)
    return json.dumps(out, ensure_ascii=False)


def unpacked(stream: str) -> list:
    flat, top = json.loads(stream), []
    stack = [[top, 1]]
    for name, mark, n in zip(flat[::3], flat[1::3], flat[2::3]):
        while not stack[-1][1]:
            stack.pop()
        stack[-1][1] -= 1
        node = [name, mark, []]
        stack[-1][0].append(node)
        stack.append([node[2], n])
    return top[0]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tokens."""
    out, stack = [], [wrapper]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        mark = "" if node[1] == "1" else node[1]
        if node[0] == "#":
            out.append(f"#{mark}")
            continue
        out.append(f"(<{node[0]}>" if mark else f"<{node[0]}>")
        stack.append(f"</>){mark}" if mark else "</>")
        stack += reversed(node[2])
    return " ".join(out)


def slot_paths(wrapper: list) -> set[tuple[str, ...]]:
    out, stack = set(), [(wrapper, ())]
    while stack:
        node, path = stack.pop()
        for child in node[2]:
            if child[0] == "#":
                out.add(path)
            else:
                stack.append((child, path + (child[0],)))
    return out


def main_group(wrapper: list, varying: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    """Path of the group that holds the main text. varying: characters in slots whose text changes from page to page."""
    slots = slot_paths(wrapper)
    fit = [p for p in slots if not any(is_boilerplate(s, p[:k]) for k, s in enumerate(p))]
    heads = {p[:k + 1] for p in fit for k, s in enumerate(p) if is_main(s)}
    for kind in ("article", "main", ""):
        named = sorted((h for h in heads if h[-1].startswith(kind)), key=lambda h: (len(h), h))
        if named:
            return named[0]
    weights = {p: varying.get(p, 0) for p in fit}
    total, best = sum(weights.values()), ()
    while total:
        deeper: dict[tuple[str, ...], int] = {}
        for p, w in weights.items():
            if len(p) > len(best) and p[:len(best)] == best:
                deeper[p[:len(best) + 1]] = deeper.get(p[:len(best) + 1], 0) + w
        top = max(deeper, key=lambda p: (deeper[p], p), default=None)
        if top is None or deeper[top] < 0.6 * total or top[-1].split(" ")[0] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre"):
            break
        best = top
    return best


def page_text(blocks: list, main: tuple[str, ...] | None) -> str:
    """Blocks under the host's main group; under the page's own one, if it hasn't that."""
    open_blocks = [(p, t) for p, shut, t in blocks if not shut]
    own = [t for p, t in open_blocks if main and p[:len(main)] == main]
    if not own:
        for named in (lambda s: s.split(" ")[0] == "article", is_main):
            own = [t for p, t in open_blocks if any(map(named, p))]
            if own:
                break
    return "\n".join(own or [t for _, t in open_blocks])


# --- jobs ---------------------------------------------------------------------------------------------------------------

def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, its folded stream, and its slots with the hash and length of their text."""
    for batch in batches:
        hosts, streams, slots = batch.column("host").to_pylist(), [], []
        for html in batch.column("html"):
            tree, blocks = read(html.as_py() or "")
            streams.append(packed(wrapped(tree)))
            own: dict[tuple[str, ...], list[str]] = {}
            for path, shut, text in blocks:
                if not shut:
                    own.setdefault(path, []).append(text)
            slots.append([{"path": "\x1f".join(p), "text": "\n".join(t)} for p, t in own.items()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(streams, pa.string()),
             pa.array(slots, pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())])))], ["host", "stream", "slots"])


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for stream in sorted(group["stream"]):
        page = unpacked(stream)
        wrapper = page if wrapper is None else align(wrapper, page)
    out = group.iloc[:1].copy()
    out["stream"] = packed(wrapper)
    out["pages"] = int(group["pages"].sum())
    return out


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), expression, main (path of the main group, parts joined by 0x1f) and pages, one row per host."""
    host, _ = url_parts(F.col("url"))
    seen = pages.select(host.alias("host"), "html").mapInArrow(
        _streams, "host string, stream string, slots array<struct<path:string,text:string>>")
    seen = freeze(seen.select("host", "stream", F.transform("slots", lambda s: F.struct(
        s["path"].alias("path"), F.xxhash64(s["text"]).alias("text"), F.char_length(s["text"]).alias("chars"))).alias("slots")), "streams")
    streams = seen.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages")).withColumn(
        "piece", F.pmod(F.xxhash64("stream"), F.lit(PIECES)).cast("int"))
    kind = "host string, stream string, pages long, piece int"
    folded = streams.groupBy("host", "piece").applyInPandas(_fold, kind)
    folded = folded.groupBy("host").applyInPandas(_fold, kind)
    slots = seen.select("host", F.explode("slots").alias("s")).groupBy("host", "s.path").agg(
        F.min("s.text").alias("lo"), F.max("s.text").alias("hi"), F.sum("s.chars").alias("chars"))
    # The wrapper's slots only: as many as the wrapper has places, not as the host has pages.
    slots = slots.groupBy("host").agg(F.collect_list(F.struct(
        "path", (F.col("lo") != F.col("hi")).alias("varies"), "chars")).alias("slots"))
    return folded.join(slots, "host", "left").mapInPandas(
        _mains, "host string, wrapper string, expression string, main string, pages long")


def _mains(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for host, stream, pages, slots in zip(frame["host"], frame["stream"], frame["pages"], frame["slots"]):
            wrapper = unpacked(stream)
            known = list(slots) if slots is not None else []
            varies = pages > 1 and any(s["varies"] for s in known)
            chars = {tuple(s["path"].split("\x1f")) if s["path"] else (): s["chars"] for s in known if s["varies"] or not varies}
            rows.append((host, stream, expression(wrapper), "\x1f".join(main_group(wrapper, chars)), pages))
        yield pd.DataFrame(rows, columns=["host", "wrapper", "expression", "main", "pages"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, main in zip(batch.column("html"), batch.column("main").to_pylist()):
            _, blocks = read(html.as_py() or "")
            texts.append(page_text(blocks, tuple(main.split("\x1f")) if main else None))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    host, _ = url_parts(F.col("url"))
    mains = freeze(infer(pages).select("host", "main"), "wrappers")
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(mains, "host", "left").select("page_id", "url", "html", "main")
    kind = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"
    return rows.mapInArrow(_extract, kind).withColumn("n_chars", F.char_length("text").cast("long"))
