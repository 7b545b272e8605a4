"""Main text of web pages by wrapper inference.

Pages become streams of tags and text slots. Tandem repeats in a page turn into repeated groups; then the streams of a
host are aligned, and where two differ the differing parts become optional or repeated groups. What results is a
union-free regular expression that all pages of the host match, the host's wrapper. Every page is matched against it, so
each of its texts fills one slot. A slot whose texts are on all pages that fill it, though these differ otherwise, is
template, but for headings of an article; the rest of a page's layout, inside its article or main element if it has one, is the main text.

Only different streams meet in alignment, in rounds of small merges, so a host with a large share of the pages is no
burden. Null html counts as empty and gives an empty text; a null url is a host of its own. Pages of any length and depth
are read whole; equal rows get equal texts. Extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

RAW = "script|style|iframe|textarea|title"
SKIPPED = frozenset("noscript template svg canvas object select button head".split())
IN_HEAD = frozenset("head html base link meta noscript script style template title".split())
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
SAME_NAME = {name: re.compile(rf"<(/?){name}\b", re.I) for name in SKIPPED}
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROOTS = frozenset(("article", "main"))
NOT_TEXT = frozenset("nav aside footer form menu dialog".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo banner cookie cookies consent gdpr notice alert nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget footer comment comments respond replies disqus related recommended share sharing social newsletter subscribe signup popup modal overlay pagination login".split()
)
SPACE = re.compile(r"\s+")
MAX_UNIT = 12
#: Labels of a path; elements deeper than that share the path of the last.
MAX_PATH = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Wrappers of more bytes in all aren't broadcast.
BROADCAST_BYTES = 64 << 20


def attributes(rest: str) -> tuple[str, bool]:
    """Label of class, id and role, and whether the element is no article text by them."""
    if not rest or "=" not in rest and "hidden" not in rest.lower():
        return "", False
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}
    words = [w for k in ("class", "id") for w in re.split(r"[^a-z0-9]+", got.get(k, "").lower()) if w]
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I)
    out = bool(hidden or NOT_TEXT_WORDS.intersection(words) or got.get("role", "").lower() in NOT_TEXT_ROLES or got.get("class", "").lower() in ("header", "site-header", "page-header"))
    label = "".join(f".{re.sub(r'[0-9]+', '0', w)}" for w in words[:3]) + (f"@{got['role'].lower()}" if "role" in got else "")
    return label, out


@dataclass(slots=True)
class Element:
    """An open element; out, root and skipped hold for all inside it. unclosed: it ends at the next block's tag."""

    name: str
    path: str
    out: bool = False
    root: bool = False
    skipped: bool = False
    unclosed: bool = False


def blocks(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(kind, tag or path, text, out, root) of a page in order: "tag" for a block's begin or end, "text" for a block's words.

    path: the labelled block elements around a text; out: some element around it is no article text; root: it is inside
    an article or main element.
    """
    stack = [Element("", "")]
    opened: Counter = Counter()
    parts: list[str] = []
    at = 0

    def flush() -> Iterator[tuple[str, str, str, bool, bool]]:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            yield "text", stack[-1].path, text, stack[-1].out, stack[-1].root

    def pop() -> Iterator[tuple[str, str, str, bool, bool]]:
        gone = stack.pop()
        opened[gone.name] -= 1
        if not gone.skipped:
            yield "tag", f"/{gone.name}", "", gone.out, gone.root

    def text(words: str) -> None:
        if stack[-1].name == "head" and not words.isspace():  # the end tag was left out
            opened["head"] -= 1
            stack.pop()
        if not stack[-1].skipped:
            parts.append(words)

    for m in MARKUP.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or name in INLINE and not (stack[-1].name == "head" and not m["end"]):
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            opened["head"] -= 1
            stack.pop()
        if name in INLINE:
            continue
        while stack[-1].unclosed:
            opened[stack.pop().name] -= 1
        if not stack[-1].skipped and name not in SKIPPED:
            yield from flush()
        if name in VOID or m["rest"].rstrip().endswith("/") and name not in CLOSES_P:
            continue
        if m["end"]:
            if opened[name] > 0:
                last = stack[-1]
                while last.name != name:
                    opened[stack.pop().name] -= 1
                    last = stack[-1]
                yield from pop()
            continue
        while stack[-1].name == "p" and name in CLOSES_P or stack[-1].name == name and name in ("p", "li", "tr", "td", "th", "dd", "dt", "option"):
            yield from pop()
        label, out = attributes(m["rest"])
        above = stack[-1]
        opened[name] += 1
        if name in SKIPPED or above.skipped:
            later = SAME_NAME[name].search(page, at) if name in SKIPPED and name != "head" and not above.skipped else None
            lone = name in SKIPPED and name != "head" and not above.skipped and (later is None or not later[1] and name in ("button", "select", "noscript"))
            stack.append(Element(name, above.path, True, above.root, True, lone))
            continue
        path = above.path if len(stack) > MAX_PATH else f"{above.path}/{name}{label}" if above.path else name + label
        out = above.out or out and name not in ROOTS or name in NOT_TEXT or name == "header" and not above.root
        stack.append(Element(name, path, out, above.root or name in ROOTS))
        yield "tag", name + label, "", out, stack[-1].root
    if at < len(page):
        text(page[at:])
    yield from flush()


def fold(nodes: list) -> list:
    """Tandem repeats of up to ``MAX_UNIT`` nodes as repeated groups ("+", nodes); the shortest units first."""
    for unit in range(1, MAX_UNIT + 1):
        out: list = []
        for node in nodes:
            out.append(node)
            while len(out) >= unit:
                last = out[-unit:]
                if len(out) > unit and out[-unit - 1] == ["+", last]:
                    del out[-unit:]
                elif len(out) >= 2 * unit and out[-2 * unit : -unit] == last and not (unit == 1 and last[0][0] in "+?"):
                    out[-2 * unit :] = [["+", last]]
                else:
                    break
        nodes = out
    return nodes


def nodes_of(found: list[tuple[str, str, str, bool, bool]]) -> tuple[list[tuple[str, str]], list[int]]:
    """The nodes of a page's blocks, and the node of each text; texts at one path without a tag between share a node.

    A slot's name has the path and whether its text is out, so a slot is wholly in or out.
    """
    nodes: list[tuple[str, str]] = []
    of: list[int] = []
    for kind, what, _, out, _ in found:
        node = ("<", what) if kind == "tag" else ("#", f"{what}!" if out else what)
        if kind == "tag" or not nodes or nodes[-1] != node:
            nodes.append(node)
        if kind == "text":
            of.append(len(nodes) - 1)
    return nodes, of


def stream(page: str) -> list:
    """A page's tags and text slots, with its own repeats folded."""
    return fold([list(n) for n in nodes_of(list(blocks(page)))[0]])


def bare(node: list) -> list:
    """The nodes that a node repeats or makes optional, or the node itself."""
    while node[0] in "+?":
        if len(node[1]) > 1:
            return node[1]
        node = node[1][0]
    return [node]


def align(a: list, b: list) -> list:
    """The wrapper of two streams or wrappers: what they share, and the rest as repeated or optional groups ("?", nodes).

    All that matches one of the two matches the wrapper.
    """
    x, y = ([json.dumps(n[1][0] if n[0] == "?" and len(n[1]) == 1 else n) for n in s] for s in (a, b))
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [p if p[0] == "?" else q for p, q in zip(a[i:j], b[k:m], strict=True)]
            continue
        for part in (a[i:j], b[k:m]):
            if not part:
                continue
            plain = bare(part[0]) if len(part) == 1 else part
            if out and bare(out[-1]) == plain:
                more = ["+", plain]
                out[-1] = ["?", [more]] if out[-1][0] == "?" else more
            else:
                out += part if all(p[0] == "?" for p in part) else [["?", part]]
    return fold(out)


class Matcher:
    """Matching against a wrapper. States are its leaves; each leaf with a text is a slot."""

    def __init__(self, wrapper: list):
        self.key: list = [None]  # of each state: its node, "split", or None for the end
        self.next: list[tuple[int, ...]] = [()]
        self.after: dict[int, dict] = {}
        self.start = self.build(wrapper, 0)

    def add(self, key, following: tuple[int, ...]) -> int:
        self.key.append(key)
        self.next.append(following)
        return len(self.key) - 1

    def build(self, nodes: list, to: int) -> int:
        for kind, what in reversed(nodes):
            if kind == "?":
                to = self.add("split", (self.build(what, to), to))
            elif kind == "+":
                again = self.add("split", ())
                first = self.build(what, again)
                self.next[again] = (first, to)
                to = first
            else:
                to = self.add((kind, what), (to,))
        return to

    def reach(self, state: int) -> dict:
        """Leaves that can come next, by node; before anything at state -1."""
        if state not in self.after:
            found: dict = {}
            seen: set[int] = set()
            todo = [self.start] if state < 0 else list(reversed(self.next[state]))
            while todo:
                s = todo.pop()
                if s in seen:
                    continue
                seen.add(s)
                if self.key[s] == "split":
                    todo += reversed(self.next[s])
                else:
                    found.setdefault(self.key[s], []).append(s)
            self.after[state] = found
        return self.after[state]

    def match(self, nodes: list[tuple[str, str]]) -> list[int] | None:
        """The leaf of each node, or None if the nodes don't match."""
        steps: list[dict[int, int]] = []
        now: dict[int, int] = {-1: -1}
        for node in nodes:
            new: dict[int, int] = {}
            for s in now:
                for t in self.reach(s).get(node, ()):
                    new.setdefault(t, s)
            if not new:
                return None
            steps.append(new)
            now = new
        at = next((s for s in now if None in self.reach(s)), None)
        if at is None:
            return None
        path = []
        for step in reversed(steps):
            path.append(at)
            at = step[at]
        return path[::-1]


def infer_wrappers(pages: DataFrame, most: int = 8) -> DataFrame:
    """host, wrapper (the expression as JSON). A merge takes about ``most`` streams, or wrappers of the round before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[tuple, str] = {}
        for batch in batches:
            found = []
            for page in batch.column(1):
                key = tuple(nodes_of(list(blocks(page.as_py())))[0])
                if key not in folded:
                    if len(folded) > 10_000:
                        folded.clear()
                    folded[key] = json.dumps(fold([list(n) for n in key]))
                found.append(folded[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "stream"])

    def aligned(group: pd.DataFrame) -> pd.DataFrame:
        wrapper: list | None = None
        for s in group.sort_values(["pages", "stream"], ascending=[False, True])["stream"]:
            now = json.loads(s)
            wrapper = now if wrapper is None else align(wrapper, now)
        return pd.DataFrame({"host": group["host"].iloc[:1], "salt": group["salt"].iloc[:1], "pages": [int(group["pages"].sum())], "stream": [json.dumps(wrapper)]})

    rows = pages.select(host_of().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    streams = shared_table(rows.mapInArrow(read, "host string, stream string").groupBy("host", "stream").agg(F.count("*").alias("pages")), "streams")
    groups = -(-(streams.groupBy("host").count().agg(F.max("count")).first()[0] or 1) // most)
    made = streams.withColumn("salt", F.pmod(F.xxhash64("stream"), F.lit(groups)))
    while True:
        made = made.groupBy("host", "salt").applyInPandas(lambda g: aligned(g), "host string, salt long, pages long, stream string")
        if groups == 1:
            return made.select("host", F.col("stream").alias("wrapper"))
        groups = -(-groups // most)
        made = shared_table(made, "merged").withColumn("salt", F.floor(F.col("salt") / most))


def host_of() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def fill_slots(pages: DataFrame, wrappers: DataFrame, broadcast_hosts: int, salts: int) -> DataFrame:
    """page_id, url, host, rooted (a usable article or main element is there), blocks (slot, or -1 for an article's heading, out, root, text) of every page."""
    known = shared_table(wrappers.select("host", "wrapper"), "wrappers")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0)).alias("size")).first()
    if size["n"] <= broadcast_hosts and size["size"] <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(known), "host", "left")
    else:
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        matched: dict[tuple, list[int] | None] = {}
        for batch in batches:
            rooted, filled = [], []
            for page, host, wrapper in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                found = list(blocks(page.as_py()))
                nodes, of = nodes_of(found)
                host = host.as_py()
                key = (host, *nodes)
                if key not in matched:
                    if len(matched) > 10_000 or len(matchers) > 500:
                        matched.clear()
                        matchers.clear()
                    if host not in matchers:
                        matchers[host] = Matcher(json.loads(wrapper.as_py() or "[]"))
                    matched[key] = matchers[host].match(nodes)
                leaves, own = matched[key], []
                for k, (_, path, text, out, root) in zip(of, (b for b in found if b[0] == "text"), strict=True):
                    heading = root and re.split(r"[.@]", path.rpartition("/")[2])[0] in HEADINGS
                    own.append({"slot": -1 if leaves is None or heading else leaves[k], "out": out, "root": root, "text": text})
                filled.append(own)
                rooted.append(any(root and not out for kind, _, _, out, root in found if kind == "tag"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(rooted, pa.bool_()), pa.array(filled, pa.list_(kind))], names)

    kind = pa.struct([("slot", pa.int32()), ("out", pa.bool_()), ("root", pa.bool_()), ("text", pa.string())])
    names = ["page_id", "url", "host", "rooted", "blocks"]
    schema = "page_id long, url string, host string, rooted boolean, blocks array<struct<slot: int, out: boolean, root: boolean, text: string>>"
    return rows.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, schema)


def extract_text(pages: DataFrame, wrappers: DataFrame, broadcast_hosts: int = 50_000, salts: int = 16) -> DataFrame:
    """page_id, url, text of every page: the texts of the slots it fills, block by block.

    What is out stays out. A page with an article or main element gives what is inside; template slots go, unless nothing
    else is left. Up to ``broadcast_hosts`` hosts the wrappers and template slots are broadcast; beyond, pages and
    wrappers meet by host and salt.
    """
    filled = shared_table(fill_slots(pages, wrappers, broadcast_hosts, salts), "filled")
    usable = F.filter("blocks", lambda b: ~b["out"] & (~F.col("rooted") | b["root"]))
    filled = filled.select("page_id", "url", "host", usable.alias("blocks"))
    page = F.xxhash64(F.transform("blocks", lambda b: b["text"]))
    texts = filled.select("host", page.alias("page"), F.explode("blocks").alias("b")).select("host", "page", "b.slot", F.xxhash64("b.text").alias("h"))
    # How many different pages each text of a slot is on, against the pages that fill the slot: all of them for a menu of
    # several entries as for a notice, few for some paragraph of a body, even if pages copy others from each other.
    held = texts.filter("slot >= 0").distinct()
    on = held.groupBy("host", "slot", "h").agg(F.count("*").alias("on")).groupBy("host", "slot").agg(F.min("on").alias("on"))
    filling = held.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("pages"))
    fixed = on.join(filling, ["host", "slot"]).filter((F.col("pages") >= 2) & (F.col("on") == F.col("pages"))).groupBy("host").agg(F.collect_set("slot").alias("fixed"))
    fixed = shared_table(fixed, "fixed")
    size = fixed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("fixed") * 4), F.lit(0)).alias("size")).first()
    if size["n"] <= broadcast_hosts and size["size"] <= BROADCAST_BYTES:
        rows = filled.join(F.broadcast(fixed), "host", "left")
    else:
        spread = fixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = filled.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    main = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("fixed", F.array().cast("array<int>")), b["slot"]))
    chosen = F.when(F.size(main) > 0, main).otherwise(F.col("blocks"))
    return rows.select("page_id", "url", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages, infer_wrappers(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
