"""Secret scans that link the parts of a credential: identifiers, secrets and endpoints.

Strong spans (assigned values, access keys, hexadecimal runs) are reported wherever they are. Weak candidates, such as
short passwords, user names, mixed tokens and addresses, are parts with an interval around them, and an interval join in
their scope reports only those that a complementary part meets. A scope is a stretch of text between blank lines.
The intervals of a role are in order, so a join is two searches a part; no pairs are made, however many parts a text has.

A null text counts as empty and has no spans. Repeated rows have the same spans each. Texts are scanned whole. Extra
columns are carried, without those named like the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, schema_of

# The strong kinds, in order.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
STRONG = ("assign", "access", "hex")
#: Kinds of the weak candidates, after the strong ones.
WEAK = ("identifier", "secret", "endpoint")
#: Code points around a part within which another part belongs to the same credential.
REACH = 200

#: Words before a value that make it a part, by role, and the least length of the value.
KEYED = {
    "identifier": re.compile(r"""(?ai)(?<![a-z])(?:access_?key_?id|client_?id|account_?id|tenant_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""),
    "secret": re.compile(r"""(?ai)(?:password|passwd|passphrase|secret|token|api_?key|private_?key|pwd)["']?\x20*[:=]\x20*["']?[^\s"',;]{6,}"""),
    "endpoint": re.compile(r"""(?ai)(?<![a-z])(?:endpoint|hostname|host|server|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9:/_.-]{3,}"""),
}
ADDRESS = re.compile(r"""(?ai)[a-z][a-z0-9+.-]*://[^\s"'<>]+""")
INSIDE = re.compile(r"""://([^\s/:@"'<>]+):([^\s/@"'<>]+)@""")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
BLANK = re.compile(r"\n[ \t\r]*\n")
#: Lower-case words of which a text must hold one to hold a keyed part.
HINTS = {
    "assign": [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"],
    "identifier": [b"id", b"user", b"login"],
    "secret": [b"pass", b"pwd", b"secret", b"token", b"key"],
    "endpoint": [b"endpoint", b"host", b"server", b"bucket"],
}
_HEX_MARKS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))

Span = tuple[str, int, int, int | None]


def strong_spans(raw: bytes, text: str | None = None) -> list[Span]:
    """Spans of the strong kinds, by start, then kind. Cheap searches of the bytes come first."""
    low = raw.lower()
    assigned = (b"=" in raw or b":" in raw) and any(h in low for h in HINTS["assign"])
    access, digits = b"AKIA" in raw, b"h" * 16 in raw.translate(_HEX_MARKS)
    if not (assigned or access or digits):
        return []
    text = raw.decode() if text is None else text
    found = []
    if assigned:
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if access:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    if digits:
        found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], STRONG.index(s[0])))


def mixed(token: str) -> bool:
    """A token of small and capital letters and two digits."""
    return any(map(str.islower, token)) and any(map(str.isupper, token)) and sum(map(str.isdigit, token)) >= 2


def joined(left: np.ndarray, right: np.ndarray, scopes: np.ndarray, reach: int) -> np.ndarray:
    """For each interval (start, end) of ``left`` the start of the first of ``right`` within reach in its scope, or -1.

    Intervals of ``right`` are ordered and don't overlap; ``scopes`` are the starts of scopes, the first 0.
    """
    if not len(left) or not len(right):
        return np.full(len(left), -1)
    bounds = np.append(scopes, np.iinfo(np.int64).max)
    nth = np.searchsorted(scopes, left[:, 0], "right")
    low = np.maximum(bounds[nth - 1], left[:, 0] - reach)
    high = np.minimum(bounds[nth] - 1, left[:, 1] + reach)
    first = np.searchsorted(right[:, 1], low, "right")  # ends after the lower bound
    ok = (first < len(right)) & (right[np.minimum(first, len(right) - 1), 0] <= high)
    return np.where(ok, right[np.minimum(first, len(right) - 1), 0], -1)


def weak_spans(text: str, raw: bytes, strong: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates that a complementary part meets: (kind, start, end, start of that part).

    An identifier or an endpoint needs a secret, a keyed secret an identifier or an endpoint, an unkeyed token an identifier.
    """
    low = raw.lower()
    taken = np.array([(s, e) for _, s, e, _ in strong], np.int64).reshape(-1, 2)
    keyed = b"=" in raw or b":" in raw
    parts: dict[str, set[tuple[int, int]]] = {}
    for role, pattern in KEYED.items():
        parts[role] = {m.span() for m in pattern.finditer(text)} if keyed and any(h in low for h in HINTS[role]) else set()
    if "://" in text:
        parts["endpoint"] |= {m.span() for m in ADDRESS.finditer(text)}
        for m in INSIDE.finditer(text):
            parts["identifier"].add(m.span(1))
            parts["secret"].add(m.span(2))
    base = {"identifier": [], "secret": []}
    for kind, start, end, _ in strong:
        base["identifier" if kind == "access" else "secret"].append((start, end))
    if not (base["secret"] or parts["secret"] or base["identifier"] or parts["identifier"]):
        return []

    def ordered(spans, apart_from: np.ndarray | None = None) -> np.ndarray:
        """By start, the longest of those that overlap, without those that overlap with what is taken."""
        out: list[tuple[int, int]] = []
        for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
            if not out or s >= out[-1][1]:
                out.append((s, e))
        spans = np.array(out, np.int64).reshape(-1, 2)
        if apart_from is not None and len(apart_from) and len(spans):
            by_end = np.maximum.accumulate(apart_from[:, 1])
            k = np.searchsorted(apart_from[:, 0], spans[:, 1], "left")
            spans = spans[(k == 0) | (by_end[np.maximum(k, 1) - 1] <= spans[:, 0])]
        return spans

    weak = {"identifier": ordered(parts["identifier"], taken), "secret": ordered(parts["secret"], taken), "endpoint": ordered(parts["endpoint"])}
    every = {role: ordered([*base.get(role, []), *map(tuple, weak[role])]) for role in WEAK}
    scopes = np.array([0, *(m.end() for m in BLANK.finditer(text))], np.int64)
    out: list[Span] = []

    def report(kind: str, spans: np.ndarray, *others: np.ndarray) -> np.ndarray:
        met = np.full(len(spans), -1)
        for other in others:
            met = np.where(met >= 0, met, joined(spans, other, scopes, reach))
        out.extend((kind, int(s), int(e), int(p)) for (s, e), p in zip(spans, met, strict=True) if p >= 0)
        return spans[met >= 0]

    sure = report("secret", weak["secret"], every["identifier"], every["endpoint"])
    bare = np.empty((0, 2), np.int64)
    if len(every["identifier"]):
        tokens = ordered({m.span() for m in TOKEN.finditer(text) if mixed(m.group())}, ordered([*map(tuple, taken), *map(tuple, every["secret"]), *map(tuple, every["identifier"]), *map(tuple, every["endpoint"])]))
        bare = report("secret", tokens, every["identifier"])
    secrets = ordered([*base["secret"], *map(tuple, sure), *map(tuple, bare)])
    report("identifier", weak["identifier"], secrets)
    report("endpoint", weak["endpoint"], secrets)
    return out


def spans_of(raw: bytes, reach: int = REACH) -> list[Span]:
    """All spans of a text, by start, then kind."""
    low = raw.lower()
    hinted = (b"=" in raw or b":" in raw) and any(h in low for h in HINTS["secret"] + HINTS["identifier"]) or (b"://" in raw and b"@" in raw)
    strong = strong_spans(raw)
    if not strong and not hinted:
        return []
    found = [*strong, *weak_spans(raw.decode(), raw, strong, reach)]
    kinds = (*STRONG, *WEAK)
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("partner", pa.int64())])


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """``keep`` (all columns) and ``spans``: array of kind, start, end (exclusive, code points), partner (null if strong)."""
    keep = kept_columns(docs, keep, ["spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = pa.array(([dict(zip(("kind", "start", "end", "partner"), s, strict=True)) for s in spans_of(t.as_py(), reach)] for t in texts), pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*keep, "spans"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text_bytes")
    made = "spans array<struct<kind:string,start:bigint,end:bigint,partner:bigint>>"
    return docs.select(*(F.col(f"`{c}`") for c in keep), text).mapInArrow(run, schema_of(docs, keep, made))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the secrets of every document, strong spans apart and with linked weak ones."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    strong = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return found.select("doc_id", *map(of, STRONG), F.sha2(joined_spans(strong).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
