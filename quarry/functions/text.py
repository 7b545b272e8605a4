"""Column functions on text: names, lines, terms, tokens, splitting at a fixed width."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a retrieval query ignores.
QUERY_STOP_WORDS = (
    "the a an this that these those i you he she we they it its my your his her our their "
    "is are was were be been being have has had do does did will would shall should may might must can could "
    "in on at to for of with by from and but or nor if so as than "
    "about tell what who which where when why how all each every both few more most some such no not only"
).split()
# Words that chunk tokens leave out.
TOKEN_STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being has have had do does did will would "
    "shall should may might can could it its this that these those i you he she we they what which who whom where when how if not"
).split()
# The kept extension of a file name's suffix; other suffixes stay as they are.
EXTENSIONS = {
    ".txt": ".txt", ".bat": ".txt", ".c": ".txt", ".h": ".txt", ".ksh": ".txt", ".pl": ".txt", ".srt": ".txt",
    ".md": ".md", ".markdown": ".md", ".csv": ".csv", ".htm": ".html", ".html": ".html", ".xml": ".xml", ".rtf": ".rtf",
}
# Seconds of a reminder's units.
UNIT_SECONDS = {
    "second": 1, "seconds": 1, "s": 1, "minute": 60, "minutes": 60, "min": 60, "m": 60, "hour": 3600, "hours": 3600, "hr": 3600, "h": 3600,
}
# Media types of image suffixes; others count as PNG.
IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}
ROLE_LABELS = {"user": "User", "assistant": "AI"}
TRUNCATED = "... [truncated]"
OTHER_BREAK = "[\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BREAK = "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def mapping(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def strip(c: Column) -> Column:
    """Without white space at both ends, all kinds of it."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s]")


def lines(c: Column) -> Column:
    """Lines of a text by every kind of line break; an empty text has none."""
    whole = F.regexp_replace(c, f"(?:{BREAK})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(whole, BREAK))


def truncate_lines(c: Column, most: int = 50) -> Column:
    """The first lines, with a marker if there are more."""
    cut = lambda x: F.when(F.size(x) > most, F.concat(F.array_join(F.slice(x, 1, most), "\n"), F.lit("\n" + TRUNCATED))).otherwise(F.array_join(x, "\n"))
    by_all = F.transform(F.array(lines(c)), cut)[0]  # the lines are found once
    whole = F.when(F.endswith(c, F.lit("\n")), F.left(c, F.length(c) - 1)).otherwise(c)
    more = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) >= most
    by_newline = F.when(more & (c != ""), F.concat(F.substring_index(whole, "\n", most), F.lit("\n" + TRUNCATED))).otherwise(whole)
    return F.when(c.rlike(OTHER_BREAK), by_all).otherwise(by_newline)  # most texts need no list of lines


def extension(name: Column) -> Column:
    """Lower-case suffix of a name without its query part, or empty."""
    return F.lower(F.regexp_extract(F.split_part(name, F.lit("?"), F.lit(1)), r"(?s)^.+(\.[^.]*)$", 1))


def display_name(name: Column) -> Column:
    """A base name without leading digits of its stem; the name itself if nothing of the stem is left."""
    base = F.split_part(name, F.lit("?"), F.lit(1))
    suffix = F.regexp_extract(base, r"(?s)^.+(\.[^.]*)$", 1)
    stem = F.left(base, F.length(base) - F.length(suffix))
    rest = F.regexp_replace(stem, r"^\d+", "")
    return F.when(rest == "", base).otherwise(F.concat(rest, suffix))


def inferred_extension(name: Column) -> Column:
    suffix = extension(name)
    known = F.try_element_at(mapping(EXTENSIONS), suffix)
    return F.when(F.coalesce(name, F.lit("")) == "", ".txt").otherwise(F.coalesce(known, F.nullif(suffix, F.lit("")), F.lit(".txt")))


def sanitized_name(name: Column) -> Column:
    """A safe file name: no hexadecimal lead, letters, digits and ._- only, at most 60 characters."""
    bare = F.regexp_replace(name, "^[0-9a-f]*_", "")
    kept = strip(F.regexp_replace(bare, r"[^\p{L}\p{N}._\- ]", ""))
    return F.coalesce(F.nullif(F.substring(kept, 1, 60), F.lit("")), F.lit("uploaded_doc"))


def url_file_name(url: Column) -> Column:
    last = F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)
    return F.coalesce(F.nullif(last, F.lit("")), F.lit("remote_file"))


def query_terms(c: Column) -> Column:
    """Different words of three or more letters or underscores, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z_]{3,})"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, QUERY_STOP_WORDS)))


def terms_of(query: str) -> list[str]:
    """``query_terms`` of a query that the caller holds."""
    found = re.findall(r"[a-z_]{3,}", query.lower())
    return [w for w in dict.fromkeys(found) if w not in QUERY_STOP_WORDS]


def tokens(c: Column) -> Column:
    """Words and hyphenated words in order, without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([a-z0-9]+(?:-\w+)*)"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(TOKEN_STOP_WORDS))


def is_header(line: Column) -> Column:
    """A short line without spaces that starts with a capital; ``line`` is stripped."""
    return (F.length(line) <= 40) & line.rlike(r"^\p{IsUppercase}") & ~F.contains(line, F.lit(" "))


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term)))


def fixed_parts(c: Column, width: int = 1900) -> Column:
    """Slices of a fixed width; an empty text has none."""
    n = F.length(c)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / width))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(c, i * width + 1, F.lit(width))))


def approx_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), F.lit(1))).cast("long")


def role_label(role: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping(ROLE_LABELS), role), role)


def author_prefixed(name: Column, message: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("**"), name, F.lit(":** "), message)).otherwise(message)


def prompt_of(message: Column, prefix: str) -> Column:
    """What follows the prefix of a trimmed message; null without the prefix, empty with nothing behind it."""
    bare = strip(message)
    return F.when(F.startswith(bare, F.lit(prefix)), strip(F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))))


def target_and_text(c: Column) -> tuple[Column, Column]:
    """Language and text of ``language: text``; the text is null without a colon."""
    parts = F.split(c, ":", 2)
    return strip(parts[0]), strip(F.try_element_at(parts, F.lit(2)))


def data_uri(name: Column, content: Column) -> Column:
    kind = F.coalesce(F.try_element_at(mapping(IMAGE_TYPES), extension(name)), F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\\s", ""))


def safe_int(c: Column, default: int) -> Column:
    """The whole number that a text holds, single underscores between digits allowed; else the default."""
    bare = strip(c)
    return F.coalesce(F.when(bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("int")), F.lit(default))


def or_clear(c: Column) -> Column:
    """The word ``clear`` if a text is just that, whatever its case; else null."""
    return F.when(F.lower(strip(c)) == "clear", "clear")


def listing_line(name: Column, size: Column, modified: Column, sha: Column) -> Column:
    """A catalogue line: name, KB with one decimal, date, eight digits of the digest."""
    return F.format_string("%s (%.1f KB, %s, %s)", name, F.bround(size / 1024, 1), F.substring(modified, 1, 10), F.substring(sha, 1, 8))
