"""Text functions as column expressions: identifiers, terms, token estimates, hashes, paths. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import vocab

IDENTIFIER = "[a-zA-Z][a-zA-Z0-9_]*[a-zA-Z0-9]"
NO_STRINGS = "array<string>"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast(NO_STRINGS)


def identifiers(text: Column) -> Column:
    """Runs that look like an identifier of two characters or more."""
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))


def word_parts(word: Column) -> Column:
    """The lower-case parts of a camelCase, ALLCaps or snake_case word; empty unless there are two of two bytes or more."""
    spaced = F.regexp_replace(F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.transform(F.filter(F.split(spaced, "[_ ]"), lambda p: F.octet_length(p) >= 2), F.lower)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast(NO_STRINGS))


def split_identifiers(text: Column) -> Column:
    """The text, followed by the parts of its identifiers, repetitions included and keywords left out."""
    stop = strings(vocab.KEYWORDS)
    long = F.filter(identifiers(text), lambda w: (F.octet_length(w) >= 4) & ~F.array_contains(stop, F.lower(w)))
    extra = F.filter(F.flatten(F.transform(long, word_parts)), lambda p: ~F.array_contains(stop, p))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", text, F.array_join(extra, " "))).otherwise(text)


def terms(text: Column) -> Column:
    """The distinct lower-case terms of a text in order: identifiers by parts, and short words."""
    found = F.flatten(F.transform(identifiers(text), lambda w: F.when(F.size(word_parts(w)) > 0, word_parts(w)).otherwise(F.array(F.lower(w)))))
    short = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.octet_length(w) < 3))
    return F.array_sort(F.array_distinct(F.concat(found, F.transform(short, F.lower))))


def query_terms(text: Column) -> Column:
    """Terms that count for ranking: of three bytes or more, or known short ones."""
    return F.filter(terms(text), lambda t: (F.octet_length(t) >= 3) | F.array_contains(strings(vocab.SHORT_TERMS), t))


def is_code_query(text: Column) -> Column:
    return text.rlike("_|[a-z][A-Z]")


def synonym_map(synonyms: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), strings(v))])


def expand_query(text: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The text, followed by the synonyms of its terms that it doesn't contain yet, in the order of the terms.

    ``synonyms`` is the driver's own list; for a table of synonyms see ``operators.lexical.expand_queries``.
    """
    table = synonym_map(vocab.SYNONYMS if synonyms is None else synonyms)
    lower = F.lower(text)
    more = F.flatten(F.transform(terms(text), lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast(NO_STRINGS))))
    more = F.array_distinct(F.filter(more, lambda s: ~F.contains(lower, s)))
    return F.when(F.size(more) > 0, F.concat_ws(" ", text, F.array_join(more, " "))).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case words for the lexical index."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("int")


def content_hash(text: Column) -> Column:
    """The first sixteen hex digits of the SHA-256 of the UTF-8 bytes."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def lines(text: Column, keep_returns: bool = False) -> Column:
    """The lines of a text; a line feed at the end doesn't begin another, and carriage returns before one are dropped."""
    text = text if keep_returns else F.regexp_replace(text, "\r\n", "\n")
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")  # not $, which also stands before a last line separator


def not_blank(line: Column) -> Column:
    """Whether anything but spaces, those of Unicode included, is in a line."""
    return line.rlike(r"[^\p{Zs}]")


def head(text: Column, n: int = vocab.HEAD_LINES) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def preview(text: Column, n: int = 5, keep_returns: bool = False) -> Column:
    """The first ``n`` lines that aren't blank."""
    return F.slice(F.filter(lines(text, keep_returns), not_blank), 1, n)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def absolute_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def block_id(file: Column, start_line: Column, name: Column) -> Column:
    return F.concat_ws(":", file, start_line.cast("string"), name)


def embedding_text(kind: Column, name: Column, content: Column) -> Column:
    """What the lexical index and the embedder read of a block."""
    return F.concat(kind, F.lit(" "), name, F.lit("\n"), content)
