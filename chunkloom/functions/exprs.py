"""Text functions as Column expressions: no Python in the plan.

Classes are written out (``[\\p{L}\\p{N}_]``), since \\w and \\s differ between engines. Null texts give null
unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WIDE = "[\\u3000-\\u9fff\\uac00-\\ud7af\\uf900-\\ufaff]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once: inside a lambda an expression is evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def subwords(n: Column) -> Column:
    return F.when(n <= 0, 0).when(n <= 6, 1).otherwise(1 + F.ceil((n - 6) / F.lit(4)).cast("int"))


def count_tokens(text: Column | str) -> Column:
    def of(token: Column) -> Column:
        wide = F.length(token) - F.length(F.regexp_replace(token, WIDE, ""))
        return F.when(F.length(token) <= 6, 1).otherwise(wide + subwords(F.length(token) - wide))

    return F.aggregate(F.regexp_extract_all(_c(text), F.lit(WORD), F.lit(0)), F.lit(0), lambda n, t: n + of(t))


def count_words(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_c(text), F.lit(r"\S+"), F.lit(0)))


def measure(text: Column | str, unit: str) -> Column:
    return F.length(_c(text)) if unit == "characters" else count_words(text) if unit == "words" else count_tokens(text)


def casefold(text: Column | str) -> Column:
    return F.replace(F.lower(_c(text)), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def content_hash(text: Column | str) -> Column:
    return F.sha2(casefold(squeeze(text)), 256)


def document_id(source: Column | str, title: Column | str, content: Column | str) -> Column:
    basis = F.coalesce(F.nullif(_c(source), F.lit("")), F.nullif(_c(title), F.lit("")), F.substring(_c(content), 1, 256), F.lit(""))
    return F.concat(F.lit("doc_"), F.substring(F.sha2(basis, 256), 1, 10))


def chunk_id(document: Column | str, index: Column | str) -> Column:
    return F.format_string("%s_chunk_%04d", _c(document), _c(index))


def section_id(document: Column | str, path: Column | str, index: Column) -> Column:
    name = F.coalesce(F.nullif(F.array_join(_c(path), "/"), F.lit("")), F.lit("root"))
    return F.concat(_c(document), F.lit("_section_"), F.substring(F.sha2(F.concat_ws("\u001f", name, index.cast("string")), 256), 1, 8))


def ends_sentence(text: Column | str) -> Column:
    t = F.rtrim(F.regexp_replace(_c(text), r"\s+$", ""))
    return (t == "") | t.rlike("[.!?:;。！？]$") | t.rlike("[.!?][)\\]}\"'`”’]$")


def starts_lower(text: Column | str) -> Column:
    return _c(text).rlike(r"^\s*\p{Ll}")


def truncate(text: Column | str, limit: int = 120) -> Column:
    one = squeeze(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 3)), F.lit("...")))


#: The words of shingles.
WORDS = r"[\p{L}\p{N}_]+"


def shingles(text: Column | str, size: int = 5) -> Column:
    """Distinct word n-grams; the whole of a shorter text. A text without words has none."""
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.when(F.size(words) >= size, F.array_distinct(many)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(casefold(text), F.lit(WORDS), F.lit(0)), of)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def balanced_fences(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"^\s*(```|~~~)"))) % 2 == 0


def broken_table(text: Column | str) -> Column:
    """Two rows or more, and none of the first two is a separator."""
    rows = F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$"))
    return (F.size(rows) >= 2) & ~F.exists(F.slice(rows, 1, 2), lambda x: x.rlike(r"^\s*\|?[\s:|-]+\|[\s:|-]*$"))


def broken_list(text: Column | str) -> Column:
    first = F.try_element_at(F.filter(F.split(_c(text), "\n"), lambda x: x.rlike(r"\S")), F.lit(1))
    number = F.regexp_extract(first, r"^\s*(\d+)[.)]\s", 1)
    return F.coalesce((number != "") & ~number.isin("0", "1"), F.lit(False))


def length_score(size: Column | str, least: int = 100, target: int = 500, most: int = 800) -> Column:
    s = _c(size)
    over = 0.6 - F.least((s - most) / F.lit(float(most)), F.lit(0.6))
    return F.when(s < least, s / F.lit(float(least)) * 0.6).when(s > most, over).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(s - target) / F.lit(float(target)) * 0.7))


def context_prefix(title: Column, path: Column, source: Column, separator: str = " > ") -> Column:
    line = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value))
    return F.concat_ws("\n", line("Document", title), line("Section", F.array_join(path, separator)), line("Source", source))
