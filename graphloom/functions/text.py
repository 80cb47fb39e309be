"""Text cleaning as column expressions. Patterns are Java's; (?U) makes white space Unicode's, as in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip() sees it.
BLANK = r"(?U)[\s\x1c-\x1f]"
#: Its members, for what trims.
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANKS))


def strip_end(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U){BLANK[4:]}+\z", "")


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def unix_lines(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean_text(x: Column) -> Column:
    """Without hidden characters, with single blanks and at most one empty line in a row; empty becomes null."""
    x = unix_lines(F.regexp_replace(x, "[­​‌‍﻿]", ""))
    x = F.regexp_replace(x, "[ \t]+", " ")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return none_if_empty(strip(x))


def clean_list(values: Column) -> Column:
    """Cleaned members in order, each once; null and empty ones dropped."""
    kept = F.filter(F.transform(values, clean_text), lambda v: v.isNotNull())
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def extract_urls(x: Column) -> Column:
    """Web addresses in order, each once, without closing punctuation."""
    found = F.regexp_extract_all(x, F.lit(r'(https?://[^\s<>"]+)'), F.lit(1))
    trimmed = F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;:)\]}>"']+\z""", ""))
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda u: u != "")), F.array().cast("array<string>"))


def slugify(x: Column) -> Column:
    """Lower-case key fragment: runs of anything but a-z and 0-9 become one dash."""
    x = F.regexp_replace(F.lower(x), "https?://", "")  # blanks at the ends become dashes there
    x = F.btrim(F.regexp_replace(x, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.regexp_replace(x, r"\A\z", "unknown")  # names x once: what is named twice is computed twice


def short_hash(x: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(x, 256), 1, length)


def words(x: Column) -> Column:
    return F.filter(F.split(strip(x), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def limit_words(x: Column, most: int) -> Column:
    """At most so many words, joined by one blank; untouched but for its ends if there are no more."""
    x = F.coalesce(x, F.lit(""))
    return F.when(F.size(words(x)) <= most, strip(x)).otherwise(F.array_join(F.slice(words(x), 1, most), " "))


def compress_text(x: Column, head: int = 80_000, tail: int = 60_000) -> Column:
    """Beginning and end of a long text between markers. A tail of 0 keeps the whole text as the tail."""
    end = F.substring(x, -tail, tail) if tail else x
    parts = [F.lit("PAPER_CONTENT_HEAD_START\n"), F.left(x, F.lit(head)), F.lit("\nPAPER_CONTENT_HEAD_END\n\n...\n\nPAPER_CONTENT_TAIL_START\n"), end, F.lit("\nPAPER_CONTENT_TAIL_END\n")]
    return F.when(F.length(x) <= head + tail + 200, x).otherwise(F.concat(*parts))


def strip_code_fences(x: Column) -> Column:
    x = F.regexp_replace(strip(x), r"(?Ui)\A\s*```(?:json)?\s*", "")
    return strip(F.regexp_replace(x, r"(?U)\s*```\s*\z", ""))


def _value(x: Column) -> Column:
    """The JSON value of a whole text, else null. The parser stops after a first value; as a list's only member it cannot."""
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def _object(x: Column) -> Column:
    """The text itself if it is a JSON object, else null."""
    return F.when(F.startswith(F.schema_of_variant(_value(x)), F.lit("OBJECT")), x)


def json_object(x: Column) -> Column:
    """JSON text of an object: the text without fences, or what lies between its outer braces; null if neither parses.

    Text that parses as something else than an object is null and is not searched for braces.
    """
    bare = strip_code_fences(x)
    start = F.instr(bare, F.lit("{"))
    end = F.length(bare) - F.instr(F.reverse(bare), F.lit("}")) + 1
    inner = F.when((start > 0) & F.contains(bare, F.lit("}")) & (end > start), F.call_function("substring", bare, start, end - start + 1))
    return F.when(bare == "", F.lit(None).cast("string")).when(_value(bare).isNotNull(), _object(bare)).otherwise(_object(inner))


def data_url_summary(x: Column) -> Column:
    present = F.coalesce(x != "", F.lit(False))
    media = F.when(F.startswith(x, F.lit("data:")), F.regexp_extract(x, r"\Adata:([^;]*)", 1))
    return F.struct(
        present.alias("present"),
        F.when(present, media).alias("media_type"),
        F.when(present, F.length(x)).otherwise(F.lit(0)).alias("char_length"),
    )


def looks_like_url(x: Column) -> Column:
    return F.coalesce(F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://")), F.lit(False))


def without_line_feeds(template: Column) -> Column:
    """Address templates without encoded line feeds; empty becomes null."""
    return none_if_empty(strip(F.replace(template, F.lit("%0A"), F.lit(""))))


def readme_key(x: Column) -> Column:
    """Text under which two documents count as the same."""
    return strip(F.replace(unix_lines(x), F.lit("\u0000"), F.lit("")))


def section_body(lines: Column) -> Column:
    """Lines joined again, without horizontal rules."""
    kept = F.filter(lines, lambda s: ~s.rlike(r"\A\s*([-*_])\1{2,}\s*\z"))
    return strip(F.array_join(kept, "\n"))


def supporting_quotes(value: Column) -> Column:
    """Quotes of a JSON value given as text: a string, or the strings of a list; others give none."""
    parsed = F.try_parse_json(value)
    kind = F.schema_of_variant(parsed)
    one = F.array(F.try_variant_get(parsed, "$", "string"))
    many = F.transform(
        F.filter(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    found = F.when(kind == "STRING", one).when(F.startswith(kind, F.lit("ARRAY")), many).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.filter(F.transform(found, strip), lambda q: q != ""), F.array().cast("array<string>"))
