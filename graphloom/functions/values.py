"""JSON values as text: attributes of graph nodes are maps from names to canonical JSON (sorted keys, no blanks).

Text groups, hashes and prunes in Parquet like any string, which variants do not; variants are one try_parse_json away.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOTHING = ("null", '""', "[]", "{}")
_BLANK = r"""(?U)\A"(?:\s|\\[nrtf]|\\u00(?:0[9a-dA-D]|1[c-fC-F]|20|85|[aA]0))*"\z"""


def json_text(x: Column) -> Column:
    """A string as JSON text; null stays null."""
    return F.when(x.isNotNull(), F.regexp_replace(F.to_json(F.array(x)), r"\A\[|\]\z", ""))


def json_number(x: Column) -> Column:
    return x.cast("string")


def clean_attributes(attributes: Column) -> Column:
    """Without null, empty strings, lists and objects; blanks, 0 and false stay."""
    return F.map_filter(attributes, lambda _, v: v.isNotNull() & ~v.isin(*_NOTHING))


def is_informative(value: Column) -> Column:
    """Not null, blank or empty; numbers and booleans always are."""
    return F.coalesce(~value.isin(*_NOTHING) & ~value.rlike(_BLANK), F.lit(False))


def informative_count(attributes: Column, excluded: tuple[str, ...]) -> Column:
    return F.size(F.map_filter(attributes, lambda k, v: ~k.isin(*excluded) & is_informative(v))).cast("bigint")


def falsy_coalesce(*columns: Column) -> Column:
    """The first that is neither null, 0, false nor empty, else the last (as it is)."""
    out = columns[-1]
    for c in reversed(columns[:-1]):
        text = c.cast("string")
        truthy = c.isNotNull() & ~text.isin("", "0", "0.0", "-0.0", "false")
        out = F.when(truthy, c).otherwise(out)
    return out


def canonical_json(**fields: Column) -> Column:
    """Object with sorted keys and without blanks; null fields are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
