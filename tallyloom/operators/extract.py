"""Deterministic extraction from HTML: links, contact links, JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_STRINGS = ArrayType(StringType())
FACTS = StructType([StructField(n, _STRINGS) for n in ("hrefs", "json_ld")])


@F.pandas_udf(FACTS)
def _facts(pages):
    import pandas as pd

    from tallyloom.functions.markup import attributes, tokens

    def one(html):
        hrefs, blocks, script = [], [], False
        for kind, value, written in tokens(html or ""):
            if kind == "text" and script:
                blocks.append(value)
            if kind == "open" and written:
                given = attributes(written)
                if "href" in given:
                    hrefs.append(given["href"])
                script = value == "script" and given.get("type", "").split(";")[0].strip().lower() == "application/ld+json"
            elif kind != "text":
                script = False
        return hrefs, blocks

    return pd.DataFrame([one(h) for h in pages], columns=["hrefs", "json_ld"])


def facts(html: Column) -> Column:
    """A struct of a page's hrefs and the texts of its JSON-LD blocks, in page order, from one pass over its tags.

    Comments, scripts and tags that the page's end cuts off have none; values may be quoted or not, references in them
    are decoded. A null page has none of either.
    """
    return _facts(html)


def hrefs(html: Column) -> Column:
    return facts(html)["hrefs"]


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$", "")


def _after(html: Column, scheme: str) -> Column:
    """What follows a scheme in the hrefs that start with it, up to a query, percent-decoded where that is possible."""
    rests = F.transform(F.filter(F.transform(hrefs(html), _trimmed), lambda h: h.rlike(f"(?i)^{scheme}:")), lambda h: F.regexp_replace(h, r"(?s)^[^:]*:|[?#].*$", ""))
    return F.transform(rests, lambda r: F.coalesce(F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r))


def emails(html: Column) -> Column:
    """Addresses of mailto: links; one link may name several."""
    each = F.flatten(F.transform(_after(html, "mailto"), lambda r: F.split(r, ",")))
    return F.filter(F.transform(each, F.trim), lambda a: a.rlike(r"^[^@\s]+@[^@\s]+$"))


def phones(html: Column) -> Column:
    """Numbers of tel: links, without parameters; they hold a digit and nothing but digits, + and what groups them."""
    numbers = F.transform(_after(html, "tel"), lambda r: F.trim(F.regexp_replace(r, "(?s);.*$", "")))
    return F.filter(numbers, lambda n: n.rlike(r"^\+?[0-9 ().*#/-]*[0-9][0-9 ().*#/-]*$"))


def whatsapp(html: Column) -> Column:
    """Numbers of wa.me, api.whatsapp.com/send and whatsapp://send links, digits only."""
    link = r"(?i)^(?:https?:)?//(?:www\.)?wa\.me/\+?([0-9]+)|^(?:(?:https?:)?//(?:api|web)\.whatsapp\.com/send/?|whatsapp:/+send/?)\?(?:[^#]*&)?phone=(?:%2B|\+)?([0-9]+)"
    numbers = F.transform(F.transform(hrefs(html), _trimmed), lambda h: F.concat(F.regexp_extract(h, link, 1), F.regexp_extract(h, link, 2)))
    return F.filter(numbers, lambda n: n != "")


def _graph(item: Column) -> Column:
    """An item and, if it has a @graph, that one's items."""
    return F.concat(F.array(item), F.coalesce(F.try_variant_get(item, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))


def json_ld_items(html: Column) -> Column:
    """The items of all JSON-LD blocks as variants, in page order: objects, those of lists, and those of @graph lists.

    A block that is no JSON has none.
    """
    parsed = F.filter(F.transform(facts(html)["json_ld"], F.try_parse_json), lambda v: v.isNotNull())
    items = F.flatten(F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return F.flatten(F.transform(items, _graph))


def json_ld_values(html: Column, path: str, kind: str | None = None) -> Column:
    """Texts and numbers at a path of each item that has one there; kind: of items with that @type only."""
    items = json_ld_items(html)
    if kind is not None:
        types = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
        items = F.filter(items, lambda v: F.coalesce(F.array_contains(types(v), kind), F.lit(False)))
    return F.filter(F.transform(items, lambda v: F.try_variant_get(v, path, "string")), lambda s: s.isNotNull())


def json_ld(html: Column, path: str) -> Column:
    """The first value at a path of any item; null where none has it."""
    return F.get(json_ld_values(html, path), F.lit(0))


def or_not_found(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("not_found"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
