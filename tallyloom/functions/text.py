"""Text as column expressions: trimming, names, initials, slugs, search, locale paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that an ECMAScript trim() removes.
JS_SPACE = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The default name, country and initials of a report.
DEFAULT_NAME, DEFAULT_INITIALS = "Company research", "CR"
LOCALES = ("vi", "en")


def _accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by Unicode decomposition."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in base if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_table()


def blank_to_null(value: Column) -> Column:
    """'' and null count as missing."""
    return F.nullif(value, F.lit(""))


def js_trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def as_text(value: Column, most: int) -> Column:
    """Trimmed, at most `most` characters; null is ''."""
    return F.coalesce(F.substring(js_trim(value), 1, most), F.lit(""))


def contains_ignoring_case(value: Column, query: str) -> Column:
    """Literal substring search: % and _ are ordinary, '' is in every text, null in none."""
    return F.coalesce(F.contains(F.lower(value), F.lower(F.lit(query))), F.lit(False))


def without_marks(value: Column) -> Column:
    """Accents removed: precomposed letters become their base, combining marks U+0300-036F go."""
    return F.regexp_replace(F.translate(value, ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")


def slug(value: Column) -> Column:
    plain = F.lower(F.translate(without_marks(value), "đĐ", "dD"))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")


def name_from_url(url: Column) -> Column:
    """The first host label of a URL, hyphens and underscores as spaces."""
    host = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.split_part(F.split_part(host, F.lit("/"), F.lit(1)), F.lit("."), F.lit(1)), "[-_]", " ")


def title_case(value: Column) -> Column:
    """Each space-separated word's first letter raised, the rest kept, empty words dropped."""
    words = F.filter(F.split(value, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def company_name(name: Column, url: Column) -> Column:
    given, from_url = blank_to_null(js_trim(name)), blank_to_null(name_from_url(url))
    return title_case(F.coalesce(given, from_url, F.lit(DEFAULT_NAME)))


def initials(name: Column) -> Column:
    firsts = F.transform(F.slice(F.split(name, " "), 1, 2), lambda w: F.substring(w, 1, 1))
    return F.coalesce(blank_to_null(F.upper(F.array_join(firsts, ""))), F.lit(DEFAULT_INITIALS))


def locale_or_default(value: Column) -> Column:
    return F.when(value == "en", "en").otherwise("vi")


def locale_path(path: Column, locale: str) -> Column:
    """The path with its locale prefix swapped; a missing path is the default locale's root."""
    given = F.coalesce(blank_to_null(path), F.lit("/vi"))
    return F.concat(F.lit(f"/{locale}"), F.regexp_replace(given, r"^/(vi|en)(?=/|$)", ""))


def is_locale(value: Column) -> Column:
    return F.coalesce(value.isin(*LOCALES), F.lit(False))


def encode_component(value: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
