"""HTML as tokens: text, opening and closing tags, attributes. A helper for functions that run inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Elements whose content is text up to their closing tag; in the second group references are decoded.
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
PLAIN = frozenset(("textarea", "title"))

_ATTRIBUTE = r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?)?"""
_MARK = re.compile(
    r"""<(?:!--(?P<comment>)|(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:"""
    + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE)
    + r""")*+[\s/=]*+)>|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>|(?P<other>[!?/]))"""
)
_COMMENT_END = re.compile(r"--!?>")
_EACH = re.compile(_ATTRIBUTE)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", decoded text, ""), ("open", name, attributes as written) and ("close", name, "") in page order.

    Comments, declarations and processing instructions are left out. Names are in lower case. The content of a script
    or style is one text, not decoded. A tag that the page's end cuts off is dropped, as browsers do.
    """
    at, n = 0, len(html)
    while at < n:
        mark = html.find("<", at)
        while mark >= 0 and mark + 1 < n and not (html[mark + 1].isascii() and (html[mark + 1].isalpha() or html[mark + 1] in "!?/")):
            mark = html.find("<", mark + 1)
        if mark < 0 or mark + 1 >= n:
            yield "text", unescape(html[at:]), ""
            return
        if mark > at:
            yield "text", unescape(html[at:mark]), ""
        found = _MARK.match(html, mark)
        if not found:  # a tag without an end
            return
        if found["comment"] is not None:
            if html.startswith((">", "->"), found.end()):
                at = html.index(">", found.end()) + 1
                continue
            end = _COMMENT_END.search(html, found.end())
            at = end.end() if end else n
        elif found["other"]:
            end = html.find(">", mark)
            at = end + 1 if end >= 0 else n
        elif found["end"]:
            yield "close", found["end"].lower(), ""
            at = found.end()
        else:
            name, at = found["name"].lower(), found.end()
            yield "open", name, found["attributes"]
            if name in RAW or name in PLAIN:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "text", html[at:stop] if name in RAW else unescape(html[at:stop]), ""
                at = stop


def attributes(written: str) -> dict[str, str]:
    """Attributes of a tag, names in lower case, values decoded; of one name the first counts, without a value it is ''."""
    out: dict[str, str] = {}
    for name, double, single, bare in _EACH.findall(written):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out
