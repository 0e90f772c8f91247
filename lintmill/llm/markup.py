"""One walk over a page's markup, in time that grows with its length whatever stands in it.

Quotes delimit values after ``=`` alone, so a stray quote in a tag or in text swallows nothing. A quote that is never closed, and a tag that
never ends, are taken for what stands there up to the next ``>`` or as plain text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")


def walk(page: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """("text", text as written, {}, False), ("open", tag, attributes, closed by itself) and ("close", tag, {}, False) in page order.

    Comments, declarations and the content of ``RAW`` elements are left out; names are in lower case and the first of equal attributes holds.
    """
    n, at, start = len(page), 0, 0
    last = {c: page.rfind(c) for c in "<>\"'"}
    lower: str | None = None
    while True:
        lt = page.find("<", at) if at <= last["<"] else -1
        if lt < 0 or lt + 1 >= n:
            break
        closing = page[lt + 1] == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            if page[lt + 1] not in "!?/":
                at = lt + 1
                continue
            if page.startswith("!--", lt + 1):
                end = page.find("-->", lt + 2)
            elif page.startswith("![CDATA[", lt + 1):
                end = page.find("]]>", lt + 9)
            else:
                end = page.find(">", lt + 1)
                end = -1 if end < 0 else end - 2
            if lt > start:
                yield "text", page[start:lt], {}, False
            at = start = n if end < 0 else end + 3
            continue
        if last[">"] < lt:
            break
        tag, at, attributes = name.group().lower(), name.end(), {}
        while True:
            at = _GAP.match(page, at).end()
            if at >= n or page[at] == ">":
                break
            key = _ATTRIBUTE.match(page, at)
            at = key.end()
            value = ""
            if (equals := _EQUALS.match(page, at)) and equals.end() < n:
                at = equals.end()
                quote = page[at]
                if quote in "\"'" and last[quote] > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare.group(), bare.end()
            attributes.setdefault(key.group().lower(), html.unescape(value) if "&" in value else value)
        if lt > start:
            yield "text", page[start:lt], {}, False
        alone = page[at - 1] == "/"
        at = start = min(at + 1, n)
        if closing:
            yield "close", tag, {}, False
            continue
        yield "open", tag, attributes, alone
        if tag in RAW and not alone:
            if lower is None:
                lower = page.lower() if len(page.lower()) == n else page
            end = lower.find(f"</{tag}", at)
            if end < 0:
                at = start = n
            else:
                gt = page.find(">", end)
                at = start = n if gt < 0 else gt + 1
            yield "close", tag, {}, False
    if start < n:
        yield "text", page[start:], {}, False
