"""Repair of texts whose UTF-8 was read by the rules of another code page, once or several times over.

A step reads stretches of a text back: characters that a code page has for bytes which make up well-formed UTF-8 become what
that UTF-8 says. Only stretches count that sound text hardly holds, so é before a quotation mark or a dash stays as it is. The
badness of a text is how many of its characters are in such stretches; the repair is a breadth-first search over steps of all
code pages for the least badness, by the shortest chain that reaches it. Stretches are read back one by one, so a text may mix
sound and damaged parts, and what no page explains stays."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql.types import StringType

#: Steps of a chain at most, and texts that a search looks at.
DEPTH, LOOKED_AT = 5, 40
TWO, THREE, FOUR = "[\xc2-\xdf][\x80-\xbf]", "[\xe0-\xef][\x80-\xbf]{2}", "[\xf0-\xf4][\x80-\xbf]{3}"
ANY = f"(?:{TWO}|{THREE}|{FOUR})"


@dataclass(frozen=True)
class Page:
    """byte: the byte of each character beyond ASCII, as a character; damaged: what is read back, over bytes."""

    name: str
    byte: dict[int, int]
    damaged: re.Pattern

    def as_bytes(self, text: str) -> str:
        return "".join(c if c < "\x80" else chr(self.byte.get(ord(c), 0xFFFF)) for c in text)

    def stretches(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in self.damaged.finditer(self.as_bytes(text)):
            try:
                found.append((m.start(), m.end(), m[0].encode("latin-1").decode("utf-8")))
            except UnicodeDecodeError:  # an overlong form or a surrogate
                continue
        return found


def _page(name: str, *singles: str) -> Page:
    """singles: sequences that are damage when they stand alone; two in a row always are."""
    byte = {ord(bytes([b]).decode(name, "ignore") or chr(b)): b for b in range(0x80, 0x100)}
    if name == "cp1252":
        byte |= {b: b for b in range(0x80, 0x100)}  # Latin-1 differs in control characters only
    return Page(name, byte, re.compile("|".join([f"{ANY}{{2,}}", *singles])))


#: In Western pages accented letters are common before signs, so single ones count only behind the leads of Latin letters, signs
#: and pictures. Of the old Macintosh page, in which accented letters themselves continue a sequence, only what begins so counts.
PAGES = (
    _page("cp1252", "[\xc2\xc3][\x80-\xbf]", "[\xe2\xef][\x80-\xbf]{2}", FOUR),
    _page("cp1251", "\xe2\x80[\x80-\xbf]"),
    Page("mac_roman", _page("mac_roman").byte, re.compile(f"(?:[\xc2\xc3][\x80-\xbf]|\xe2\x80[\x80-\xbf])(?:{ANY})*")),
)
_SUSPECT = re.compile("[" + "".join(re.escape(c) for c in sorted({chr(c) for p in PAGES for c, b in p.byte.items() if 0xC2 <= b <= 0xF4})) + "][^\x00-\x7f]")


def badness(text: str) -> int:
    return max(sum(b - a for a, b, _ in page.stretches(text)) for page in PAGES)


def read_back(text: str, page: Page) -> str:
    out, at = [], 0
    for a, b, sound in page.stretches(text):
        out += [text[at:a], sound]
        at = b
    return "".join([*out, text[at:]])


def repaired(text: str | None) -> str | None:
    """The text after the shortest chain of steps to the least badness; sound text, null and empty come back as they are."""
    if not text or text.isascii() or not _SUSPECT.search(text):
        return text
    best, least = text, badness(text)
    level, seen = [text], {text}
    for _ in range(DEPTH):
        if not least:
            break
        following = []
        for own in level:
            for page in PAGES:
                new = read_back(own, page)
                if new not in seen and len(seen) < LOOKED_AT:
                    seen.add(new)
                    following.append(new)
        for new in following:
            if (bad := badness(new)) < least:
                best, least = new, bad
        level = following
        if not level:
            break
    return best


@F.pandas_udf(StringType())
def repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")
