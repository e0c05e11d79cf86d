"""A1: which encoding a file is in, from its bytes alone.

1. A byte-order mark decides.
2. Zero bytes at every fourth place are UTF-32, and files with zero bytes whose
   bytes at every second place take hardly more than two values are UTF-16.
3. Bytes that are valid UTF-8 are UTF-8.
4. Otherwise each single-byte candidate decodes the file and is scored by how
   its characters beyond ASCII stand in the text: letters among letters of their
   case and script count for it, common ones more; capitals inside words, words
   of two scripts, signs and control characters against it.  The first candidate wins ties.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter

CANDIDATES = ("cp1252", "iso-8859-15", "cp1250", "mac_roman", "cp850", "cp1251", "koi8_r")
COMMON = frozenset("éèàâêîôûçëïùäöüßñóíáúãõåøæабвгдежзийклмнопрстуфхцчшщъыьэюя")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_HIGH = re.compile("[^\x00-\x7f]")


def _decodes(content: bytes, name: str) -> bool:
    try:
        content.decode(name)
        return True
    except (UnicodeDecodeError, LookupError):
        return False


def _wide(content: bytes) -> str | None:
    """UTF-16 or UTF-32 without a mark, by the places of the zero bytes."""
    n = len(content)
    if n >= 4 and n % 4 == 0:
        zero = [content[k::4].count(0) * 4 / n for k in range(4)]
        for name, high, low in (("utf-32-be", (0, 1), 3), ("utf-32-le", (3, 2), 0)):
            if zero[high[0]] > 0.99 and zero[high[1]] > 0.9 and zero[low] < 0.5 and _decodes(content, name):
                return name
    if n >= 2 and n % 2 == 0:
        few = [sum(c for _, c in Counter(content[k::2]).most_common(2)) * 2 / n for k in (0, 1)]  # a script has one or two high bytes
        for name, high, low in (("utf-16-be", few[0], few[1]), ("utf-16-le", few[1], few[0])):
            if high > 0.9 and low < 0.75 and _decodes(content, name):
                return name
    return None


def score(text: str) -> float:
    """How well the characters beyond ASCII fit the text around them."""
    total = 0.0
    for m in _HIGH.finditer(text):
        c, i = m.group(), m.start()
        before, after = text[i - 1:i], text[i + 1:i + 2]
        if c.isalpha():
            near = [x for x in (before, after) if x.isalpha()]
            mixed = [x for x in near if (ord(x) > 0x24F) != (ord(c) > 0x24F)]  # letters of two scripts in a word
            odd = c.isupper() and before.islower()
            row = ord(c) <= 0x24F and "\x7f" < after <= "\u024f" and after.isalpha()  # accents side by side
            total += -1.0 if odd or mixed else (0.1 if row else 1.0 if near else 0.2) + (0.5 if c.lower() in COMMON else 0.0)
        elif ord(c) < 0xA0:
            total -= 5.0
        elif c in "“”‘’„«»–—…€°§·¿¡´ª º":
            total += 0.2
        else:
            total -= 2.0
    return total


def detect(content: bytes, fallback: str = "iso-8859-1") -> str:
    """Name of the codec to decode ``content`` with; ``fallback`` where no candidate can."""
    for mark, name in MARKS:
        if content.startswith(mark) and _decodes(content, name):
            return name
    wide = _wide(content) if 0 in content else None
    if wide:
        return wide
    if _decodes(content, "utf-8"):
        return "utf-8"
    # single-byte files differ in their high bytes only: those, each with its neighbours, as often as they occur
    context = Counter(re.findall(rb"[\x00-\xff]?[\x80-\xff]+[\x00-\x7f]?", content))
    best, name = float("-inf"), fallback
    for candidate in CANDIDATES:
        try:
            s = sum(n * score(x.decode(candidate)) for x, n in context.items())
        except UnicodeDecodeError:
            continue
        if s > best:
            best, name = s, candidate
    return name


def decode(content: bytes, fallback: str = "iso-8859-1") -> tuple[str, str]:
    """(text, codec name)."""
    name = detect(content, fallback)
    return content.decode(name, "replace"), name
