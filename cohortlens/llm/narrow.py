"""A tokenizer's word pattern for the standard library's faster engine, on texts of the first Unicode blocks."""

from __future__ import annotations

import functools
import re
import unicodedata

#: Up to here the tokenizers and the regex libraries class all characters alike.
SAME_CLASSES = "ɏ"
#: A character beyond.
ODD = re.compile(f"[^\\x00-{SAME_CLASSES}]")


@functools.cache
def narrow(pattern: str) -> re.Pattern:
    """``pattern`` for the standard library, right for texts of ``SAME_CLASSES`` characters: its classes are spelled out."""
    chars = range(ord(SAME_CLASSES) + 1)
    spelled = {
        r"\p{L}": "".join(re.escape(chr(c)) for c in chars if unicodedata.category(chr(c))[0] == "L"),
        r"\p{N}": "".join(re.escape(chr(c)) for c in chars if unicodedata.category(chr(c))[0] == "N"),
        r"\s": r"\t\n\x0b\x0c\r \x85\xa0",
    }
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in (*spelled, r"\S") if pattern.startswith(n, at)), pattern[at])
        inside = (inside or name == "[") and name != "]"
        if name == r"\S":
            out.append(f"[^{spelled[r'\s']}]")
        else:
            out.append(name if name not in spelled else spelled[name] if inside else f"[{spelled[name]}]")
        at += len(name)
    return re.compile("".join(out))
