"""Pre-token units of a byte-level tokenizer, and the tokenizer itself inside tasks.

A unit is a run of white space and the run of other characters behind it. No token of the
byte-level pattern begins before white space and ends behind it, and the pattern never looks back,
so the ids of a text are the ids of its units, one after the other. White space beyond ASCII could
stand before a unit's own white space; a text with such a pair is one unit as a whole.

Units are written as keys: a single leading blank is left out, and a unit without one, unless it
begins with a newline, carries a leading NUL.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: White space, controls and the first bytes of white space beyond ASCII.
_UNUSUAL = bytes([0, 9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3])
_WIDE_SPACE_PAIR = re.compile(
    rb"(?:[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80)[\t-\r ]"
)
_UNIT = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")


def unit_keys(text: bytes) -> list[bytes]:
    """The keys of a text's units, in order."""
    keys = text.replace(b"\n", b" \n").split(b" ")
    if len(text.translate(None, _UNUSUAL)) == len(text) and b"" not in keys and b"\n" not in keys:
        keys[0] = b"\0" + keys[0]
        return keys
    if not text:
        return []
    if _WIDE_SPACE_PAIR.search(text):
        return [b"\0" + text]
    return [b"\0" + unit for unit in _UNIT.findall(text)]


def unit_text(key: bytes) -> str:
    unit = key[1:] if key[:1] == b"\0" else key if key[:1] == b"\n" else b" " + key
    return unit.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker; without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def ids_of(path: str, key: bytes) -> list[int]:
    return tokenizer(path).encode(unit_text(key), add_special_tokens=False).ids
