"""Porter's suffix stripping algorithm (1980), over the pattern of vowels (v) and consonants (c) of a word."""

from __future__ import annotations

import functools
import re

# The algorithm's suffixes, longest match first
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize"


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _swap(w: str, table: str, least: int) -> str:
    for suffix, new in sorted((x.split(":") for x in table.split()), key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            return root + new if _measure(root) >= least else w
    return w


@functools.lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3:
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: -len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            root = w[: -len(suffix)]
            if w.endswith(suffix):
                if "v" in _shape(root):
                    w = root
                    if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _cvc(w):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 1), STEP3, 1)
    for suffix in sorted(STEP4.split(), key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: -len(suffix)] + (suffix[0] if suffix in ("sion", "tion") else "")
            if _measure(root) > 1:
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
