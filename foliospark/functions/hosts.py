"""Host names of links beyond plain ASCII: the mapping of UTS 46 in its non-transitional form, its checks, and Punycode.

The mapping is a table by character, filled as characters are met, from the rules that the standard's table follows: compatibility forms, case folding, characters
that are ignored, and four that are kept though case folding or older rules would change them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Kept as they are (fixed values): sharp s, final sigma, the two joiners.
KEPT = "ßς‌‍"
#: Capital sharp s becomes the small one; the ideographic full stop parts labels (fixed values).
SPECIAL = {"ẞ": "ß", "。": ".", "｡": "."}
#: Characters that vanish (fixed values): soft hyphen, grapheme joiner, Mongolian and other variation selectors, zero-width space, word joiner, byte-order mark.
IGNORED = {0xAD, 0x34F, 0x180B, 0x180C, 0x180D, 0x180F, 0x200B, 0x2060, 0x2064, 0xFEFF, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Arabic letters that join to the right only, as ranges (fixed values).
RIGHT_JOINING = [(0x622, 0x625), (0x627, 0x627), (0x629, 0x629), (0x62F, 0x632), (0x648, 0x648), (0x671, 0x673), (0x675, 0x677), (0x688, 0x699), (0x6C0, 0x6C0), (0x6C3, 0x6CB), (0x6CD, 0x6CD), (0x6CF, 0x6CF), (0x6D2, 0x6D3), (0x6D5, 0x6D5), (0x6EE, 0x6EF)]
FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


@lru_cache(maxsize=1 << 16)
def mapped(c: str) -> str | None:
    """What a character becomes; None if it may not stand in a host."""
    if c in KEPT:
        return c
    if c in SPECIAL:
        return SPECIAL[c]
    if ord(c) in IGNORED:
        return ""
    if unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn", "Zl", "Zp") and not c.isascii():
        return None
    whole = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())
    return "".join(SPECIAL.get(x, x) for x in whole if ord(x) not in IGNORED)


def joins(c: str) -> bool:
    return unicodedata.bidirectional(c) == "AL" and unicodedata.category(c) == "Lo"


def joiners_fit(label: str) -> bool:
    """A joiner stands behind a virama; the non-joiner also between Arabic letters that would else be joined."""
    for i, c in enumerate(label):
        if c in "‌‍" and not (i and unicodedata.combining(label[i - 1]) == 9):
            plain = [[x for x in part if unicodedata.category(x) != "Mn"] for part in (label[:i], label[i + 1 :])]
            if c == "‍" or not all(plain):
                return False
            left, right = plain[0][-1], plain[1][0]
            if not (joins(left) and joins(right)) or any(a <= ord(left) <= b for a, b in RIGHT_JOINING):
                return False
    return True


def direction_fits(label: str) -> bool:
    """The rule for labels of domains in which anything is written from right to left."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    tail = [k for k in kinds if k != "NSM"]
    if kinds[0] in ("R", "AL"):
        return set(kinds) <= {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and tail[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    return kinds[0] == "L" and set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and tail[-1] in ("L", "EN")


def label_fits(label: str) -> bool:
    return unicodedata.normalize("NFC", label) == label and unicodedata.category(label[0])[0] != "M" and "." not in label and all(mapped(c) == c for c in label) and joiners_fit(label)


def ascii_domain(host: str) -> str | None:
    """The ASCII form of a domain, in lower case; None if it breaks a rule."""
    parts = [mapped(c) for c in host]
    if None in parts:
        return None
    labels = unicodedata.normalize("NFC", "".join(parts)).split(".")
    shown = []
    for x in labels:
        if x.startswith("xn--"):
            try:
                own = x[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                return None
            if not own or own.isascii() or own.encode("punycode").decode() != x[4:]:
                return None
            x = own
        if x and not x.isascii() and not label_fits(x):
            return None
        shown.append(x)
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for x in shown for c in x) and not all(direction_fits(x) for x in shown if x):
        return None
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in shown)


def host_by_rules(host: str | None) -> str | None:
    """A host name as a browser's address parser gives it: percent escapes, other scripts, no forbidden characters, numbers in the forms of IPv4. None if it is none."""
    from urllib.parse import unquote

    if not host:
        return None
    host = unquote(host)
    if not host.isascii() or "xn--" in host.lower():
        host = ascii_domain(host)
    host = host and host.lower()
    if not host or FORBIDDEN.search(host):
        return None
    parts = host.rstrip(".").split(".")
    if not re.fullmatch(r"[0-9]+|0x[0-9a-f]*", parts[-1]):
        return host
    try:
        numbers = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8 if p[0] == "0" and len(p) > 1 else 10) for p in parts]
    except (ValueError, IndexError):
        return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    whole = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))
