"""Entities that are found by pattern in page text. Each builder takes a text column and gives an array of keys, in order, repeats included.

Most pages hold no entity of a kind. A cheap test that every page with one passes comes first, so that the pattern with its look-arounds is
only tried on the others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import EDGE, WS

#: Patterns of the entities (fixed values, but for the boundaries).
COMPANY = f"{EDGE}[0-9]{{9}}{EDGE}"
IBAN = f"{EDGE}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}{EDGE}"
EMAIL = f"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{EDGE}"
LINK = f"{EDGE}(?:https?://|mailto:|tel:)[^{WS}/$.?#][^\\n\\r\\u2028\\u2029][^{WS}]*{EDGE}"
GAP = f"[{WS}\\-.()]*"
PHONE = (
    f"(?:^|(?<=[\\n\\r\\u2028\\u2029])|[^0-9])\\(*(?:(?:\\+370|370|8|0){GAP})?"
    f"(?:6(?:{GAP}[0-9]){{7}}|[2-7](?:{GAP}[0-9]){{7}}|[2-7][0-9](?:{GAP}[0-9]){{6}})(?![0-9])"
)


def found(text: Column, pattern: str, may: Column) -> Column:
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def company_codes(text: Column) -> Column:
    return found(text, COMPANY, text.rlike("[0-9]{9}"))


def ibans(text: Column) -> Column:
    return found(text, IBAN, text.rlike("[0-9]{2}[A-Z0-9]{11}"))


def emails(text: Column) -> Column:
    return found(text, EMAIL, text.contains("@"))


def links(text: Column) -> Column:
    return found(text, LINK, text.contains("://") | text.contains("mailto:") | text.contains("tel:"))


def phone(raw: Column) -> Column:
    """A matched number in international form; null if it is not recognised or in a range that is not in use."""
    kept = F.regexp_replace(raw, f"[{WS}\\-.():]", "")
    whole = (
        F.when(kept.startswith("+370"), kept)
        .when(kept.startswith("370"), F.concat(F.lit("+"), kept))
        .when(kept.rlike("^[80]"), F.concat(F.lit("+370"), F.substring(kept, 2, 1 << 20)))
        .when(kept.rlike("^[2-7][0-9]{6,7}$"), F.concat(F.lit("+370"), kept))
    )
    return F.when(~whole.rlike("^\\+370[12]"), whole)


def phones(text: Column) -> Column:
    return F.filter(F.transform(found(text, PHONE, text.rlike(f"(?:[0-9]{GAP}){{8}}")), phone), lambda x: x.isNotNull())


#: Hosts in lower case to which no rule applies but those of ascii_host: no other script, no escapes, no Punycode, no number at the end.
PLAIN_HOST = "^(?!.*xn--)[a-z0-9._-]*[a-z_-][.]?$"

KINDS = {"company_code": company_codes, "iban": ibans, "phone": phones, "link": links, "email": emails}


def ascii_host(uri: Column) -> Column:
    """Host of an http(s) address: no user, port or leading www., lower-cased; null for others."""
    authority = F.regexp_extract(uri, "^https?:/*([^/?#\\\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    return F.nullif(F.regexp_replace(host, "^www\\.", ""), F.lit(""))
