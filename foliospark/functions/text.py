"""String functions with the semantics of ECMAScript text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 25 white-space characters of the Basic Multilingual Plane that ECMAScript's \s has, for use inside a class.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: One of them. The ranges around them rule most other characters out at once, where the class alone is gone through member by member.
SPACE = f"[\\x{{9}}-\\x{{20}}\\x{{A0}}-\\x{{FEFF}}&&[{WS}]]"
#: A word boundary between ASCII word characters and others; Java's \b knows other letters too.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the Basic Multilingual Plane."""
    return (F.length(c) + F.regexp_count(c, F.lit(ASTRAL))).cast("long")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def clean(c: Column) -> Column:
    """A metadata string without NUL characters, trimmed."""
    return trim(F.replace(c, F.lit("\x00"), F.lit("")))


def clean_json(c: Column) -> Column:
    """JSON in which every string value, at any depth, is clean; keys, numbers and the rest stay as they are.

    Escaped quotes and backslashes are set aside (for characters that JSON cannot hold unescaped), so that every second part between quotes is a string; one with a
    colon behind it is a key. Only strings with an escape, or with white space at an end, are looked into.
    """
    slash, quote = F.lit("\x01"), F.lit("\x02")
    parts = F.split(F.replace(F.replace(c, F.lit("\\\\"), slash), F.lit('\\"'), quote), '"')
    back = lambda t: F.replace(F.replace(t, quote, F.lit('\\"')), slash, F.lit("\\\\"))

    def cleaned(t: Column) -> Column:
        out = F.to_json(F.array(clean(F.get_json_object(F.concat(F.lit('["'), back(t), F.lit('"]')), "$[0]"))))
        return F.substr(out, F.lit(3), F.length(out) - 4)

    def part(all_: Column, t: Column, i: Column) -> Column:
        key = F.ltrim(F.coalesce(F.get(all_, i + 1), F.lit(""))).startswith(":")
        odd = t.rlike(f"^[{WS}]|[{WS}]$") | t.contains("\\") | t.contains("\x01") | t.contains("\x02")
        return F.when(i % 2 == 0, t).otherwise(F.concat(F.lit('"'), F.when(odd & ~key, cleaned(t)).otherwise(back(t)), F.lit('"')))

    return F.transform(F.array(parts), lambda all_: F.array_join(F.transform(all_, lambda t, i: part(all_, t, i)), ""))[0]


def clean_variant(c: Column) -> Column:
    """A VARIANT whose string values, at any depth, are clean."""
    return F.parse_json(clean_json(F.to_json(c)))


def word_count(c: Column) -> Column:
    """Runs of characters that are no white space, told by the white space in front of them."""
    return F.regexp_count(F.concat(F.lit(" "), c), F.lit(f"{SPACE}(?!{SPACE}|\\z)")).cast("long")


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def local_name(key: Column) -> Column:
    """What follows the last colon."""
    return F.element_at(F.split(key, ":"), -1)


def camel_case(c: Column) -> Column:
    """First word lower-cased, first letters of further words raised; characters that are no ASCII letter, digit or space go."""
    words = F.filter(F.split(F.regexp_replace(c, "[^a-zA-Z0-9 ]", ""), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))), "")


def right_wins(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key, the value of the second stands."""
    keys = F.map_keys(b)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(keys, k)), b)


def name_score(c: Column) -> Column:
    """How much a file name looks like Lithuanian or plain text: 3 for each Lithuanian letter, 1 for other word characters and ` .()-`,
    -5 for control and replacement characters, -1 for all else."""
    count = lambda p: F.regexp_count(c, F.lit(p))
    letters, plain, bad = count("[ąčęėįšųūžĄČĘĖĮŠŲŪŽ]"), count("[A-Za-z0-9_ .()-]"), count(r"[\x00-\x1F\x7F\uFFFD]")
    return 3 * letters + plain - 5 * bad - (F.length(c) - letters - plain - bad)
