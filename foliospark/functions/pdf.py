"""Values of PDF files: dates, flags, colours, styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import clean_json

#: The date pattern of the PDF format (fixed value).
DATE = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Z+-])?(\d{2})?'?(\d{2})?'?"
#: Names of the annotation flags, lowest bit first (fixed values).
FLAGS = ["Invisible", "Hidden", "Print", "NoZoom", "NoRotate", "NoView", "ReadOnly", "Locked", "ToggleNoView", "LockedContents"]
#: Annotation types by number, from 1 (fixed values).
TYPES = ["TEXT", "LINK", "FREETEXT", "LINE", "SQUARE", "CIRCLE", "POLYGON", "POLYLINE", "HIGHLIGHT", "UNDERLINE", "SQUIGGLY", "STRIKEOUT", "STAMP", "CARET", "INK", "POPUP", "FILEATTACHMENT", "SOUND", "MOVIE", "WIDGET", "SCREEN", "PRINTERMARK", "TRAPNET", "WATERMARK", "THREED", "REDACT"]
#: Border styles by number, from 0 (fixed values).
STYLES = ["solid", "dashed", "solid", "inset", "none"]


def iso_date(raw: Column) -> Column:
    """D:YYYYMMDDHHmmSS with zone as ISO 8601: missing parts take their least value, a missing zone is Z; null if it is no such date."""
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(raw, DATE, k), F.lit("")), F.lit(default))
    zone = F.regexp_extract(raw, DATE, 7)
    tail = F.when(zone.isin("+", "-"), F.concat(zone, part(8, "00"), F.lit(":"), part(9, "00"))).otherwise(F.lit("Z"))
    whole = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), tail)
    return F.when(raw.rlike(DATE), whole)


def dated(info: Column) -> Column:
    """An info dictionary (map of strings) with the dates among its values in ISO form."""
    return F.transform_values(info, lambda k, v: F.when(k.rlike("(?i)date"), F.coalesce(iso_date(v), v)).otherwise(v))


def metadata(json: Column) -> Column:
    """Metadata JSON as VARIANT, its strings clean at any depth. Where there is an info dictionary it stands for the whole, with its dates in ISO form.
    Null for what is no JSON, or larger than a VARIANT can be."""
    whole = F.try_parse_json(clean_json(json))
    is_date = lambda k, v: k.rlike("(?i)date") & (F.schema_of_variant(v) == "STRING")
    iso = lambda k, v: F.when(is_date(k, v), F.coalesce(iso_date(v.cast("string")).cast("variant"), v)).otherwise(v)
    return F.coalesce(F.to_variant_object(F.transform_values(F.try_variant_get(whole, "$.info", "map<string,variant>"), iso)), whole)


def flags(value: Column) -> Column:
    """A struct of ten booleans; null and zero have none."""
    bits = F.struct(*[(value.cast("long").bitwiseAND(F.lit(1 << k)) != 0).alias(name) for k, name in enumerate(FLAGS)])
    return F.when(value.isNotNull() & (value != 0), bits)


def hex_color(parts: Column, most: float = 1.0) -> Column:
    """#rrggbb of a gray, RGB or CMYK array with components from 0 to `most`; null for other sizes."""
    unit = F.transform(parts, lambda v: v / most)
    at = lambda k: F.get(unit, F.lit(k))
    byte = lambda v: F.format_string("%02x", F.floor(v * 255 + 0.5).cast("int"))
    cmyk = lambda k: (1 - at(k)) * (1 - at(3))
    return (
        F.when(F.size(parts) == 1, F.concat(F.lit("#"), byte(at(0)), byte(at(0)), byte(at(0))))
        .when(F.size(parts) == 3, F.concat(F.lit("#"), byte(at(0)), byte(at(1)), byte(at(2))))
        .when(F.size(parts) == 4, F.concat(F.lit("#"), byte(cmyk(0)), byte(cmyk(1)), byte(cmyk(2))))
    )


def type_name(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in TYPES]), (number - 1).cast("int")), F.lit("Unknown"))


def border(width: Column, style: Column) -> Column:
    """Struct (borderWidth, borderStyle) in the words of style sheets."""
    name = F.coalesce(F.get(F.array(*[F.lit(x) for x in STYLES]), style.cast("int")), F.lit("solid"))
    return F.struct(F.concat(F.coalesce(width, F.lit(1)).cast("string"), F.lit("px")).alias("borderWidth"), name.alias("borderStyle"))


def annotation(raw: dict[str, Column]) -> dict[str, Column]:
    """Normalised fields of an annotation from its raw ones (those that are lacking may be left out)."""
    get = lambda k, kind="string": raw.get(k, F.lit(None).cast(kind))
    return {
        "typeName": get("subtype"),
        "rect": get("rect", "array<double>"),
        "rotation": F.coalesce(get("rotation", "int"), F.lit(0)),
        "color": hex_color(get("color", "array<double>")),
        "opacity": get("opacity", "double"),
        "contents": F.coalesce(get("contentsText"), F.lit("")),
        "author": get("title"),
        "created": iso_date(get("creationDate")),
        "modified": iso_date(get("modificationDate")),
        "flags": flags(get("annotationFlags", "long")),
        "title": F.coalesce(get("titleText"), F.lit("")),
        "annotationType": type_name(get("annotationType", "int")),
        "borderStyle": border(get("borderWidth", "int"), get("borderStyle", "int")),
    }
