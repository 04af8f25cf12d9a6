"""Small readers of single files, each from bytes to (pages, metadata, files). They run inside tasks; all that follows is Spark's."""

from __future__ import annotations

import binascii
import codecs
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from email import policy
from email.parser import BytesParser
from xml.etree import ElementTree

Result = tuple[list[str], dict, list[dict]]
#: Encodings in which file names are tried, in this order (fixed values).
NAME_ENCODINGS = ["utf-8", "cp1257", "cp775", "latin-1", "cp1252"]
#: Lithuanian letters, plain characters and bad ones of file names (fixed values), as functions.text.name_score counts them.
NAME_CLASSES = [(3, "[ąčęėįšųūžĄČĘĖĮŠŲŪŽ]"), (1, "[A-Za-z0-9_ .()-]"), (-5, "[\x00-\x1f\x7f\ufffd]")]


class Unsupported(ValueError):
    """The format needs a program or library that is not there."""


def name_score(name: str) -> int:
    """How much a decoded name looks like Lithuanian or plain text."""
    counts = [(worth, len(re.findall(pattern, name))) for worth, pattern in NAME_CLASSES]
    return sum(worth * n for worth, n in counts) - (len(name) - sum(n for _, n in counts))


def decode_name(raw: bytes) -> str:
    """The decoding of the best score, the earlier encoding if scores are equal."""
    tried = [raw.decode(e, errors="replace") for e in NAME_ENCODINGS]
    return max(tried, key=name_score)


def plain(raw: bytes) -> Result:
    return [raw.decode("utf-8", errors="replace").replace("\r\n", "\n")], {}, []


def archive(raw: bytes) -> Result:
    files = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for e in z.infolist():
            name = decode_name(e.orig_filename.encode("utf-8" if e.flag_bits & 0x800 else "cp437", errors="replace"))
            folder, md5, error = name.endswith("/"), None, None
            if not folder:
                try:
                    digest = hashlib.md5()
                    with z.open(e) as f:
                        while part := f.read(1 << 20):
                            digest.update(part)
                    md5 = digest.hexdigest()
                except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError) as x:
                    error = str(x)
            base = name.rstrip("/").rpartition("/")[2]
            dot = re.search(r"[^/]\.([^./]*)$", base)
            files.append({"name": base, "path": name, "size": e.file_size, "compressed_size": e.compress_size, "extension": None if folder else (dot[1].lower() if dot else ""), "last_modified": "%04d-%02d-%02d %02d:%02d:%02d" % e.date_time, "is_directory": folder, "method": e.compress_type, "md5": md5, "error": error})
    return [], {}, files


def mail(raw: bytes) -> Result:
    m = BytesParser(policy=policy.default).parsebytes(raw)
    body = m.get_body(preferencelist=("plain",))
    text = (body.get_content() if body else "").replace("\r\n", "\n")
    html = m.get_body(preferencelist=("html",))
    people = lambda h: [{"name": a.display_name, "email": a.addr_spec} for a in (m[h].addresses if m[h] else ())]
    fields = {"subject": str(m["subject"] or ""), "from": people("from"), "to": people("to"), "cc": people("cc"), "date": str(m["date"] or ""), "text": text, "html": html.get_content() if html else None, "attachments": [{"filename": a.get_filename(), "mimeType": a.get_content_type()} for a in m.iter_attachments()]}
    return [text], fields, []


def office(raw: bytes) -> Result:
    """Properties of an OOXML file, and its text parts in order as pages."""
    local = lambda t: t.rpartition("}")[2]
    meta: dict = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        if "xl/workbook.bin" in names:
            raise Unsupported("binary workbook")
        for n in sorted(x for x in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", x)):
            for c in ElementTree.fromstring(z.read(n)).iter():
                if local(c.tag) == "c" and c.get("t") != "s" and any(local(x.tag) in ("v", "is", "f") for x in c):
                    raise Unsupported("workbook with cells that are no shared strings")
        for part in ("docProps/core.xml", "docProps/app.xml"):
            if part in names:
                for x in ElementTree.fromstring(z.read(part)):
                    if value := "".join(x.itertext()):
                        meta[local(x.tag)] = value
        if "docProps/custom.xml" in names:
            for x in ElementTree.fromstring(z.read("docProps/custom.xml")):
                if x.get("name") and (value := "".join(x.itertext())):
                    meta[x.get("name")] = value
        parts = sorted((n for n in names if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml|xl/sharedStrings\.xml|content\.xml", n)), key=lambda n: [int(d) for d in re.findall(r"\d+", n)])
        pages = []
        for n in parts:
            root = ElementTree.fromstring(z.read(n))
            blocks = [x for x in root.iter() if local(x.tag) in ("p", "si", "h")] or [root]
            pages.append("\n".join(t for b in blocks if (t := "".join(b.itertext()))))
    for old, new in (("created", "CreationDate"), ("modified", "ModifiedDate")):
        if old in meta:
            meta[new] = meta.pop(old)
    for k in ("HeadingPairs", "TitlesOfParts", "HLinks", "Pages", "Slides"):
        meta.pop(k, None)
    meta["Producer"] = meta.get("Application", "")
    meta["Title"] = meta.pop("title", "")
    for old, new in (("Characters", "characterCount"), ("Words", "wordCount"), ("Paragraphs", "paragraphCount")):
        meta[new] = int(meta.pop(old, 0) or 0)
    meta["Author"] = meta.get("Author") or meta.get("lastModifiedBy", "")
    return pages, meta, []


#: TIFF tags by number (fixed values).
TAGS = {256: "ImageWidth", 257: "ImageLength", 271: "Make", 272: "Model", 274: "Orientation", 305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright"}
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def _tiff(raw: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no TIFF header")
    at = struct.unpack(order + "I", raw[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in SIZES:
            continue
        form = f"{order}{n}{SIZES[kind]}"
        size, start = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            start = struct.unpack(order + "I", raw[start : start + 4])[0]
        values = struct.unpack(form, raw[start : start + size])
        out[TAGS.get(tag, f"tag{tag}")] = values[0].split(b"\0")[0].decode("latin-1") if kind == 2 else values[0] if n == 1 else list(values)
    return out


def image(raw: bytes) -> Result:
    tags: dict = {}
    width = height = None
    if raw[:2] in (b"II", b"MM"):
        tags = _tiff(raw)
    elif raw[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", raw[16:24])
    elif raw[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
            marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            part = raw[at + 4 : at + 2 + size]
            if marker == 0xE1 and part[:6] == b"Exif\0\0":
                tags = _tiff(part[6:])
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", part[1:5])
            at += 2 + size
    else:
        raise ValueError("no image that is known")
    day = re.match(r"(\d+)[:/](\d+)[:/](\d+) (\S+)", tags.get("DateTime", ""))
    return [], {"exif": tags, "width": width or tags.get("ImageWidth"), "height": height or tags.get("ImageLength"), "createdAt": f"{day[1]}-{day[2]}-{day[3]} {day[4]}" if day else None, "creator": tags.get("Make"), "model": tags.get("Model"), "software": tags.get("Software")}, []


ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(s: bytes) -> str:
    if s.startswith(b"<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", s)
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), s[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", errors="replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", errors="replace")


STRING = rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>"
#: Operators that show a string, or an array of strings and distances.
SHOWN = re.compile(rb"(" + STRING + rb")\s*(?:Tj|'|\")|\[((?:" + STRING + rb"|[^\]()<>])*)\]\s*TJ", re.S)
#: Those of one string of hex digits with a byte-order mark.
MARKED = re.compile(rb"<(?:feff|FEFF)([0-9A-Fa-f]*)>\s*(?:Tj|'|\")")


def _marked_text(data: bytes) -> str | None:
    """The strings of a stream, decoded at once and joined by spaces; None if there are others than MARKED in it."""
    found = MARKED.findall(data)
    if len(found) != data.count(b"<") or b"(" in data or b"[" in data or any(n % 4 for n in set(map(len, found))):
        return None
    return codecs.utf_16_be_decode(binascii.unhexlify(b"0020".join(found)), "replace", True)[0]


def _stream(body: bytes) -> bytes:
    """The data of a stream object: as long as it says, or up to its end mark."""
    head = re.search(rb"stream\r?\n", body)
    if not head:
        return b""
    said = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: head.start()])
    data = body[head.end() : head.end() + int(said[1])] if said else re.split(rb"\r?\nendstream", body[head.end() :])[0]
    return zlib.decompress(data) if b"/FlateDecode" in body[: head.start()] else data


def _told_pages(objects: dict[bytes, bytes], raw: bytes) -> list[bytes]:
    """The page objects in the order of the page tree, as far as there is one."""
    root = re.search(rb"/Root\s+(\d+)\s+\d+\s+R", raw)
    top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", objects.get(root[1], b"")) if root else None
    todo, seen, out = [top[1]] if top else [], set(), []
    while todo:
        node = todo.pop()
        if node in seen:
            continue
        seen.add(node)
        body = objects.get(node, b"")
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if re.search(rb"/Type\s*/Page\b", body):
            out.append(node)
        elif kids:
            todo += reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids[1]))
    return out


def pdf(raw: bytes) -> Result:
    """Text that is shown by plain fonts in uncompressed or deflated streams; the info dictionary; link targets. Files that are encrypted, have object streams
    only, whose pages stand in the file in another order than in the document, or with text in composite fonts, are not supported."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    objects = {m[1]: m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S)}
    if re.search(rb"/Encrypt\b", raw):
        raise Unsupported("encrypted PDF")
    pages, links = [], []
    there = [n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b", body)]
    told = _told_pages(objects, raw)
    if told and told != there:
        raise Unsupported("PDF pages that stand in another order in the file")
    composite = any(re.search(rb"/Subtype\s*/Type0\b", body) for body in objects.values())
    for body in (objects[n] for n in there):
        text = []
        names = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", names[1]) if names else ():
            data = _stream(objects.get(ref, b""))
            whole = _marked_text(data)
            if whole is not None:
                text.append(whole)
                continue
            for one, several in SHOWN.findall(data):
                shown = [one] if one else re.findall(STRING, several, re.S)
                if composite and not all(re.match(rb"<\s*[Ff][Ee]\s*[Ff]{2}|\(\xfe\xff", x) for x in shown):
                    raise Unsupported("PDF text in composite fonts")
                text.append("".join(map(_pdf_string, shown)))
        pages.append(" ".join(" ".join(text).split()))
        links += [{"page": len(pages), "uri": _pdf_string(u)} for ref in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Annots\s*\[([^\]]*)\]", body) or [b"", b""])[1]) for u in re.findall(rb"/URI\s*(" + STRING + rb")", objects.get(ref, b""), re.S)]
    if not pages:
        raise Unsupported("no page objects outside object streams")
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", raw)
    meta = {k.decode(): _pdf_string(v) for k, v in re.findall(rb"/(\w+)\s*(" + STRING + rb")", objects.get(info[1], b""), re.S)} if info else {}
    return pages, {"info": meta, "annotation_links": links}, []


def legacy(_: bytes) -> Result:
    raise Unsupported("this format needs a converter that is not there")


READERS = {"pdf": pdf, "office": office, "plain": plain, "mail": mail, "archive": archive, "image": image, "legacy": legacy}
#: Reader of each extension (fixed values).
EXTENSIONS = {
    "pdf": "pdf", "prn": "pdf", "docx": "office", "odt": "office", "docm": "office", "dotx": "office", "doc": "legacy", "dot": "legacy", "rtf": "legacy", "pages": "legacy",
    "xlsx": "office", "xlsm": "office", "xlsb": "office", "xls": "legacy", "csv": "legacy", "pptx": "office", "ppsx": "office", "ppt": "legacy", "zip": "archive", "adoc": "archive", "bdoc": "archive",
    "edoc": "archive", "txt": "plain", "url": "plain", "msg": "legacy", "eml": "mail", "7z": "legacy", "jpg": "image", "jpeg": "image", "png": "image", "tif": "image", "tiff": "image", "jfif": "image",
    "odg": "office", "pub": "legacy", "rar": "legacy",
}


def read(reader: str, raw: bytes) -> tuple[list[str], str, list[dict], str | None]:
    """pages, metadata as JSON, files, error: a file that can't be read has an error and nothing else."""
    try:
        pages, meta, files = READERS[reader](raw)
        return pages, json.dumps(meta, ensure_ascii=False, default=str, separators=(",", ":")), files, None
    except Unsupported as e:
        return [], "{}", [], f"unsupported: {e}"
    except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, zlib.error, ElementTree.ParseError, UnicodeError, LookupError) as e:
        return [], "{}", [], f"unreadable: {e}"

