"""Files made from rows inside tasks, so that decoders have work that grows with the tables."""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
import zlib
from email.message import EmailMessage
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.sources.files import BATCH
from foliospark.sources.formats import decode_name


def zip_file(r: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(f"src/d{r['doc_id']}.TXT", (2024, 1, 2, 3, 4, 6)), r["text"] or "")
        z.writestr(zipfile.ZipInfo(f"src/a.b.{r['lang']}", (2024, 1, 2, 3, 4, 6)), r["source"] or "")
    return out.getvalue()


def eml_file(r: dict) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = f"No. {r['doc_id']}", f"A <{r['lang']}@{r['source']}.example.org>", "b@example.org"
    m.set_content(r["text"] or "", cte="base64")
    return m.as_bytes()


def docx_file(r: dict) -> bytes:
    out = io.BytesIO()
    text = r["text"] or ""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/core.xml", f'<c:coreProperties xmlns:c="c" xmlns:d="d"><d:title>{escape(r["source"] or "")}</d:title><c:lastModifiedBy>{escape(r["lang"] or "")}</c:lastModifiedBy></c:coreProperties>')
        z.writestr("docProps/app.xml", f'<Properties xmlns="p"><Application>docs</Application><Words>{len(text.split())}</Words><Pages>1</Pages></Properties>')
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body>' + "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n")) + "</w:body></w:document>")
    return out.getvalue()


def tiff_file(r: dict) -> bytes:
    texts = {271: r["source"] or "", 272: r["lang"] or "", 306: f"2024:02:{r['doc_id'] % 9 + 1:02d} 10:20:30"}
    numbers = {256: r["doc_id"] % 5000 + 1, 257: (r["n_chars"] or 0) % 4000 + 1}
    entries, tail = [], b""
    at = 8 + 2 + 12 * (len(texts) + len(numbers)) + 4
    for tag in sorted(texts.keys() | numbers.keys()):
        if tag in numbers:
            entries.append(struct.pack("<HHII", tag, 4, 1, numbers[tag]))
        else:
            raw = texts[tag].encode("latin-1", "replace") + b"\0"
            entries.append(struct.pack("<HHI", tag, 2, len(raw)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(tail))))
            tail += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(entries) + struct.pack("<I", 0) + tail


def pdf_file(r: dict) -> bytes:
    lines = (r["text"] or "").split("\n")
    body = [f"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n".encode(), f"2 0 obj\n<< /Type /Pages /Count {len(lines)} >>\nendobj\n".encode(), f"3 0 obj\n<< /Title (No {r['doc_id']}) /CreationDate (D:20240102030405Z) >>\nendobj\n".encode()]
    for k, line in enumerate(lines):
        units = codecs.utf_16_be_encode(" ".join(line.split()))[0].hex(" ", 2)  # four digits each; the spaces of the line part the strings
        shown = "<feff" + units.replace(" 0020 ", "|").replace(" ", "").replace("|", "> Tj T*\n<feff") + "> Tj T*\n" if units else ""
        stream = zlib.compress(f"BT /F1 12 Tf\n{shown}ET".encode())
        body.append(f"{4 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * k} 0 R >>\nendobj\n{5 + 2 * k} 0 obj\n<< /Filter /FlateDecode /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream\nendobj\n")
    return b"%PDF-1.7\n" + b"".join(body) + b"trailer\n<< /Root 1 0 R /Info 3 0 R >>\n%%EOF\n"


MAKERS = {"zip": zip_file, "eml": eml_file, "docx": docx_file, "tiff": tiff_file, "pdf": pdf_file}


def built(docs: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extension, content): a file of the kind for each document, and the columns `keep` as they are."""
    import pyarrow as pa

    used = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(batches):
        make = MAKERS[kind]
        for b in (whole.slice(k, BATCH) for whole in batches for k in range(0, whole.num_rows, BATCH)):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([kind] * b.num_rows, pa.string()), pa.array([make(r) for r in b.select(used).to_pylist()], pa.binary()), *[b.column(c) for c in keep]], names=["doc_id", "extension", "content", *keep])

    return docs.select(*used, *keep).mapInArrow(run, T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("extension string, content binary").fields, *[docs.schema[c] for c in keep]]))


def decoded_names(docs: DataFrame) -> DataFrame:
    """(doc_id, name): a name with Lithuanian letters for each document, encoded in one of three ways and decoded again."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            names = []
            for r in b.to_pylist():
                name = f"{r['lang']}_{r['source']}_aciuz.txt".translate(str.maketrans("ciuz", "čįūž"))
                names.append(decode_name(name.encode(("utf-8", "cp1257", "utf-8")[r["doc_id"] % 3])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string())], names=["doc_id", "name"])

    return docs.select("doc_id", "lang", "source").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("name", T.StringType())]))
