"""Formats without a Spark reader: small per-document helpers inside Arrow batches, one document a row.

Each reader takes a DataFrame with a text or binary column and adds what the
documents hold; files come from `files.read_text` or `files.read_binary`.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from email.parser import BytesParser
from email.policy import EmailPolicy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, parse: Callable[[bytes | str], object], name: str, schema: str) -> DataFrame:
    """`df` with `name`: parse(value) of each non-null value, as the DDL type `schema`."""

    @F.pandas_udf(schema)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series([None if v is None else parse(v) for v in s], dtype=object)

    return df.withColumn(name, run(F.col(column)))


def yaml_json(text: str) -> str:
    """A single YAML document as JSON; aliases and merges are resolved, repeated keys are errors."""
    import yaml

    class Unique(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        keys = [k.value for k, _ in node.value if k.tag != "tag:yaml.org,2002:merge"]
        if len(keys) != len(set(keys)):
            raise ValueError("yaml: repeated key")
        loader.flatten_mapping(node)
        return dict(loader.construct_pairs(node, deep=True))

    Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return json.dumps(yaml.load(text, Unique), ensure_ascii=False, default=str)  # noqa: S506


def read_yaml(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """Documents as JSON text, for from_json."""
    return parsed(df, column, yaml_json, name, "string")


def yaml_text(value: str) -> str:
    import yaml

    return yaml.safe_dump(json.loads(value), sort_keys=False, allow_unicode=True)


def write_yaml(df: DataFrame, column: str, name: str = "yaml") -> DataFrame:
    """JSON text as YAML text."""
    return parsed(df, column, yaml_text, name, "string")


ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def properties(text: str) -> dict[str, str]:
    """Comments, continuations and escapes resolved; the last of equal keys."""
    lines = re.sub(r"(?<!\\)((?:\\\\)*)\\\r?\n[ \t\f]*", r"\1", text).splitlines()
    plain = lambda s: re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), s)
    out: dict[str, str] = {}
    for line in (x.lstrip(" \t\f") for x in lines):
        if line and line[0] not in "#!":
            m = re.match(r"((?:\\.|[^\\:= \t\f])*)[ \t\f]*[:=]?[ \t\f]*(.*)", line, re.S)
            out[plain(m[1])] = plain(m[2])
    return out


def read_properties(df: DataFrame, column: str, name: str = "properties") -> DataFrame:
    return parsed(df, column, lambda t: json.dumps(properties(t), ensure_ascii=False), "_json", "string").withColumn(name, F.from_json("_json", "map<string,string>")).drop("_json")


#: Headers without escapes, folds, comments or codes, which read as they stand.
PARAMETERS = r'(?:; [A-Za-z]+="[\w.#+-]+(?: [\w.#+-]+)*")*'
PLAIN = re.compile(rf"content-disposition: [\w-]+{PARAMETERS}|content-type: [\w-]+/[\w.+-]+{PARAMETERS}|content-transfer-encoding: [\w-]+", re.A)


class FormPolicy(EmailPolicy):
    """The email package's grammar of headers, which takes most of a small form's time, only for headers that need it."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        return value if PLAIN.fullmatch(f"{name.lower()}: {value}") else super().header_fetch_parse(name, value)


FORM = FormPolicy(linesep="\r\n", max_line_length=None)


def multipart(data: bytes | str) -> list[dict]:
    """Parts of a form; the boundary is the first line."""
    data = data.encode() if isinstance(data, str) else bytes(data)
    boundary = data.split(b"\n", 1)[0].strip()
    if not boundary.startswith(b"--") or len(boundary) < 3:
        raise ValueError("multipart: no boundary")
    head = b'Content-Type: multipart/form-data; boundary="' + boundary[2:] + b'"\r\n\r\n'
    out = []
    for p in BytesParser(policy=FORM).parsebytes(head + data).iter_parts():
        body = p.get_payload(decode=True) or b""
        out.append({"name": p.get_param("name", header="content-disposition"), "filename": p.get_filename(), "contentType": p.get_content_type() if p["content-type"] else None, "content": body.decode("utf-8", "replace")})
    return out


def read_multipart(df: DataFrame, column: str, name: str = "parts") -> DataFrame:
    schema = "array<struct<name:string,filename:string,contentType:string,content:string>>"
    return parsed(df, column, lambda d: json.dumps(multipart(d), ensure_ascii=False), "_json", "string").withColumn(name, F.from_json("_json", schema)).drop("_json")


def multipart_text(parts: Column, boundary: str = "----loomframe") -> Column:
    """The form text of array<struct<name, filename, contentType, content>>."""
    def one(p: Column) -> Column:
        file = F.when(p["filename"].isNotNull(), F.concat(F.lit('; filename="'), p["filename"], F.lit('"'))).otherwise("")
        kind = F.when(p["contentType"].isNotNull(), F.concat(F.lit("Content-Type: "), p["contentType"], F.lit("\r\n"))).otherwise("")
        return F.concat(F.lit(f'--{boundary}\r\nContent-Disposition: form-data; name="'), p["name"], F.lit('"'), file, F.lit("\r\n"), kind, F.lit("\r\n"), F.coalesce(p["content"], F.lit("")), F.lit("\r\n"))

    return F.concat(F.array_join(F.transform(parts, one), ""), F.lit(f"--{boundary}--\r\n"))


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx(data: bytes) -> dict[str, list[dict]]:
    """{sheet: [row]}; the first row has the names. Cells are numbers, Booleans, text or null."""
    book = zipfile.ZipFile(io.BytesIO(data))
    tree = lambda n: ElementTree.fromstring(book.read(n))
    shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    links = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}

    def value(c: ElementTree.Element) -> object:
        kind, v = c.get("t", "n"), c.find(f"{SHEET}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        return float(v.text) if kind == "n" else v.text

    out = {}
    for s in tree("xl/workbook.xml").iter(f"{SHEET}sheet"):
        target = links[s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
        rows = []
        for row in tree("xl/" + target.removeprefix("/xl/")).iter(f"{SHEET}row"):
            cells = {}
            for i, c in enumerate(row):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = i if not letters else sum((ord(ch) - 64) * 26**k for k, ch in enumerate(reversed(letters[0]))) - 1
                cells[at] = value(c)
            rows.append(cells)
        head = rows[0] if rows else {}
        out[s.get("name")] = [{str(h): r.get(i) for i, h in head.items() if h is not None} for r in rows[1:]]
    return out


def read_xlsx(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """Workbooks as JSON text {sheet: [row]}, for from_json."""
    return parsed(df, column, lambda d: json.dumps(xlsx(bytes(d)), ensure_ascii=False), name, "string")


def xlsx_bytes(sheets: Mapping[str, Sequence[Mapping]]) -> bytes:
    """A minimal workbook, sheets by name, with inline strings."""
    from xml.sax.saxutils import escape, quoteattr

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    names, out = sorted(sheets), io.BytesIO()
    main, rel = SHEET[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda n, t: z.writestr(zipfile.ZipInfo(n), '<?xml version="1.0" encoding="UTF-8"?>' + t)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        put("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            head = list(dict.fromkeys(k for r in sheets[n] for k in r))
            rows = [dict(zip(head, head, strict=True)), *sheets[n]]
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(cell(r.get(k)) for k in head) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def write_xlsx(df: DataFrame, column: str, name: str = "content") -> DataFrame:
    """JSON text {sheet: [row]} as workbooks."""
    return parsed(df, column, lambda t: xlsx_bytes(json.loads(t)), name, "binary")


#: Fixed values of the wire format: scalar kinds by wire type, and their struct codes.
VARINTS = {"int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool", "enum"}
FIXED = {"fixed32": "<I", "sfixed32": "<i", "float": "<f", "fixed64": "<Q", "sfixed64": "<q", "double": "<d"}


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n, at


def from_varint(n: int, kind: str) -> object:
    if kind == "bool":
        return bool(n)
    if kind in ("sint32", "sint64"):
        return (n >> 1) ^ -(n & 1)
    return n - (1 << 64) if kind in ("int32", "int64", "enum") and n >= 1 << 63 else n


def proto_decode(data: bytes, fields: Sequence[Mapping], strict: bool = False) -> dict:
    """A message by its field list: number, name, type, and repeated, schema (type message), map (key, value fields)."""
    by, out, at = {f["number"]: f for f in fields}, {}, 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == 0:
            raw, at = varint(data, at)
        elif wire == 2:
            n, at = varint(data, at)
            raw, at = data[at : at + n], at + n
            if len(raw) != n:
                raise ValueError("protobuf: cut short")
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            raw, at = data[at : at + n], at + n
        else:
            raise ValueError("protobuf: unknown wire type")
        f = by.get(tag >> 3)
        if f is None:
            if strict:
                raise ValueError(f"protobuf: unknown field {tag >> 3}")
            continue
        kind, values = f["type"], []
        if wire == 2 and kind in VARINTS:
            i = 0
            while i < len(raw):
                n, i = varint(raw, i)
                values.append(from_varint(n, kind))
        elif kind in FIXED:
            size = struct.calcsize(FIXED[kind])
            values = [struct.unpack_from(FIXED[kind], raw, i)[0] for i in range(0, len(raw), size)]
        elif kind in VARINTS:
            values = [from_varint(raw, kind)]
        else:
            values = [raw.decode() if kind == "string" else proto_decode(raw, f["schema"], strict) if kind in ("message", "map") else raw.hex()]
        if kind == "map":
            out.setdefault(f["name"], {}).update({str(v.get("key", "")): v.get("value") for v in values})
        elif f.get("repeated"):
            out.setdefault(f["name"], []).extend(values)
        elif strict and f["name"] in out:
            raise ValueError(f"protobuf: repeated {f['name']}")
        else:
            out[f["name"]] = values[-1] if values else None
    return out


def put_varint(n: int) -> bytes:
    n, out = n & ((1 << 64) - 1), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def proto_encode(value: Mapping, fields: Sequence[Mapping]) -> bytes:
    """The inverse; fields by number, repeated numbers packed."""
    def scalar(v: object, kind: str) -> bytes:
        if kind in FIXED:
            return struct.pack(FIXED[kind], v)
        return put_varint((v << 1) ^ (v >> 63) if kind in ("sint32", "sint64") else int(v))

    out = b""
    for f in sorted(fields, key=lambda f: f["number"]):
        v, kind, key = value.get(f["name"]), f["type"], f["number"] << 3
        if v is None:
            continue
        if kind == "map":
            v, kind = [{"key": k, "value": x} for k, x in v.items()], "message"
        many = v if isinstance(v, list) else [v]
        if kind in VARINTS or kind in FIXED:
            body = b"".join(scalar(x, kind) for x in many)
            if f.get("repeated"):
                out += put_varint(key | 2) + put_varint(len(body)) + body
            else:
                out += put_varint(key | (0 if kind in VARINTS else 5 if len(body) == 4 else 1)) + body
        else:
            for x in many:
                body = x.encode() if kind == "string" else proto_encode(x, f["schema"]) if kind == "message" else bytes.fromhex(x)
                out += put_varint(key | 2) + put_varint(len(body)) + body
    return out


def read_protobuf(df: DataFrame, column: str, fields: Sequence[Mapping], name: str = "json", strict: bool = False) -> DataFrame:
    """Messages as JSON text (bytes in hex), for from_json."""
    return parsed(df, column, lambda d: json.dumps(proto_decode(bytes(d), fields, strict), ensure_ascii=False), name, "string")


def write_protobuf(df: DataFrame, column: str, fields: Sequence[Mapping], name: str = "content") -> DataFrame:
    return parsed(df, column, lambda t: proto_encode(json.loads(t), fields), name, "binary")
