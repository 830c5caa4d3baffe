"""Parsers that Spark has no reader for, run over whole files (binaryFile rows) in Arrow-independent pandas batches.

Each parser is a plain function from bytes to rows, so that it can be tested alone; ``parse_files`` runs one over a
DataFrame with ``path`` and ``content`` and gives either rows or one failure for each file, never both.
"""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ParseError(ValueError):
    """A typed failure: the code is the first argument."""

    @property
    def code(self) -> str:
        return self.args[0]


#: Rows and bytes of files after which ``parse_files`` hands a frame on.
FRAME_ROWS, FRAME_BYTES = 10_000, 8 << 20


def parse_files(df: DataFrame, parser: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """path, failure (null for rows) and the parser's columns; a file that fails gives its failure alone."""
    names = [part.strip().split(" ")[0] for part in re.split(r",(?![^<]*>)", schema)]
    columns = ["path", "failure", *names]

    def frame(held: list[tuple]) -> pd.DataFrame:
        values = zip(*held, strict=True) if held else ((),) * len(columns)
        return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(columns, values, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0  # a frame costs more than a small file's rows, so files share one
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                content = bytes(content if content is not None else b"")
                try:
                    held += [(path, None, *map(r.get, names)) for r in list(parser(content))]
                except ParseError as e:
                    held.append((path, e.code, *(None,) * len(names)))
                size += len(content)
                if len(held) >= FRAME_ROWS or size >= FRAME_BYTES:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    return df.select("path", "content").mapInPandas(run, f"path string, failure string, {schema}")


# --- delimited text -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableLimits:
    max_bytes: int = 64 << 20
    max_rows: int = 100_000
    max_columns: int = 1_000
    max_cells: int = 1_000_000
    max_cell_bytes: int = 1 << 20


CELLS = "row_index long, column_index long, start_byte long, end_byte long, raw string, decoded string"
_FIELD = re.compile(rb'"(?:[^"]|"")*"|[^,\r\n"]*')
_TAB_FIELD = re.compile(rb'"(?:[^"]|"")*"|[^\t\r\n"]*')
_LINE_END = re.compile(rb"\r\n|\r|\n")


def delimited_cells(content: bytes, delimiter: str = ",", limits: TableLimits = TableLimits()) -> Iterator[dict]:
    """Every cell with its byte span, its raw and its decoded text. Quotes must enclose a whole field; rows must be of
    one width; a byte order mark is skipped and counted."""
    if not content or len(content) > limits.max_bytes:
        raise ParseError("limit_exceeded")
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        raise ParseError("bad_encoding") from None
    at = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    field, mark = (_FIELD, b",") if delimiter == "," else (_TAB_FIELD, b"\t")
    row = column = cells = 0
    width = None
    while at < len(content):
        m = field.match(content, at)
        raw = m.group()
        if len(raw) > limits.max_cell_bytes:
            raise ParseError("limit_exceeded")
        text = raw.decode()
        quoted = raw.startswith(b'"')
        yield {"row_index": row, "column_index": column, "start_byte": at, "end_byte": m.end(), "raw": text, "decoded": text[1:-1].replace('""', '"') if quoted else text}
        cells += 1
        column += 1
        if cells > limits.max_cells or column > limits.max_columns:
            raise ParseError("limit_exceeded")
        at = m.end()
        if content[at : at + 1] == mark:
            at += 1
            if at == len(content):  # a delimiter at the end opens one more, empty, cell
                yield {"row_index": row, "column_index": column, "start_byte": at, "end_byte": at, "raw": "", "decoded": ""}
                column += 1
            else:
                continue
        end = _LINE_END.match(content, at)
        if at < len(content) and not end:
            raise ParseError("invalid_structure")  # an open quote, a quote inside a field, or text after one
        if width is not None and column != width:
            raise ParseError("invalid_structure")
        width, column, row = column, 0, row + 1
        if row > limits.max_rows:
            raise ParseError("limit_exceeded")
        at = end.end() if end else at


PREVIEW = "row_index long, column_index long, header string, value_json string, location long"


def delimited_preview(content: bytes, delimiter: str = ",") -> Iterator[dict]:
    """Cells below a header, as JSON strings, with the file row they stand in."""
    try:
        rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter=delimiter, strict=True))
    except UnicodeDecodeError:
        raise ParseError("bad_encoding") from None
    except csv.Error:
        raise ParseError("invalid_structure") from None
    if not rows or any(not h for h in rows[0]) or len(set(rows[0])) != len(rows[0]) or any(len(r) != len(rows[0]) for r in rows):
        raise ParseError("invalid_structure")
    for i, r in enumerate(rows[1:]):
        for j, v in enumerate(r):
            yield {"row_index": i, "column_index": j, "header": rows[0][j], "value_json": json_scalar(v), "location": i + 2}


class _Number(str):
    pass


def json_scalar(value, limit: int = 8192) -> str:
    """A scalar as JSON text: numbers as they were written, nothing nested."""
    if isinstance(value, (dict, list)):
        raise ParseError("nested_value")
    text = str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)
    if len(text) > limit:
        raise ParseError("limit_exceeded")
    return text


def json_records(content: bytes) -> Iterator[dict]:
    """Cells of JSON records: a list, one under records, data or results, or GeoJSON features' properties. Columns are
    in order of first appearance; a missing key is null; numbers keep their lexeme."""

    def refuse(_):
        raise ParseError("invalid_number")

    try:
        data = json.loads(content.decode("utf-8-sig"), parse_int=_Number, parse_float=_Number, parse_constant=refuse)
    except UnicodeDecodeError:
        raise ParseError("bad_encoding") from None
    except json.JSONDecodeError:
        raise ParseError("invalid_structure") from None
    if isinstance(data, dict) and data.get("type") == "FeatureCollection":
        features = data.get("features")
        data = [f.get("properties") if isinstance(f, dict) else None for f in features] if isinstance(features, list) else None
    elif isinstance(data, dict):
        data = next((data[k] for k in ("records", "data", "results") if isinstance(data.get(k), list)), None)
    if not isinstance(data, list) or not data or any(not isinstance(r, dict) for r in data):
        raise ParseError("invalid_structure")
    columns = list(dict.fromkeys(k for r in data for k in r))
    for i, r in enumerate(data):
        for j, k in enumerate(columns):
            yield {"row_index": i, "column_index": j, "header": k, "value_json": json_scalar(r.get(k)), "location": i + 1}


# --- documents ------------------------------------------------------------------------------------------------------

BLOCKS = "block_index long, kind string, text string, start_byte long, end_byte long"


def paragraphs(content: bytes) -> Iterator[dict]:
    """Runs of lines that are not blank, with byte spans that end before the line end."""
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        raise ParseError("bad_encoding") from None
    start, at, index = None, 0, 0
    end = 0
    for line in content.splitlines(keepends=True):
        body = line.rstrip(b"\r\n")
        if body.strip():
            start, end = (at if start is None else start), at + len(body)
        elif start is not None:
            yield {"block_index": index, "kind": "paragraph", "text": content[start:end].decode(), "start_byte": start, "end_byte": end}
            start, index = None, index + 1
        at += len(line)
    if start is not None:
        yield {"block_index": index, "kind": "paragraph", "text": content[start:end].decode(), "start_byte": start, "end_byte": end}


#: HTML elements that end a block, that hide their content, and what kind of block an element makes.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("script style template iframe object".split())
KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list_item", "pre": "code", "caption": "caption", "figcaption": "caption"}
ATTACHMENTS = (".csv", ".tsv", ".json", ".xlsx", ".xls", ".zip", ".fits", ".pdf", ".txt", ".xml", ".parquet")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((next((KINDS[t] for t in reversed(self.open) if t in KINDS), "paragraph"), text))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        if tag in BLOCK_TAGS:
            self.flush()
            if tag not in ("br", "hr"):
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in self.open:
                while self.open.pop() != tag:
                    pass

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_blocks(html: str) -> list[tuple[str, str]]:
    """(kind, text) of the visible blocks in source order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def with_html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, block_index, kind and text of each block of an HTML column; a null has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *b) for k, h in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for i, b in enumerate(html_blocks(h or ""))]
            yield pd.DataFrame(rows, columns=[key, "block_index", "kind", "text"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, block_index long, kind string, text string")


def attachment_links(html: Column, base: Column | None = None, hosts: list[str] | None = None, most: int | None = None) -> Column:
    """https addresses of anchors that name a data file or have a ``download`` attribute, each once, in order, ``most`` at
    most: expressions alone. base: the page's address, which a path stands for a file on; hosts: those allowed, where none
    are given any for absolute addresses."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    suffix = "|".join(a[1:] for a in ATTACHMENTS)
    site = F.regexp_extract(F.coalesce(base, F.lit("")), r"(?i)^(https://[^/?#]+)", 1) if base is not None else F.lit("")

    def address(tag: Column) -> Column:
        href = F.trim(F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']([^\"']+)[\"']", 1))
        whole = F.when(href.rlike("^/(?!/)") & (site != ""), F.concat(site, href)).otherwise(href)
        wanted = F.lower(whole).rlike(rf"^https://[^?#]*\.(?:{suffix})(?:[?#]|$)") | tag.rlike(r"(?is)\sdownload(?=[\s=>/])")
        allowed = F.lower(F.regexp_extract(whole, r"(?i)^https://([^/?#:]+)", 1)).isin([h.lower() for h in hosts]) if hosts is not None else F.lit(True)
        return F.when(whole.rlike("(?i)^https://[^/?#]") & wanted & allowed, whole)

    found = F.array_distinct(F.array_compact(F.transform(tags, address)))
    return found if most is None else F.slice(found, 1, most)


#: Suffixes of archive members that are sampled, and what a preview may show.
SAMPLED = (".csv", ".tsv", ".json", ".geojson", ".txt")
PREVIEW_CHARACTERS, PREVIEW_NAMES, PREVIEW_SAMPLES, SAMPLE_BYTES, LARGEST_SAMPLED = 2048, 80, 2, 1024, 64 << 20
SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def content_preview(content: bytes, media: str) -> str:
    """A short text that tells what a file holds: its own text, a workbook's strings, or an archive's members with samples
    of two of them."""
    media, text = media.lower(), ""
    try:
        if media.startswith("text/") or media in ("application/json", "application/geo+json"):
            text = content.decode("utf-8-sig")
        elif media == SHEET:
            from xml.etree import ElementTree

            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if z.getinfo("xl/sharedStrings.xml").file_size > LARGEST_SAMPLED:
                    raise ValueError
                strings = z.read("xl/sharedStrings.xml")
            if b"<!DOCTYPE" in strings or b"<!ENTITY" in strings:
                raise ValueError
            text = " | ".join(e.text or "" for e in ElementTree.fromstring(strings).iter() if e.tag.endswith("}t"))
        elif media in ("application/zip", "application/gzip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                shown = "archive members: " + " | ".join(z.namelist()[:PREVIEW_NAMES])
                samples = []
                for info in z.infolist():
                    if len(samples) == PREVIEW_SAMPLES:
                        break
                    if not info.is_dir() and info.file_size <= LARGEST_SAMPLED and info.filename.lower().endswith(SAMPLED):
                        with z.open(info) as f:
                            sample = " ".join(f.read(SAMPLE_BYTES).decode("utf-8-sig", "replace").split())
                        samples += [f"sample {info.filename}: {sample}"] if sample else []
                text = shown + ("; embedded records: " + " || ".join(samples) if samples else "")
    except (ValueError, KeyError, OSError, RuntimeError, SyntaxError, zipfile.BadZipFile):
        text = ""
    plain = " ".join(text.split()) or f"no textual preview; media={media}; bytes={len(content)}"
    return plain[:PREVIEW_CHARACTERS]


def with_previews(files: DataFrame) -> DataFrame:
    """path and preview of files (path, content, media). A null content is empty, a null media unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shown = [content_preview(bytes(c) if c is not None else b"", m or "") for c, m in zip(batch.content, batch.media, strict=True)]
            yield pd.DataFrame({"path": batch.path, "preview": shown})

    return files.select("path", "content", "media").mapInPandas(run, "path string, preview string")


#: The member that makes a ZIP a workbook, a text or a presentation.
OFFICE = {"xl/workbook.xml": "xlsx", "word/document.xml": "docx", "ppt/presentation.xml": "pptx"}
#: Confidence in a media type that the content does not bear out, at most.
MISMATCH = 0.69


def office_kind(content: bytes) -> str | None:
    """xlsx, docx or pptx by the names in a ZIP's directory, which stands at its end; nothing is unpacked."""
    try:
        names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
    except (zipfile.BadZipFile, ValueError, OSError):
        return None
    found = [kind for name, kind in OFFICE.items() if name in names]
    return found[0] if len(found) == 1 and "[Content_Types].xml" in names else None


def classify(files: DataFrame) -> DataFrame:
    """path, media, family and confidence of files (path, content, declared): magic numbers first, Office files by their
    directory, else text by its shape. A declared type that disagrees caps the confidence."""
    by_magic = magic(F.col("content"))
    seen = files.select("path", F.lower(F.trim(F.substring_index("declared", ";", 1))).alias("declared"), by_magic.alias("m"), F.when(by_magic == "application/zip", F.col("content")).alias("zip"), F.col("content"))

    @F.pandas_udf("string")
    def kind(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else office_kind(bytes(c)))

    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    known = seen.withColumn("office", kind("zip"))
    family = F.coalesce("office", F.regexp_replace(F.col("m"), "^.*[/.-]", ""))
    media = F.when(F.col("office") == "xlsx", SHEET).otherwise(F.coalesce("m", text_media(F.coalesce(text, F.lit("")))))
    told = known.select("path", "declared", media.alias("media"), F.coalesce(family, F.regexp_replace(media, "^.*[/.-]", "")).alias("family"), F.when(F.col("m").isNotNull(), 0.99).otherwise(0.8).alias("c"))
    agrees = F.coalesce(F.col("declared") == F.col("media"), F.lit(True)) | F.col("declared").isin("", "application/octet-stream")
    return told.select("path", "media", "family", F.when(agrees, F.col("c")).otherwise(F.least(F.col("c"), F.lit(MISMATCH))).alias("confidence"))


def pdf_text(content: bytes) -> Iterator[dict]:
    """The text layer of a PDF where a PDF library is installed; a blocked attempt elsewhere."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ParseError("parser_unavailable") from None
    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise ParseError("encrypted")
    for i, page in enumerate(reader.pages):
        yield {"block_index": i, "kind": "page", "text": page.extract_text(), "start_byte": None, "end_byte": None}


# --- archives, images, FITS -----------------------------------------------------------------------------------------

MEMBERS = "name string, size long, sha256 string, content binary"


def zip_members(content: bytes, max_entries: int = 1000, max_bytes: int = 256 << 20, max_ratio: int = 200) -> Iterator[dict]:
    """Members of a ZIP; the archive is refused whole if any is unsafe, encrypted, too large or damaged."""
    import hashlib

    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ParseError("invalid_structure") from None
    infos = [i for i in archive.infolist() if not i.is_dir()]
    names = [i.filename for i in infos]
    if len(infos) > max_entries or sum(i.file_size for i in infos) > max_bytes:
        raise ParseError("limit_exceeded")
    for i in infos:
        parts = i.filename.replace("\\", "/").split("/")
        if i.filename.startswith("/") or ".." in parts or ":" in parts[0] or "\x00" in i.filename:
            raise ParseError("unsafe_path")
        if i.flag_bits & 1:
            raise ParseError("encrypted")
        if (i.external_attr >> 28) not in (0, 8):
            raise ParseError("not_a_regular_file")
        if i.file_size > max_ratio * max(1, i.compress_size):
            raise ParseError("limit_exceeded")
    if len({n.casefold() for n in names}) != len(names):
        raise ParseError("duplicate_path")
    try:
        for i in infos:
            data = archive.read(i)
            yield {"name": i.filename, "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "content": data}
    except (zipfile.BadZipFile, zlib.error, EOFError):
        raise ParseError("checksum_mismatch") from None


POINTS = "component long, pixels long, left long, top long, right long, bottom long, x double, y double"


def ppm_pixels(content: bytes):
    """The [height, width, 3] array of a binary P6 image with 255 levels."""
    import numpy as np

    m = re.match(rb"P6(?:[ \t\r\n]+(?:#[^\r\n]*[\r\n])*)+(\d+)(?:[ \t\r\n]+(?:#[^\r\n]*[\r\n])*)+(\d+)(?:[ \t\r\n]+(?:#[^\r\n]*[\r\n])*)+(\d+)[ \t\r\n]", content)
    if not m or m[3] != b"255":
        raise ParseError("invalid_structure")
    width, height = int(m[1]), int(m[2])
    if len(content) - m.end() != width * height * 3:
        raise ParseError("invalid_structure")
    return np.frombuffer(content, np.uint8, offset=m.end()).reshape(height, width, 3)


def ppm_components(content: bytes, rgb: tuple[int, int, int], tolerance: int = 0, min_pixels: int = 1) -> Iterator[dict]:
    """4-connected components of one colour in one image, in reading order of their first pixel."""
    import numpy as np

    image = ppm_pixels(content).astype(int)
    match = (abs(image - np.array(rgb)) <= tolerance).all(axis=2)
    label = np.where(match, np.arange(match.size).reshape(match.shape), match.size)
    while True:  # each pixel takes the least label around it until nothing changes
        near = label.copy()
        near[1:] = np.minimum(near[1:], label[:-1])
        near[:-1] = np.minimum(near[:-1], label[1:])
        near[:, 1:] = np.minimum(near[:, 1:], label[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], label[:, 1:])
        near = np.where(match, near, match.size)
        if (near == label).all():
            break
        label = near
    number = 0
    for root in np.unique(label[match]):
        y, x = np.nonzero(label == root)
        if len(x) >= min_pixels:
            yield {"component": number, "pixels": len(x), "left": int(x.min()), "top": int(y.min()), "right": int(x.max()), "bottom": int(y.max()), "x": float(x.mean()), "y": float(y.mean())}
            number += 1


SCALARS = "variable string, row_index long, kind string, raw_value string, physical_value string, missing_reason string"
_FITS_TYPES = {"D": (">d", 8), "E": (">f", 4), "I": (">h", 2), "J": (">i", 4), "K": (">q", 8), "B": (">B", 1), "L": ("c", 1)}


def fits_table(content: bytes, variables: list[str] | None = None, first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Scalars of the first binary table: raw value, physical value (raw * TSCAL + TZERO) and why a value is missing."""
    at = 0
    while True:
        header: dict[str, str] = {}
        done = False
        while not done:
            block = content[at : at + 2880]
            if len(block) < 2880:
                raise ParseError("invalid_structure")
            at += 2880
            for card in (block[i : i + 80].decode("ascii", "replace") for i in range(0, 2880, 80)):
                done |= card.startswith("END")
                if card[8:10] == "= " and not done:
                    value = card[10:].split(" /")[0].strip() if "'" not in card[10:] else card[10:].split("'")[1].strip()
                    header[card[:8].strip()] = value
        size = abs(int(header.get("BITPIX", 8))) // 8
        axes = [int(header[f"NAXIS{i}"]) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
        length = size * (0 if not axes else 1)
        for n in axes:
            length *= n
        if header.get("XTENSION") == "BINTABLE":
            break
        at += -(-length // 2880) * 2880
    width, rows = axes
    offset, columns = 0, []
    for i in range(1, int(header["TFIELDS"]) + 1):
        form = re.fullmatch(r"(\d*)([A-Z])", header[f"TFORM{i}"])
        count, code = int(form[1] or 1), form[2]
        if code != "A" and (code not in _FITS_TYPES or count != 1):
            raise ParseError("unsupported_type")
        columns.append((header.get(f"TTYPE{i}", f"col{i}"), code, count, offset, header.get(f"TSCAL{i}"), header.get(f"TZERO{i}"), header.get(f"TNULL{i}")))
        offset += count * (1 if code == "A" else _FITS_TYPES[code][1])
    text = lambda d: format(d.normalize() if d else Decimal(0), "f")
    for name, code, count, offset, scale, zero, null in columns:
        if variables is not None and name not in variables:
            continue
        for r in range(first, rows if last is None else min(last, rows)):
            cell = content[at + r * width + offset :][: count if code == "A" else _FITS_TYPES[code][1]]
            row = {"variable": name, "row_index": r, "kind": "text"}
            if code == "A":
                yield row | {"raw_value": cell.decode("ascii", "replace").rstrip(), "physical_value": cell.decode("ascii", "replace").rstrip()}
            elif code == "L":
                yield row | {"kind": "boolean", "raw_value": "true" if cell == b"T" else "false", "physical_value": "true" if cell == b"T" else "false"}
            else:
                value = struct.unpack(_FITS_TYPES[code][0], cell)[0]
                if value != value or value in (float("inf"), float("-inf")):
                    yield row | {"kind": "missing", "missing_reason": "non_finite"}
                elif null is not None and code in "IJKB" and value == int(null):
                    yield row | {"kind": "missing", "missing_reason": "fits_null", "raw_value": str(value)}
                else:
                    raw = Decimal(str(value))
                    yield row | {"kind": "decimal" if code in "DE" or scale else "integer", "raw_value": text(raw), "physical_value": text(raw * Decimal(scale or "1") + Decimal(zero or "0"))}


# --- what is it? ----------------------------------------------------------------------------------------------------


def magic(content: Column) -> Column:
    """Media type by the first bytes, null if they say nothing: expressions alone."""
    start = F.hex(F.substring(content, 1, 10))
    told = (
        ("255044462D", "application/pdf"),
        ("89504E470D0A1A0A", "image/png"),
        ("FFD8FF", "image/jpeg"),
        ("49492A00", "image/tiff"),
        ("4D4D002A", "image/tiff"),
        ("894844460D0A1A0A", "application/x-hdf5"),
        ("53494D504C4520203D", "application/fits"),
        ("1F8B", "application/gzip"),
        ("504B0304", "application/zip"),
        ("504B0506", "application/zip"),
        ("504B0708", "application/zip"),
    )
    out = F.when(F.startswith(start, F.lit("50415231")) & (F.hex(F.substring(content, -4, 4)) == "50415231") & (F.octet_length(content) >= 8), "application/vnd.apache.parquet")
    for prefix, media in told:
        out = out.when(F.startswith(start, F.lit(prefix)), media)
    return out


def text_media(text: Column) -> Column:
    """Media type of text: HTML, JSON, delimited or plain."""
    body = F.regexp_replace(text, r"^[﻿\t\r\n ]+", "")
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda line: F.trim(line) != "")
    sample = F.slice(lines, 1, 20)
    widths = lambda mark: F.array_distinct(F.transform(sample, lambda x: F.size(F.split(x, mark))))
    table = F.lit(False)
    for mark in (",", "\t", ";", r"\|"):
        table = table | ((F.size(widths(mark)) == 1) & (F.get(widths(mark), F.lit(0)) >= 2))
    return (
        F.when(F.lower(F.left(body, F.lit(512))).rlike("^(?:<!doctype html|<html|<head|<body)"), "text/html")
        .when(body.rlike(r"^[\[{]") & F.try_parse_json(body).isNotNull(), "application/json")
        .when((F.size(lines) >= 2) & table, "text/csv")
        .otherwise("text/plain")
    )


def format_of(media: Column, url: Column) -> Column:
    """Preview format: by media type first, by the address's suffix else."""
    by_media = (
        F.when(media == "text/csv", "csv").when(media == "text/tab-separated-values", "tsv").when(media.isin("application/json", "application/geo+json"), "json")
    )
    suffix = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(by_media, F.when(suffix.isin("csv", "tsv", "json"), suffix).when(suffix == "geojson", "json"))
