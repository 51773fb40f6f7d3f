"""Office containers as lines: paragraphs, sheets of cells, slides of shapes (standard library, Arrow batches)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points to a unit of drawing.
EMU = 12700.0
SCHEMA = "key string, page_number int, block_index int, line_index int, text string, x0 double, y0 double, x1 double, y1 double, picture boolean, error string, width double, height double, reason string"
#: Pages are at most so wide and high, in points.
MOST = 50_000.0


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _name(k) == name), None)


class _Page:
    """Rows of one page: itself, its lines, its pictures."""

    def __init__(self, key: str, number: int, width: float, height: float, reason: str):
        self.key, self.number = key, number
        self.width, self.height, self.reason = min(width, MOST), min(height, MOST), reason
        self.lines = 0

    def _row(self, block, line, text, box, picture):
        return (self.key, self.number, block, line, text, *(box or (None,) * 4), picture, None, self.width, self.height, self.reason)

    def itself(self):
        return self._row(None, None, None, None, None)

    def line(self, block: int, text: str, box):
        self.lines += 1
        return self._row(block, self.lines - 1, text, box, False)

    def picture(self, box):
        return self._row(0, 0, "", box, True)


def _parts(archive: zipfile.ZipFile, folder: str) -> bool:
    return any(n.lower().startswith(folder) for n in archive.namelist())


def read_docx(key: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs in order, each whole on the page where it begins; one with a page break ends its page.

    Where the file holds pictures, every page has a full-page picture, as their places are not known.
    """
    root = ElementTree.fromstring(archive.read("word/document.xml"))
    width, height = 612.0, 792.0
    for size in (n for n in root.iter() if _name(n.tag) == "pgSz"):
        try:
            width, height = (float(_attribute(size, a) or d) / 20 for a, d in (("w", 12240), ("h", 15840)))
        except ValueError:
            pass
        break
    pictures = _parts(archive, "word/media/")

    def begun(number: int) -> tuple[_Page, list[tuple]]:
        page = _Page(key, number, width, height, "embedded_docx_text")
        return page, [page.itself(), *([page.picture((0.0, 0.0, page.width, page.height))] if pictures else [])]

    page, rows = begun(1)
    yield from rows
    block = 0
    for paragraph in (n for n in root.iter() if _name(n.tag) == "p"):
        nodes = list(paragraph.iter())
        text = "".join(n.text or "" for n in nodes if _name(n.tag) == "t")
        if text.strip():
            top = 36.0 + 18.0 * page.lines
            yield page.line(block, text, (36.0, top, max(40.0, width - 36.0), top + 14.0))
            block += 1
        if any(_name(n.tag) == "br" and _attribute(n, "type") == "page" for n in nodes):
            page, rows = begun(page.number + 1)
            yield from rows


def column_number(letters: Column) -> Column:
    """Zero-based column of a spreadsheet address's letters."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def _address(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Za-z]+)(\d+)", reference).groups()
    column = 0
    for c in letters.upper():
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    try:
        root = ElementTree.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    resolve = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.attrib["Id"]: resolve(r.attrib["Target"]) for r in root}


def _cells(sheet, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the cells with text; a cell without a proper address is left out."""
    for cell in (n for n in sheet.iter() if _name(n.tag) == "c"):
        texts = {kind: next((n.text or "" for n in cell.iter() if _name(n.tag) == kind), None) for kind in ("t", "v")}
        value = texts["v"] or "" if texts["t"] is None else texts["t"]
        if cell.attrib.get("t") == "s":
            value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        address = cell.attrib.get("r", "A1")
        if value.strip() and re.fullmatch(r"[A-Z]+[0-9]+", address):
            yield *_address(address), value


def read_xlsx(key: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
    """A page for each sheet that is there, a line for each cell that isn't blank, 80 by 22 points to a cell.

    Where the file holds pictures, every page has a full-page picture.
    """
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for item in (n for n in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter() if _name(n.tag) == "si"):
            shared.append("".join(n.text or "" for n in item.iter() if _name(n.tag) == "t"))
    targets = _targets(archive, "xl/workbook.xml")
    pictures, number = _parts(archive, "xl/media/"), 0
    sheets = [n for n in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _name(n.tag) == "sheet"]
    for sheet in sheets:
        part = targets.get(_attribute(sheet, "id") or "", "")
        if part not in archive.namelist():
            continue
        number += 1
        cells = list(_cells(ElementTree.fromstring(archive.read(part)), shared))
        width = max([612.0, *(36.0 + 80.0 * c for _, c, _ in cells)])
        height = max([792.0, *(54.0 + 22.0 * r for r, _, _ in cells)])
        page = _Page(key, number, width, height, f"native_xlsx_sheet:{sheet.attrib.get('name', number)}")
        yield page.itself()
        if pictures:
            yield page.picture((0.0, 0.0, width, height))
        for r, c, text in cells:
            yield page.line(r, text, (36.0 + 80.0 * c, 36.0 + 22.0 * r, 108.0 + 80.0 * c, 54.0 + 22.0 * r))


def read_pptx(key: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
    """A page for each slide in the show's order, a line for each shape with text, and boxes of pictures."""
    targets = _targets(archive, "ppt/presentation.xml")
    show = ElementTree.fromstring(archive.read("ppt/presentation.xml"))
    size = next((n for n in show.iter() if _name(n.tag) == "sldSz"), None)
    width, height = (float(size.attrib.get(a, d)) / EMU if size is not None else d / EMU for a, d in (("cx", 9144000), ("cy", 6858000)))
    order = [targets[i] for n in show.iter() if _name(n.tag) == "sldId" and (i := n.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")) in targets]
    order = order or sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))

    def place(shape) -> tuple[float, float, float, float]:
        at = next((n for n in shape.iter() if _name(n.tag) == "off"), None)
        extent = next((n for n in shape.iter() if _name(n.tag) == "ext" and "cx" in n.attrib), None)
        try:
            x, y, w, h = (int(n.attrib.get(a, 0)) / EMU for n, a in ((at, "x"), (at, "y"), (extent, "cx"), (extent, "cy")))
        except (AttributeError, ValueError):
            return (0.0, 0.0, width, height)
        return (max(0.0, x), max(0.0, y), min(width, x + w), min(height, y + h))

    number = 0
    for part in order:
        if part not in archive.namelist():
            continue
        number += 1
        page = _Page(key, number, width, height, "native_pptx_slide")
        yield page.itself()
        slide = list(ElementTree.fromstring(archive.read(part)).iter())
        for shape in (n for n in slide if _name(n.tag) == "sp"):
            words = [t for n in shape.iter() if _name(n.tag) == "t" and (t := (n.text or "").strip())]
            if words:
                yield page.line(page.lines, " ".join(words), place(shape))
        for picture in (n for n in slide if _name(n.tag) == "pic"):
            yield page.picture(place(picture))


_READERS = {"wordprocessingml": read_docx, "spreadsheetml": read_xlsx, "presentationml": read_pptx}


def read_parts(files: DataFrame, key: str = "path") -> DataFrame:
    """Pages (text null), lines and pictures of office files (key, content, content_type); a broken file is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for k, data, kind in zip(batch.iloc[:, 0], batch.iloc[:, 1], batch.iloc[:, 2]):
                reader = next((r for part, r in _READERS.items() if part in (kind or "")), None)
                if reader is None:
                    continue
                try:
                    rows += list(reader(str(k), zipfile.ZipFile(io.BytesIO(data))))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError) as e:
                    rows.append((str(k), *(None,) * 9, f"malformed_office: {type(e).__name__}", None, None, None))
            yield pd.DataFrame(rows, columns=names).astype({"page_number": "Int32", "block_index": "Int32", "line_index": "Int32"})

    return files.select(F.col(key).cast("string"), "content", "content_type").mapInPandas(run, SCHEMA)


def read_office(files: DataFrame, key: str = "path") -> DataFrame:
    """Lines and pictures of office files; a broken file is a row with its error."""
    return read_parts(files, key).where("text is not null or error is not null")
