"""Office files to lines of text, with the standard library only.

Small per-file helpers; Spark hands them one file's bytes at a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _kept(lines) -> str:
    return "\n".join(t for t in (line.strip() for line in lines) if t)


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (kind, part name) of a package part."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    found = {}
    for rel in ET.fromstring(archive.read(rels)):
        target = rel.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        found[rel.get("Id")] = (rel.get("Type", "").rsplit("/", 1)[-1], path)
    return found


def _word_paragraph(p) -> str:
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join(n.text or "" if n.tag == _W + "t" else marks.get(n.tag, "") for n in p.iter())


def docx_text(data: bytes) -> str:
    """Body paragraphs first, then every table cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(_W + "body")
    lines = [_word_paragraph(p) for p in body.findall(_W + "p")]
    for table in body.findall(_W + "tbl"):
        for cell in table.findall(f"{_W}tr/{_W}tc"):
            lines.append("\n".join(_word_paragraph(p) for p in cell.findall(_W + "p")))
    return _kept(lines)


def _cell_text(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_S + "t"))
    value = cell.findtext(_S + "v") or ""
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b" and value:
        return "True" if value == "1" else "False"
    return value


def xlsx_text(data: bytes) -> str:
    """Sheet names first, then the stored value of each non-empty cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for item in ET.fromstring(archive.read("xl/sharedStrings.xml")).findall(_S + "si"):
                shared.append("".join(t.text or "" for t in item.iter(_S + "t")))
        sheets = list(ET.fromstring(archive.read("xl/workbook.xml")).iter(_S + "sheet"))
        targets = _targets(archive, "xl/workbook.xml")
        lines = [sheet.get("name") for sheet in sheets]
        for sheet in sheets:
            with archive.open(targets[sheet.get(_R + "id")][1]) as part:
                for _, node in ET.iterparse(part):
                    if node.tag == _S + "c":
                        lines.append(_cell_text(node, shared))
                    elif node.tag == _S + "row":
                        node.clear()
    return _kept(line for line in lines if line != "None")


def _slide_paragraph(p) -> str:
    return "".join(n.text or "" if n.tag == _A + "t" else "\v" if n.tag == _A + "br" else "" for n in p.iter())


def _frames(tree):
    return [b for shape in tree.findall(f"{_P}cSld/{_P}spTree/{_P}sp") for b in shape.findall(_P + "txBody")]


def pptx_text(data: bytes) -> str:
    """Per slide: the paragraphs of its shapes, then its notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        deck = ET.fromstring(archive.read("ppt/presentation.xml"))
        targets = _targets(archive, "ppt/presentation.xml")
        lines = []
        for entry in deck.iter(_P + "sldId"):
            part = targets[entry.get(_R + "id")][1]
            for frame in _frames(ET.fromstring(archive.read(part))):
                lines += [_slide_paragraph(p) for p in frame.findall(_A + "p")]
            for kind, notes in _targets(archive, part).values():
                if kind == "notesSlide":
                    lines.append(_notes(ET.fromstring(archive.read(notes))))
    return _kept(lines)


def _notes(tree) -> str:
    for shape in tree.findall(f"{_P}cSld/{_P}spTree/{_P}sp"):
        mark = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
        if mark is not None and re.fullmatch("body", mark.get("type", "")):
            return "\n".join(_slide_paragraph(p) for p in shape.findall(f"{_P}txBody/{_A}p"))
    return ""
