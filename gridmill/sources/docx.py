"""Word documents read from their zip and XML, without other libraries."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _paragraph(p) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag in _BREAKS:
            out.append(_BREAKS[e.tag])
    return "".join(out)


def _cell(tc) -> str:
    return "\n".join(_paragraph(p) for p in tc.findall(f"{_W}p")).strip()


def _property(tc, name: str):
    properties = tc.find(f"{_W}tcPr")
    return None if properties is None else properties.find(f"{_W}{name}")


def _table(tbl) -> tuple[list[list[str]], bool]:
    """Rows of cell texts and whether a row repeats a cell that spans columns."""
    rows, merged = [], False
    above: list[str] = []
    for tr in tbl.findall(f"{_W}tr"):
        cells: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            span = _property(tc, "gridSpan")
            width = int(span.get(f"{_W}val", "1")) if span is not None else 1
            down = _property(tc, "vMerge")
            carried = down is not None and down.get(f"{_W}val", "continue") == "continue"
            text = above[len(cells)] if carried and len(cells) < len(above) else _cell(tc)
            merged |= width > 1
            cells += [text] * width
        rows.append(cells)
        above = cells
    return rows, merged


def read(content: bytes) -> dict:
    """``{"paragraphs": [text], "tables": [(rows, has_merged_cells)]}`` of the body; texts are stripped, blank paragraphs keep their place."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        raise ValueError("the document has no body")
    return {"paragraphs": [_paragraph(p).strip() for p in body.findall(f"{_W}p")], "tables": [_table(t) for t in body.findall(f"{_W}tbl")]}
