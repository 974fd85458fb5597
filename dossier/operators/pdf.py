"""States of the pages of PDF bytes: text that can be taken out, nothing but a picture, encrypted, or beyond reading.

Only what the states need is read: the trailer, the tree of pages, and whether a page's content shows a text. Taking the
text out needs a library with fonts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes that a compressed stream may unfold to.
MOST_UNFOLDED = 200_000_000
SCHEMA = "page_number int, status string, warning string"
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_REF = rb"\s*(\d{1,10})\s+\d{1,5}\s+R\b"
_SHOWN = re.compile(rb"\\.|[()]|<[0-9A-Fa-f\s]*+>|\b(?:Tj|TJ)(?![A-Za-z])|(?<=[)>\s])['\"]", re.S)


class Unreadable(ValueError):
    pass


def _stream(body: bytes) -> bytes:
    """The unfolded content of a stream object."""
    head, mark, rest = body.partition(b"stream")
    if not mark:
        return b""
    rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:] if rest[:1] in b"\r\n" else rest
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
    end = int(length[1]) if length and rest[int(length[1]) :].lstrip()[:9] == b"endstream" else rest.rfind(b"endstream")
    data = rest[: end if end >= 0 else len(rest)]
    filters = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
    names = re.findall(rb"/(\w+)", filters[1]) if filters else []
    for name in names:
        if name not in (b"FlateDecode", b"Fl"):
            raise Unreadable(f"filter {name.decode()}")
        unfold = zlib.decompressobj()
        data = unfold.decompress(data, MOST_UNFOLDED)
        if unfold.unconsumed_tail:
            raise Unreadable("stream too long")
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, also those inside object streams; a later one replaces an earlier."""
    found: dict[int, bytes] = {}
    packed: list[bytes] = []
    at = 0
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        opened = data.find(b"stream", m.end(), end if end >= 0 else len(data))
        if opened >= 0:  # what a stream holds isn't structure
            closed = data.find(b"endstream", opened)
            end = data.find(b"endobj", closed) if closed >= 0 else -1
        at = end if end >= 0 else len(data)
        body = data[m.end() : at]
        found[int(m[1])] = body
        if re.search(rb"/Type\s*/ObjStm\b", body[:1_000]):
            packed.append(body)
    for body in packed:
        first, text = re.search(rb"/First\s+(\d+)", body), _stream(body)
        if not first:
            raise Unreadable("object stream without a start")
        numbers = [int(x) for x in text[: int(first[1])].split()]
        places = [int(first[1]) + x for x in numbers[1::2]]
        for number, start, stop in zip(numbers[::2], places, [*places[1:], len(text)], strict=False):
            found.setdefault(number, text[start:stop])
    return found


def _shows_text(content: bytes) -> bool:
    """Whether a content stream shows a string that isn't blank: one pass, strings nest by their brackets."""
    depth, last, filled = 0, 0, False
    for m in _SHOWN.finditer(content):
        token = m[0]
        if depth:
            filled |= bool(content[last : m.start()].strip())
            if token == b"(":
                depth += 1
                filled |= depth > 1
            elif token == b")":
                depth -= 1
            elif token[:1] == b"\\":
                filled |= token[1:2] not in b"nrtbf\r\n "
            else:
                filled |= True
        elif token == b"(":
            depth = 1
        elif token[:1] == b"<":
            digits = b"".join(token[1:-1].split())
            filled |= bool(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).strip(b" \t\r\n\f\v\0"))
        elif token not in (b")",) and token[:1] != b"\\":
            if filled:
                return True
        last = m.end()
    return False


def _page_shows_text(page: bytes, objects: dict[int, bytes]) -> bool:
    """Whether a page, or a form that it draws, shows a text."""
    listed = re.search(rb"/Contents\s*\[([^\]]*)\]", page)
    one = re.search(rb"/Contents" + _REF, page)
    refs = re.findall(_REF, listed[1]) if listed else [one[1]] if one else []
    held = objects.get(int(refs[0]), b"") if len(refs) == 1 else b""
    if held.lstrip().startswith(b"["):  # the list is an object of its own
        refs = re.findall(_REF, held)
    todo, seen = [(page, b"\n".join(_stream(objects.get(int(r), b"")) for r in refs))], set()
    while todo:
        owner, content = todo.pop()
        if _shows_text(content):
            return True
        held = re.search(rb"/Resources" + _REF, owner)
        names = owner + (objects.get(int(held[1]), b"") if held else b"")
        table = re.search(rb"/XObject" + _REF, names)
        names += objects.get(int(table[1]), b"") if table else b""
        for drawn in set(re.findall(rb"/([^\s/<>\[\]()]+)\s+Do\b", content)):
            ref = re.search(rb"/" + re.escape(drawn) + _REF, names)
            form = objects.get(int(ref[1]), b"") if ref else b""
            if ref and ref[1] not in seen and re.search(rb"/Subtype\s*/Form\b", form):
                seen.add(ref[1])
                todo.append((form.partition(b"stream")[0], _stream(form)))
    return False


def _pages(objects: dict[int, bytes], data: bytes) -> list[bytes]:
    """The leaves of the tree of pages, in order."""
    roots = re.findall(rb"/Root" + _REF, data) or [str(n).encode() for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
    top = re.search(rb"/Pages" + _REF, objects.get(int(roots[-1]), b"")) if roots else None
    if not top:
        raise Unreadable("no tree of pages")
    out, seen, todo = [], set(), [int(top[1])]
    while todo:
        number = todo.pop()
        if number in seen or number not in objects:
            raise Unreadable("broken tree of pages")
        seen.add(number)
        body = objects[number]
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if kids:
            todo += [int(r) for r in reversed(re.findall(_REF, kids[1]))]
        elif re.search(rb"/Type\s*/Page\b", body):
            out.append(body)
        else:
            raise Unreadable("neither page nor pages")
    return out


def states(data: bytes | None) -> list[tuple[int, str, str | None]]:
    """(page number, status, warning) of a file; nothing raises."""
    try:
        if not data or b"%PDF-" not in data[:1_024]:
            raise Unreadable("no PDF")
        objects = _objects(data)
        trailers = [data[m.end() :].partition(b"startxref")[0] for m in re.finditer(rb"\btrailer\b", data)] + [b.partition(b"stream")[0] for b in objects.values() if re.search(rb"/Type\s*/XRef\b", b[:1_000])]
        if any(b"/Encrypt" in t for t in trailers):
            return [(1, "FAILED", "ENCRYPTED_PDF_UNSUPPORTED")]
        pages = _pages(objects, b"\n".join(trailers))
    except (ValueError, zlib.error):
        return [(1, "FAILED", "PARSER_EXCEPTION")]
    out: list[tuple[int, str, str | None]] = []
    for n, page in enumerate(pages, 1):
        try:
            shown = _page_shows_text(page, objects)
            out.append((n, "SUCCESS", None) if shown else (n, "OCR_REQUIRED", "EMPTY_PAGE"))
        except (ValueError, zlib.error):
            out.append((n, "FAILED", "PARSER_EXCEPTION"))
    return out or [(1, "EMPTY", "EMPTY_PAGE")]


def page_states(files: DataFrame, id_col: str = "document_id", content: str = "content") -> DataFrame:
    """(id, page_number, status, warning) of every page of PDF files; a file that can't be read has one failed page.

    SUCCESS shows a text, OCR_REQUIRED none; FAILED is encrypted, malformed, or of a compression other than Flate. blocks.document_status()
    makes one state of a document's pages. Null and empty contents are malformed. Files go one by one in Arrow batches.
    """
    kind = dict(files.dtypes)[id_col]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch[id_col], batch[content], strict=True):
                rows = states(None if data is None else bytes(data))
                yield pd.DataFrame({id_col: [name] * len(rows), **{c.split()[0]: [r[i] for r in rows] for i, c in enumerate(SCHEMA.split(", "))}})

    return files.select(id_col, content).mapInPandas(read, f"{id_col} {kind}, {SCHEMA}")
