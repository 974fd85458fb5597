"""Page states of PDF bytes, put together here object by object."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.operators import blocks, pdf


def file(contents, trailer=b"", packed=False, extra=()):
    """A PDF with a page for each content (a stream object's bytes, or None for no content)."""
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(n))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, n)}
    streams = {}
    for i, c in enumerate(contents):
        plain[3 + 2 * i] = b"<< /Type /Page /Parent 2 0 R %s /Resources << /XObject << /Fm0 90 0 R >> >> >>" % (b"/Contents %d 0 R" % (4 + 2 * i) if c is not None else b"")
        if c is not None:
            streams[4 + 2 * i] = c
    streams.update(dict(extra))
    out = b"%PDF-1.5\n"
    if packed:
        places, text = [], b""
        for k, v in plain.items():
            places.append(b"%d %d" % (k, len(text)))
            text += v + b" "
        head = b" ".join(places) + b" "
        streams[80], plain = stream(head + text, b"/Type /ObjStm /N %d /First %d" % (len(places), len(head)), True), {}
    for k, v in {**plain, **streams}.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    return out + b"trailer\n<< /Root 1 0 R %s >>\nstartxref\n0\n%%%%EOF" % trailer


def stream(data, head=b"", flate=False):
    data = zlib.compress(data) if flate else data
    return b"<< %s /Length %d %s >>\nstream\n%s\nendstream" % (head, len(data), b"/Filter /FlateDecode" if flate else b"", data)


def text(shown, **more):
    return stream(b"BT /F1 12 Tf 10 100 Td %s ET" % shown, **more)


OK, BLANK = (1, "SUCCESS", None), (1, "OCR_REQUIRED", "EMPTY_PAGE")


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        (file([text(b"(Some text) Tj")]), [OK]),
        (file([text(b"(Some text) Tj", flate=True)], packed=True), [OK]),
        (file([text(b"[(a) -20 (b)] TJ"), None, text(b"<0041> Tj", flate=True)]), [OK, (2, "OCR_REQUIRED", "EMPTY_PAGE"), (3, "SUCCESS", None)]),
        (file([text(b"(x) '")]), [OK]),
        (file([text(rb"(a \) ( nested ) b) Tj")]), [OK]),
        (file([text(rb"( \n\t ) Tj")]), [BLANK]),
        (file([text(b"<2020> Tj")]), [BLANK]),
        (file([stream(b"q 10 0 0 10 0 0 cm /Im1 Do Q (not shown)")]), [BLANK]),
        (file([stream(b"q /Fm0 Do Q")], extra=[(90, text(b"(inside a form) Tj", head=b"/Subtype /Form"))]), [OK]),
        (file([None, None]), [BLANK, (2, "OCR_REQUIRED", "EMPTY_PAGE")]),
        (file([]), [(1, "EMPTY", "EMPTY_PAGE")]),
        (file([text(b"(x) Tj")], b"/Encrypt 9 0 R"), [(1, "FAILED", "ENCRYPTED_PDF_UNSUPPORTED")]),
        (file([b"<< /Length 3 /Filter /FlateDecode >>\nstream\nbad\nendstream", text(b"(x) Tj")]), [(1, "FAILED", "PARSER_EXCEPTION"), (2, "SUCCESS", None)]),
        (file([b"<< /Length 3 /Filter /LZWDecode >>\nstream\nbad\nendstream"]), [(1, "FAILED", "PARSER_EXCEPTION")]),
        (b"%PDF-1.4\nthis is not a real pdf structure at all\n%%EOF", [(1, "FAILED", "PARSER_EXCEPTION")]),
        (b"", [(1, "FAILED", "PARSER_EXCEPTION")]),
        (None, [(1, "FAILED", "PARSER_EXCEPTION")]),
        (file([text(b"(x) Tj")]).replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]"), [(1, "FAILED", "PARSER_EXCEPTION")]),
        (file([text(b"(stream endobj 7 0 obj endobj) Tj")]), [OK]),
    ],
)
def test_states(data, expected):
    assert pdf.states(data) == expected


@settings(max_examples=200)
@given(st.integers(0, 600), st.binary(max_size=8), st.booleans())
def test_damaged_bytes_never_raise(at, junk, cut):
    whole = file([text(b"(Some text) Tj", flate=True), None], packed=True)
    found = pdf.states(whole[:at] + junk + (b"" if cut else whole[at + len(junk) :]))
    assert found and {s for _, s, _ in found} <= {"SUCCESS", "OCR_REQUIRED", "FAILED", "EMPTY"}


def test_hostile_lengths():
    bomb = zlib.compress(b"(" * (pdf.MOST_UNFOLDED + 1))
    packed = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(bomb), bomb)
    assert pdf.states(file([packed])) == [(1, "FAILED", "PARSER_EXCEPTION")]
    assert pdf.states(file([text(b"(" * 300_000)])) == [BLANK]


def test_documents_of_pages(spark):
    files = [("text", file([text(b"(x) Tj")])), ("scan", file([None])), ("mixed", file([None, text(b"(x) Tj")])), ("locked", file([None], b"/Encrypt 1 0 R")), ("none", None)]
    pages = pdf.page_states(spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in files], "document_id string, content binary"))
    assert pages.count() == 6
    found = blocks.document_status(pages.selectExpr("document_id", "status", "false AS decode_warning"), "document_id")
    assert {r.document_id: r.status for r in found.collect()} == {"text": "EXTRACTION_SUCCESS", "scan": "OCR_REQUIRED", "mixed": "EXTRACTION_PARTIAL", "locked": "EXTRACTION_FAILED", "none": "EXTRACTION_FAILED"}
