import io
import zipfile
import zlib

import pytest

from brackenfold import schemas as s
from brackenfold.sources import extract
from brackenfold.sources import wal_segments as w


def test_encodings():
    assert extract.decode(b"") == "" and extract.decode("é".encode()) == "é"
    assert extract.decode("привет мир, как дела сегодня".encode("utf-16")) == "привет мир, как дела сегодня"
    assert extract.decode("これは日本語の文章です。".encode("shift_jis")) == "これは日本語の文章です。"
    with pytest.raises(extract.UnsupportedFormat):
        extract.text_of("x.bin", b"\xff\xfe\xfa\x00")
    assert extract.text_of("x.bin", b"plain") == "plain"


def test_office_and_pdf():
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>4.5</v></c></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert extract.office(sheet.getvalue(), "xlsx") == "name\t4.5\nab\tin"
    slides = io.BytesIO()
    with zipfile.ZipFile(slides, "w") as z:
        for i in (10, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p></p:sld>')
    assert extract.office(slides.getvalue(), "pptx") == "slide 2\n\nslide 10"
    body = zlib.compress(rb"BT (Hello \(PDF\)) Tj T* [(Wor) -20 (ld)] TJ ET")
    file = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj"
    assert extract.pdf(file) == "Hello (PDF)\nWorld"
    with pytest.raises(ValueError):
        extract.pdf(b"no")


def test_record_codec():
    r = w.encode(7, 99, "U", 3, [1.5, -2.0], b"meta")
    assert w.decode(r) == ((7, 99, "U", 3, [1.5, -2.0], b"meta"), len(r))
    assert w.decode(w.encode(1, 2, "D", 4, None, None))[0] == (1, 2, "D", 4, [], b"")
    for bad, error in ((r[:-1] + b"\0", s.Corruption), (r[:36] + b"\1" + r[37:], s.Corruption), (r[:16] + b"\x09" + r[17:], s.Corruption), (r[:20], EOFError), (r[:-2], EOFError)):
        with pytest.raises(error):
            w.decode(bad)
    head = w.encode_header(5, 1, 2, 3)
    assert w.decode_header(head, 5) == {"magic": 5, "checkpoint_lsn": 1, "current_lsn": 2, "generation": 3}
    for bad in (head[:-1], b"\1" + head[1:]):
        with pytest.raises(s.Corruption):
            w.decode_header(bad)
    with pytest.raises(s.Corruption):
        w.decode_header(head, 6)


def test_segments(spark, tmp_path):
    head = w.encode_header(5, 0, 0, 0)
    good = [w.encode(i, 0, "I", i, [float(i)], b"") for i in (1, 2, 3)]
    (tmp_path / "db.wal.1").write_bytes(head + b"".join(good))
    (tmp_path / "db.wal").write_bytes(head + w.encode(4, 0, "C", 0, None, None) + w.encode(5, 0, "D", 1, None, None) + w.encode(5, 0, "D", 2, None, None) + b"torn")
    log = w.read_segments(spark, [str(tmp_path)])
    assert sorted(r["lsn"] for r in log.collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["lsn"] for r in w.for_recovery(log, 3).collect()) == [3, 5]
