import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.sources import docx, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_bytes():
    body = (
        "<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>paragraph</w:t></w:r></w:p><w:p/>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>"
        "<w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
        "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>"
    )
    core = (
        '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'
        "<dc:title>T</dc:title><dc:creator>Me</dc:creator><dc:subject></dc:subject><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", core)
    return out.getvalue()


def test_docx():
    text, properties = docx.read(docx_bytes())
    assert text == "First paragraph\na\tb\n\t\nx\ty\nz"
    assert properties == {"title": "T", "author": "Me", "created": "2024-01-02T03:04:05+00:00"}


@pytest.fixture
def folder(tmp_path):
    contents = {
        "a.txt": b"\xef\xbb\xbfHello\r\nworld", "b.MD": b"# T\n", "c.docx": docx_bytes(), "d.docx": b"no zip", "e.pdf": b"%PDF", "f.txt": b"", "g.txt": b" \n", "h.txt": b"\xff\xfe\x00", "i.exe": b"x", ".txt": b"x",
        "sub/two.txt": b"\xef\xbb\xbf\xef\xbb\xbfx",
    }
    for name, content in contents.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    return f"file://{tmp_path}"


def test_parse(spark, folder):
    rows = {r.filename: r for r in files.parse(spark, folder, pdf=lambda content: ("page one\npage two", 2, {"title": "P"})).collect()}
    assert rows["a.txt"].extracted_text == "Hello\r\nworld" and rows["a.txt"].word_count == 2 and rows["a.txt"].metadata == {}
    assert rows["b.MD"].file_type == "md" and rows["two.txt"].extracted_text == "\ufeffx"
    assert rows["c.docx"].metadata["title"] == "T" and rows["c.docx"].page_count is None and rows["c.docx"].error is None
    assert (rows["e.pdf"].page_count, rows["e.pdf"].extracted_text) == (2, "page one\npage two")
    codes = {name: r.error.code for name, r in rows.items() if r.error}
    assert codes == {"d.docx": "docx_parsing", "f.txt": "empty_document", "g.txt": "empty_document", "h.txt": "text_decoding", "i.exe": "unsupported_file_type"}


def test_strict_parse_raises(spark, folder):
    with pytest.raises(Exception, match="pdf_parsing|docx_parsing|text_decoding|empty_document|unsupported"):
        files.parse(spark, folder, strict=True).collect()


def test_ingest_reads_no_content(spark, folder):
    df = files.ingest(spark, folder, most=5)
    assert "content#" not in df._jdf.queryExecution().executedPlan().toString()
    codes = {r.filename: r.error and r.error.code for r in df.collect()}
    assert codes["b.MD"] is None and codes["a.txt"] == "upload_too_large" and codes["i.exe"] == "unsupported_type"


def test_an_empty_batch_is_an_error(spark, tmp_path):
    rows = files.ingest(spark, f"file://{tmp_path}").collect()
    assert [(r.path, r.error.code) for r in rows] == [(None, "upload_validation")]


def test_names(spark):
    names = ["C:\\dir\\x.PDF", "a/b.txt", "..", ".", ".pdf", "", "a.tar.gz", "dir/", "..md", "a.", "n\0.txt", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, filename string")
    found = rows.select("i", files.safe_name(F.col("filename")).alias("safe"), files.suffix(files.safe_name(F.col("filename"))).alias("suffix"), files.name_error(F.col("filename")).alias("e")).orderBy("i").collect()
    assert [r.safe for r in found] == ["x.PDF", "b.txt", "..", ".", ".pdf", "", "a.tar.gz", "dir", "..md", "a.", "n\0.txt", None]
    assert [r.suffix for r in found][:8] == [".pdf", ".txt", "", "", "", "", ".gz", ""]
    assert [r.e and r.e.code for r in found] == [None, None, "upload_validation", "upload_validation", "unsupported_type", "upload_validation", "unsupported_type", "unsupported_type", "unsupported_type", "unsupported_type", "upload_validation", "upload_validation"]


def test_batches_are_accepted_as_a_whole(spark):
    rows = spark.createDataFrame([("u", 1, "a.txt", 10), ("u", 2, "b.exe", 10), ("v", 1, "c.md", 10)], "upload_id string, file_no int, filename string, file_size bigint")
    found = {(r.upload_id, r.file_no): r.accepted for r in files.check_uploads(rows, ["upload_id"]).collect()}
    assert found == {("u", 1): False, ("u", 2): False, ("v", 1): True}
    many = spark.range(1001).select(F.lit("u").alias("upload_id"), F.col("id").alias("n"), F.concat(F.lit("f"), "id", F.lit(".txt")).alias("filename"))
    stored = {r.n: r.stored_name for r in files.stored_names(many, ["upload_id"], ["n"], "filename").collect()}
    assert stored[0] == "001_f0.txt" and stored[1000] == "1001_f1000.txt"
