import base64
import hashlib
import hmac
import io
import json
import zipfile

import pytest

from corvane.plans.asking import Pipeline, authorized, verified_subject
from corvane.plans.indexing import Indexer, single_writer
from corvane.sources import extract, inventory, settings


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="urn:w" xmlns:a="urn:a" xmlns:p="urn:p" xmlns:r="urn:r"'
REL = '<Relationships xmlns="x">{}</Relationships>'


def test_plain_html_and_json():
    assert extract.extract("é\r\nb".encode(), ".txt")[0] == "é\nb"
    assert extract.extract("привет".encode("cp1251") + b"!", ".txt")[0] == "привет!"
    text, _, _, _, error = extract.extract(b"<p>one<script>bad</script>tail<br>two &amp; three<style>x</style>", ".html")
    assert text == "one\ntail\ntwo & three" and error is None
    assert extract.extract('{"a":"é"}'.encode(), ".json")[0] == '{\n  "a": "é"\n}'
    assert extract.extract(b"{", ".json")[4] == "extract_failed" and extract.extract(b" \n", ".txt")[4] == "empty_text" and extract.extract(b"x", ".exe")[4] == "unsupported_extension"
    text, _, truncated, _, _ = extract.extract(b"abcdef", ".txt", extract.Limits(chars=3))
    assert (text, truncated) == ("abc", True)


def test_office_files():
    doc = f'<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    text, pages, _, where, error = extract.extract(archive({"word/document.xml": doc, "docProps/app.xml": "<P><Pages>2</Pages></P>"}), ".docx")
    assert (text, pages, error) == ("First\n\na\tb", 2, None) and [x[:2] for x in where] == [(0, 5), (5, 10)]
    book = {
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Type="t/worksheet" Target="worksheets/s1.xml"/>'),
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>1.5</v></c><c t="b"><v>1</v></c><c s="1"><v>45292</v></c><c/></row><row><c><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    }
    text, _, _, where, _ = extract.extract(archive(book), ".xlsx")
    assert text == "[SHEET] One\nname\t1.5\tTRUE\t2024-01-01\n2" and where == [(0, len(text), "sheet", "One")]
    deck = {
        "ppt/presentation.xml": f'<p:x {W}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:x>', "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Type="t/slide" Target="slides/s1.xml"/>'),
        "ppt/slides/s1.xml": f'<p:x {W}><p:sp><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp><a:tbl><a:tr><a:tc><a:txBody><a:p><a:t>x</a:t></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:t>y</a:t></a:p></a:txBody></a:tc></a:tr></a:tbl></p:x>',
        "ppt/slides/_rels/s1.xml.rels": REL.format('<Relationship Id="r2" Type="t/notesSlide" Target="../notesSlides/n1.xml"/>'),
        "ppt/notesSlides/n1.xml": f'<p:x {W}><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><p:txBody><a:p><a:t>say so</a:t></a:p></p:txBody></p:sp></p:x>',
    }
    assert extract.extract(archive(deck), ".pptx")[0] == "[SLIDE 1]\nTitle\nx\ty\n[NOTES]\nsay so"


def test_bad_archives():
    assert extract.extract(b"no zip", ".docx")[4] == "office_archive_invalid"
    assert extract.extract(archive({"word/document.xml": "a" * 1_000_000}), ".docx")[4] == "office_archive_suspicious_ratio"
    assert extract.extract(archive({"../x": "a"}), ".docx")[4] == "office_archive_unsafe_name"
    assert extract.extract(archive({"x": "a"}), ".xlsx")[4] == "extract_failed"


def test_paths(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    assert inventory.inside(str(tmp_path), "a\\x.txt").name == "x.txt"
    for bad in ("", "/etc/passwd", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            inventory.inside(str(tmp_path), bad)
    assert inventory.attachment(str(tmp_path), ' "a/x.txt" ').name == "x.txt"
    with pytest.raises(ValueError, match="outside"):
        inventory.attachment(str(tmp_path), "/etc/passwd")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.yaml").write_text("top_k: 5\n")
    held = settings.load(str(tmp_path / "s.yaml"), {"CORVANE_CHUNK_CHARS": "300"})
    assert (held.top_k, held.chunk_chars) == (5, 300)
    with pytest.raises(ValueError, match="top_k"):
        settings.load(None, {"CORVANE_TOP_K": "101"})
    (tmp_path / ".env").write_text("# c\nA_NEW=1\nHOME=2\n")
    monkeypatch.setenv("HOME", "x")
    monkeypatch.delenv("A_NEW", raising=False)
    assert settings.load_environment(str(tmp_path / ".env")) == {"A_NEW": "1"}
    (tmp_path / ".env").write_text("bad line")
    with pytest.raises(ValueError, match="invalid_dotenv_line"):
        settings.load_environment(str(tmp_path / ".env"))
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.md").write_text("rule")
    assert settings.instructions(str(tmp_path / "i"), ["a.md"], [str(tmp_path / "p")], 10) == "rule"
    with pytest.raises(ValueError, match="overlap"):
        settings.instructions(str(tmp_path / "i"), ["a.md"], [str(tmp_path)], 10)


def test_identity():
    def token(claims, key="k"):
        part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
        body = f"{part({'alg': 'HS256'})}.{part(claims)}"
        return body + "." + base64.urlsafe_b64encode(hmac.new(key.encode(), body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    good = {"sub": "u1", "iss": "w", "iat": 100, "exp": 200}
    assert verified_subject(token(good), "k", "w", 150) == "u1"
    for bad in (token(good, "other"), token(good | {"iss": "x"}), token(good | {"exp": 90}), token(good | {"sub": "a b"}), "x.y", token(good | {"iat": 500, "exp": 600})):
        with pytest.raises(PermissionError):
            verified_subject(bad, "k", "w", 150)
    assert [authorized(None, None), authorized("Bearer x", "y"), authorized("Bearer y", "y")] == [503, 401, 200]


def test_index_and_ask(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "whdata").mkdir()
    (root / "whdata" / "no.txt").write_text("never listed")
    (root / "harbour lamp.txt").write_text("The harbour lamp needs new oil. Write to ivo@mail.test about the lamp. " * 20)
    (root / "sub" / "b+c.md").write_text("A windmill turns slowly. " * 30)
    (root / "bad.json").write_text("{")
    held = settings.Settings(source_root=str(root), state_root=str(tmp_path / "state"), max_source_documents=1)
    indexer = Indexer(spark, held)
    report = indexer.run()
    assert (report["indexed"], report["failed"], report["skipped"], report["status"]) == (2, 1, 0, "complete_with_errors")
    again = indexer.run()
    assert (again["indexed"], again["failed"], again["skipped"], again["chunks"]) == (0, 1, 2, 0)
    (root / "sub" / "b+c.md").unlink()
    (root / "bad.json").write_text('{"a": 1}')
    third = indexer.run(prune_missing=True)
    assert (third["indexed"], third["skipped"]) == (1, 1)
    assert {r["relative_path"]: r["status"] for r in indexer.manifest.read().collect()} == {"harbour lamp.txt": "indexed", "bad.json": "indexed", "sub/b+c.md": "deleted"}
    with single_writer(spark, held.state_root), pytest.raises(RuntimeError, match="already_running"):
        indexer.run()
    seen = []

    def provider(payload):
        seen.append(payload)
        assert "ivo@" not in json.dumps(payload)
        if len(seen) == 1:
            return '<retrieval_request>{"queries": ["harbour lamp oil"], "expand_citations": ["R001"]}</retrieval_request>'
        return "Ask [[EMAIL_0001]]."

    result = Pipeline(spark, held).run("Who knows the harbour lamp?", provider)
    assert result["answer"] == "Ask ivo@mail.test." and len(seen) == 2
    assert result["sources"][0]["path"] == "harbour lamp.txt" and "harbour lamp.txt" not in json.dumps(seen)
    assert Pipeline(spark, held).run("??!", None)["answer"] is None
