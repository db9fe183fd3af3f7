import json
import subprocess
import sys
from pathlib import Path

from siftlake.sources import export
from siftlake.sources.html import Document, decode, html_pages

PAGE = """<html><head><title>Rimo  Award</title><meta name="Description" content="An award"><script>var x = "hidden";</script></head>
<body><nav><a href="/home">Home</a></nav><div class="breadcrumb">You are here</div>
<h1>Rimo Award</h1><p>For pupils of <b>law</b>.</p><table><tr><td>Form</td><td><a href="form.pdf">View</a> for 2026</td></tr></table><footer>Imprint</footer></body></html>"""


def test_document():
    d = Document(PAGE, "https://x.example/a/b")
    assert (d.title, d.description, d.headings) == ("Rimo Award", "An award", ["Rimo Award"])
    assert d.text == "Rimo Award\nFor pupils of law.\nFormView for 2026"
    assert d.links[1] == ("https://x.example/a/form.pdf", "View", "FormView for 2026")
    long = Document("<p>outside</p><main><p>" + "word " * 120 + "</p></main>")
    assert "outside" not in long.text
    assert Document("").text == "" and Document("<p>broken <b>and <i>open").text == "broken and open"


def test_decode():
    assert decode("नमस्ते".encode()) == "नमस्ते" and decode("é".encode("latin-1"), "text/html; charset=latin-1") == "é"
    assert decode(b"\x93hi\x94") == "“hi”" and decode(None) == "" and decode(b"a", "charset=none-such") == "a"


def test_html_pages(spark):
    df = spark.createDataFrame([("https://x.example/", PAGE.encode(), "text/html"), (None, None, None)], "url string, content binary, content_type string")
    got = {r.url: r for r in html_pages(df).collect()}
    assert got["https://x.example/"].headings == ["Rimo Award"] and got[None].text == "" and got[None].links == []


def test_exports(spark, tmp_path):
    r = spark.createDataFrame([(1, "a", 10.0, ["x"]), (2, "b", None, None), (3, "c", 90.0, [])], "id bigint, name string, confidence double, categories array<string>")
    export.to_csv(r, str(tmp_path / "csv"), ["id", "categories", "missing"])
    lines = [x for p in sorted((tmp_path / "csv").glob("*.csv")) for x in p.read_text().splitlines()[1:]]
    assert [x.split(",")[0] for x in lines] == ["3", "1", "2"]
    log = spark.createDataFrame([(7, 1, 2, "name", "FIELD_CHANGED", "x", "a"), (6, 1, 1, "name", "NEW", None, "x")], "change_id bigint, scholarship_id bigint, run_id bigint, field_name string, change_type string, old_value string, new_value string")
    export.to_json(r, log, str(tmp_path / "json"))
    rows = {x["id"]: x for p in (tmp_path / "json").glob("*.json") for x in map(json.loads, p.read_text().splitlines())}
    assert [c["change_id"] for c in rows[1]["changes"]] == [6, 7] and "changes" not in rows[2]
    for _ in range(2):
        export.append(r.repartition(3), str(tmp_path / "log"), "id")
    export.compact(spark, str(tmp_path / "log"), str(tmp_path / "small"), 1)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 6 and len(list((tmp_path / "small").glob("*.parquet"))) == 1


def test_entry_lets_inner_errors_out_and_works_without_the_subpackage():
    root = Path(__file__).parent.parent
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p=None, t=None):\n        if n == {name!r}: raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name=name)], cwd=root, capture_output=True, text=True)
    if (root / "siftlake/llm").is_dir():
        assert run("regex").returncode != 0
    assert int(run("none").stdout) >= 50
