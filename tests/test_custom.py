"""Detectors of others in the engine and in SQL, programs that cannot be read, reviews that fail."""

import json

import pytest

from threatlake import cli
from threatlake.engine import ThreatEngine
from threatlake.operators.custom import ROW, detector, register_detector
from threatlake.operators.review import reviews, verdicts

FILES = [("a.js", "one TODO\nTODO two"), ("b.js", "fine"), ("c.js", "TODO"), ("d.js", "")]


def todos(path, content):
    for k, line in enumerate(content.split("\n")):
        if (at := line.find("TODO")) >= 0:
            yield k + 1, at + 1, "todo", "low", f"open question in {path}"


@pytest.fixture()
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_sql_equals_the_engine(spark, files):
    found = ThreatEngine(("l1",)).register("todos", detector("todos", todos)).scan(files)
    columns = ["path", *(part.split()[0] for part in ROW.split(", "))]
    want = sorted(map(tuple, found.select(*columns).collect()))
    assert want == [("a.js", 1, 5, "todo", "low", "open question in a.js"), ("a.js", 2, 1, "todo", "low", "open question in a.js"), ("c.js", 1, 1, "todo", "low", "open question in c.js")]
    assert {r.detector for r in found.collect()} == {"todos"}
    register_detector(spark, "find_todos", todos)
    files.union(spark.createDataFrame([("null.js", None)], files.schema)).createOrReplaceTempView("todo_files")
    rows = spark.sql("SELECT f.path, d.* FROM todo_files f, LATERAL find_todos(f.path, f.content) d")
    assert sorted(map(tuple, rows.select(*columns).collect())) == want
    counts = spark.sql("SELECT f.path, count(d.line) AS n FROM todo_files f, LATERAL find_todos(f.path, f.content) d GROUP BY f.path")
    assert {r.path: r.n for r in counts.collect()} == {"a.js": 2, "c.js": 1}


def test_a_failing_detector_names_the_file(files):
    def broken(path, content):
        if path == "b.js":
            raise ValueError("no")
        return []

    with pytest.raises(Exception, match="detector failed on b.js"):
        detector("broken", broken)(files).collect()


def test_programs_that_cannot_be_read_are_told(spark, tmp_path, capsys):
    engine = ThreatEngine.default()
    rows = spark.createDataFrame([("a.js", "if ("), ("b.js", "f(1)"), ("c.py", "if (")], "path string, content string")
    engine.scan(rows)
    assert [r.path for r in engine.unread.collect()] == ["a.js"]
    engine.release()
    (tmp_path / "x.js").write_text("if (")
    cli.main([str(tmp_path), "-f", "json"])
    assert "1 programs could not be read" in capsys.readouterr().err


def test_failed_reviews_have_reasons(spark):
    files = spark.createDataFrame([(f"{k}.js", f"x​ {k}") for k in ("good", "down", "odd")], "path string, content string")
    found = ThreatEngine.default(("l1",)).scan(files)

    def model(prompt):
        if "x​ down" in prompt:
            raise OSError("no route")
        content = "maybe" if "x​ odd" in prompt else '{"is_malicious": false, "confidence": 0.5, "reasoning": "r"}'
        return json.dumps({"choices": [{"message": {"content": content}}]})

    rows = {r.path: r for r in reviews(files, found, model).collect()}
    assert rows["good.js"].verdict.confidence == 0.5 and rows["good.js"].reason is None
    assert (rows["down.js"].verdict, rows["down.js"].reason) == (None, "OSError: no route")
    assert rows["odd.js"].reason == "the answer holds no verdict"
    assert [r.path for r in verdicts(files, found, model).collect()] == ["good.js"]
