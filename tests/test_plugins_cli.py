import json

from pyspark.sql import functions as F

from pagelattice.__main__ import main
from pagelattice.operators.plugins import with_embeddings, with_summaries
from pagelattice.sources import writers


def test_summaries_and_embeddings(spark):
    tabs = spark.createDataFrame([(0, "good", "One. Two. Three. Four."), (1, "bad", "Only this."), (2, None, None)], "id long, title string, body string")

    def make():
        def summarize(prompt):
            if "Title: bad" in prompt:
                raise RuntimeError("busy")
            return " short " if "good" in prompt else ""

        return summarize

    got = {r.id: (r.summary, r.summary_source, r.error) for r in with_summaries(tabs, make).collect()}
    assert got == {0: ("short", "llm", None), 1: ("Only this.", "fallback", "summary_failed: busy"), 2: ("", "fallback", None)}
    assert {r.summary_source for r in with_summaries(tabs, None).collect()} == {"fallback"}
    rows = spark.createDataFrame([(0, "t", [9.0]), (1, "t", None), (2, "", None)], "id long, title string, embedding array<double>").withColumns({c: F.lit("") for c in ("summary", "domain", "text_excerpt")})
    out = {r.id: (r.embedding, r.embedding_error) for r in with_embeddings(rows, lambda: lambda texts: [[1.0, 2.0] for _ in texts]).collect()}
    assert out == {0: ([9.0], None), 1: ([1.0, 2.0], None), 2: (None, None)}

    def broken():
        def embed(texts):
            raise OSError("down")

        return embed

    assert {r.id: r.embedding_error for r in with_embeddings(rows, broken).collect()}[1] == "down"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.read_current(spark, path) is None
    writers.write_version(spark.range(3), path)
    writers.write_version(writers.read_current(spark, path).where("id > 0"), path)
    assert sorted(r.id for r in writers.read_current(spark, path).collect()) == [1, 2]
    writers.truncate(spark, path)
    assert writers.read_current(spark, path).count() == 0


def test_command_line(spark, tmp_path, capsys):
    windows = [{"browser": "chrome", "windowId": 1, "tabs": [{"title": "Apache Spark engine", "url": "https://a.com/1"}, {"title": "Spark engine guide", "url": "https://b.com/2"}, {"title": None, "url": " "}]}]
    (tmp_path / "tabs_backup.json").write_text(json.dumps(windows))
    main(["build", str(tmp_path), "--out", str(tmp_path / "g.json"), "--tables", str(tmp_path / "tables")])
    doc = json.loads((tmp_path / "g.json").read_text())
    assert doc["stats"]["tab_count"] == 2 and len(doc["groups"]) == 1
    assert writers.read_current(spark, str(tmp_path / "tables" / "tabs")).count() == 2
    main(["explore", str(tmp_path / "g.json"), "spark"])
    assert "score:1.00" in capsys.readouterr().out
