import pytest
from pyspark.sql import functions as F

from lakewright.sources import files, sinks
from lakewright.streaming import events


def test_delimited_rows_are_padded(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount\nalpha,010\nbeta\n")
    got = [tuple(r) for r in files.delimited(spark, str(tmp_path / "a.csv"), ["name", "amount"]).collect()]
    assert got == [("alpha", "010"), ("beta", None)]
    with pytest.raises(ValueError):
        files.check_headers(["a", "a"])


def test_json_line_policies(spark, tmp_path):
    torn = tmp_path / "torn.jsonl"
    torn.write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    inner = tmp_path / "inner.jsonl"
    inner.write_text('{"a": 1}\nx\n{"a": 2}\n')
    read = lambda p, how: sorted(r.a for r in files.json_lines(spark, str(p), "a long", how).collect())
    assert read(torn, "skip") == read(inner, "skip") == read(torn, "tail") == [1, 2]
    for p, how in ((torn, "fail"), (inner, "tail"), (inner, "fail")):
        with pytest.raises(Exception, match="malformed"):
            read(p, how)


def test_notes_and_tables(spark, tmp_path):
    (tmp_path / "n.md").write_text('---\ntitle: "A note"\ntags: [x, "y z"]\n---\n# H\n| a | b |\n|---|---|\n| 1 | 2 |\n')
    (tmp_path / "m.md").write_text("no front matter")
    n = {r.path.rsplit("/", 1)[1]: r for r in files.notes(spark, str(tmp_path)).withColumn("tags", files.flow_list(F.col("metadata")["tags"])).withColumn("t", files.pipe_table(F.col("body"))).collect()}
    assert n["n.md"].metadata["title"] == "A note" and n["n.md"].tags == ["x", "y z"] and n["n.md"].t == [["a", "b"], ["1", "2"]]
    assert n["m.md"].metadata == {} and n["m.md"].body == "no front matter"
    inv = {r.name: (r.extension, r.category) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert inv == {"n.md": ("md", "document"), "m.md": ("md", "document")}


def test_citations(spark, tmp_path):
    (tmp_path / "r.ris").write_text("TY  - JOUR\nTI  - A title\n  goes on\nAU  - B, C\nAU  - D, E\nER  - \nTY  - BOOK\nTI  - Two\n")
    got = [r.tags for r in files.citations(spark, str(tmp_path / "r.ris")).orderBy("at").collect()]
    assert got == [{"TY": ["JOUR"], "TI": ["A title goes on"], "AU": ["B, C", "D, E"]}, {"TY": ["BOOK"], "TI": ["Two"]}]
    with pytest.raises(NotImplementedError):
        files.bibtex(spark, "x")
    back = spark.range(1).select(sinks.ris_record(F.lit("JOUR"), F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit(2020), F.lit(None).cast("string"), F.array(F.lit("k"))).alias("x")).first()[0]
    assert back.split("\n") == ["TY  - JOUR", "TI  - T", "AU  - A", "AU  - B", "PY  - 2020", "KW  - k", "ER  - "]


def test_transcripts(spark):
    text = "**Ann**\n*00:05*\nHello there.\n\n**Bob**\n*1:00:01*\nBye.\nNow.\n"
    got = spark.createDataFrame([(text,)], "t string").select(files.transcript(F.col("t")).alias("x")).first()[0]
    assert [(b.speaker, b.seconds, b.text) for b in got] == [("Ann", 5, "Hello there."), ("Bob", 3601, "Bye.\nNow.")]
    reply = spark.createDataFrame([('{"segments": [{"start": 0, "end": 1.5, "text": " a "}, {"start": 2, "end": 3, "text": " "}], "text": "a"}',), ('{"segments": [], "text": "b"}',)], "r string")
    assert sorted((r.start, r.end, r.text) for r in files.segments(reply, "r").collect()) == [(0.0, 0.0, "b"), (0.0, 1.5, " a ")]
    assert spark.range(1).select(sinks.srt_block(F.lit(1), F.lit(0.0), F.lit(3661.5), F.lit("x"))).first()[0] == "1\n00:00:00,000 --> 01:01:01,500\nx\n"


def test_flat_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "id long, xs array<string>, n string")
    assert tuple(sinks.flat(df, ["n", "xs", "id"]).first()) == ("", "a;b", "1")
    sinks.write_csv(df, str(tmp_path / "out"), ["id", "xs"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().xs == "a;b"
    (tmp_path / "f.txt").write_text("abc")
    m = sinks.manifest(spark, str(tmp_path / "f.txt")).first()
    assert m.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and m.bytes == 3


def test_session_log(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type": "session", "id": "1", "timestamp": "2024-01-01T00:00:00Z"}\nbroken\n{"type": "message", "id": "2", "parentId": "1", "role": "user"}\n')
    got = files.session_log(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.type, r.parentId) for r in got] == [("session", None), ("message", "1")] and got[0]["at"] is not None


def test_attempts_stream(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "cp")
    for k, rows in enumerate([[("a", False), ("b", True), ("c", False)], [("a", False), ("b", False)], [("a", False), ("a", True)]]):
        spark.createDataFrame(rows, "id string, ok boolean").coalesce(1).write.mode("append").parquet(path)
    s = events.stream_table(spark, path, per_trigger=10)
    out = events.run_to_end(events.attempts(s, "id", "ok"), "t_attempts", "update", check)
    got = {r.id: (r.tries, r.state) for r in out.collect()}
    assert got["b"][1] in ("done", "pending") and got["c"] == (1, "pending") and got["a"][0] >= 1


def test_windowed_stream(spark, sf_dir):
    s = events.stream_table(spark, f"{sf_dir}/events.parquet")
    out = events.run_to_end(events.session_counts(s, "ts", "user_id"), "t_sessions", "append")
    assert out.count() >= 0
