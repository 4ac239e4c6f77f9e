"""Image files and logs."""

import base64
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from veridelta.functions import layout
from veridelta.sources import images, logs, records


def png(color: int) -> bytes:
    """A picture of one dot."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(bytes([0, color]))) + part(b"IEND", b"")


def test_images_are_read_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(7))
    (tmp_path / "b.WEBP").write_bytes(png(9))
    (tmp_path / "c").write_bytes(b"x")
    rows = [(1, "in/a.png"), (2, "b.WEBP"), (3, "https://x.org/d.gif"), (4, "aGVsbG8="), (5, None), (6, "in/a.png"), (7, "c")]
    chunks = spark.createDataFrame(rows, "id int, image string").withColumn("name", F.lit("clash"))
    got = {r.id: r for r in images.with_images(chunks, images.image_files(spark, str(tmp_path))).collect()}
    assert len(got) == 7 and got[1].name == "clash"
    assert base64.b64decode(got[1].image) == png(7) == base64.b64decode(got[6].image) and got[1].mime == "image/png"
    assert base64.b64decode(got[2].image) == png(9) and got[2].mime == "image/webp"
    assert (got[7].image, got[7].mime) == ("eA==", "image/jpeg")
    assert [got[k].image for k in (3, 4, 5)] == ["https://x.org/d.gif", "aGVsbG8=", None] and got[4].mime is None
    block = spark.createDataFrame([got[1]]).select(
        F.array(F.struct(F.lit("image").alias("modality"), F.lit("").alias("text"), F.lit("dot").alias("caption"), "image", "mime")).alias("c")
    )
    url = block.select(layout.image_context(F.col("c")).alias("b")).first().b[2].url
    assert url == "data:image/png;base64," + base64.b64encode(png(7)).decode()


def test_an_image_too_large_is_an_error(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(1))
    with pytest.raises(Exception, match="of at most 10"):
        images.image_files(spark, f"file://{tmp_path}", 10).collect()


def test_logs_are_restarted_by_key(spark, tmp_path):
    folder, schema = str(tmp_path / "log"), "iteration int, se double, decision string, query string"
    steps = spark.createDataFrame(
        [(0, 0.123456789, "RETRIEVE", "q1"), (1, 0.5, "STOP", "q1"), (0, 1.0, "STOP", "q2")], schema
    )
    logs.append_log(steps, folder, "query")
    logs.append_log(steps.where("query = 'q2'").withColumn("iteration", F.lit(1)), folder, "query")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "log").glob("query=q2/*.parquet")}
    logs.restart_log(steps.where("iteration = 0 and query = 'q1'"), folder, "query")
    assert [(r.iteration, r.se) for r in logs.history(spark, folder, schema, "query", "q1").collect()] == [(0, 0.123457)]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "log").glob("query=q2/*.parquet")} == files and len(files) == 2
    assert logs.history(spark, folder, schema, "query").count() == 3
    plan = logs.history(spark, folder, schema, "query", "q2")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*query#\d+ = q2", plan)


def test_free_form_tables_of_one_file(spark, tmp_path):
    tables = {
        "a": ('{"headers":["h","k"],"rows":[["x",1.5],[true],[null,2,3]]}', "| h | k |\n| --- | --- |\n| x | 1.5 |\n| True |  |\n| None | 2 |", "h: x; k: 1.5 | h: True | h: None; k: 2; col2: 3"),
        "b": ('[["h","k"],["x",3]]', "| h | k |\n| --- | --- |\n| x | 3 |", "h: x; k: 3"),
        "c": ('"as it is"', "as it is", "as it is"),
        "d": ("[]", "[]", "[]"),
        "e": ('{"rows":[["x","y"]]}', '{"rows":[["x","y"]]}', "col0: x; col1: y"),
        "f": ('{"other":1}', '{"other":1}', ""),
        "g": ('["x","y"]', '["x","y"]', '["x","y"]'),
    }
    lines = [f'{{"id":"{k}","table":{t},"paragraphs":[{{"text":"p"}}],"questions":[{{"question":"q","answer":"z"}}]}}' for k, (t, _, _) in tables.items()]
    lines.append('{"id":"n","paragraphs":[{"text":"p"}],"questions":[]}')
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    schema = "id string, table variant, paragraphs array<struct<text: string>>, questions array<struct<question: string, answer: string>>"
    rows = records.read_json_lines(spark, str(tmp_path), schema)
    questions, chunks = records.table_questions(rows, "id")
    assert questions.count() == len(tables) and chunks.count() == 2 * len(tables) + 1
    forms = [layout.free_layout(layout.free_table(F.col("table")), f).alias(f) for f in ("markdown", "linear", "text")]
    got = {r.entry_id: r for r in chunks.where("modality = 'table'").select("entry_id", *forms).collect()}
    assert {k: (r.markdown, r.linear) for k, r in got.items()} == {k: (m, n) for k, (_, m, n) in tables.items()}
    assert got["b"].text == tables["b"][0] and got["c"].text == "as it is"
    chunk = F.struct("modality", "text", "headers", "rows")
    shown = chunks.where("pos = 0").select("entry_id", layout.table_context(F.array(chunk)).alias("x"))
    assert {r.entry_id: r.x for r in shown.collect()} == {k: f"Context:\n\n[TABLE 1]\n{m}\n" for k, (_, m, _) in tables.items()}
    assert rows.where("id = 'n'").select(forms[0]).first().markdown is None
