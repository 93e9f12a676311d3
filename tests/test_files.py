import io
import json
import zipfile

from pyspark.sql import functions as F

from docstrata.operators.sequential import first_json_object, layout_levels, select_disjoint_groups
from docstrata.sources.files import docx_definitions, docx_records, markdown_lines, media_preservation, non_text_objects, read_responses, unread_files, write_json_lines
from docstrata.streaming.responses import response_stream

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_markdown_lines_keep_order(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nx")
    rows = markdown_lines(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in rows] == [(0, "# T"), (1, ""), (2, "x")]


def test_word_files(spark, tmp_path):
    held = io.BytesIO()
    numbering = '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="4"/></w:lvlOverride></w:num>'
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body><w:p><w:r><w:t>A</w:t><w:drawing/></w:r></w:p></w:body></w:document>')
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{numbering}</w:numbering>")
        z.writestr("word/media/a.png", b"x")
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert [tuple(r)[1:] for r in docx_definitions(spark, str(tmp_path)).collect()] == [(7, 0, "decimal", "%1)", "", 4)]
    objects = non_text_objects(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in objects.collect()] == [(1, 1, 0)]
    assert [r.path.rsplit("/", 1)[-1] for r in unread_files(spark, str(tmp_path)).collect()] == ["b.docx"]
    assert [r.ratio for r in media_preservation(objects, objects).collect()] == [1.0]
    assert [r.ratio for r in media_preservation(objects, objects.limit(0)).collect()] == [0.0]
    assert [r.t for r in docx_records(spark, str(tmp_path)).collect()] == ["A"]


def test_responses_round_trip_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", "r1", "{}", "h"), ("1", "r1", "{}", "h"), ("1", "r2", None, "h")], "protocol_version string, request_id string, raw_response string, input_hash string")
    write_json_lines(rows, str(tmp_path / "out"))
    assert read_responses(spark, str(tmp_path / "out")).count() == 3
    held = {}

    def keep(batch, _):
        held.update({r.request_id: r.raw_response for r in batch.collect()})

    query = response_stream(spark, str(tmp_path / "out")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    assert held == {"r1": "{}", "r2": None}
    later = spark.createDataFrame([("1", "r1", "{\"a\": 1}", "h")], rows.schema)
    later.write.mode("append").json(str(tmp_path / "out"))
    query.processAllAvailable()
    query.stop()
    assert held == {"r1": "{\"a\": 1}", "r2": None}


def test_first_json_object(spark):
    texts = ['ok {"a":1} z', 'x {"a":"}"} {', "none", None, "{bad}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in rows.select("i", first_json_object(F.col("t")).alias("j")).orderBy("i").collect()]
    assert got[:2] == ['{"a":1}', '{"a":"}"}'] and got[2:] == [None, None, None]
    assert json.loads(got[0]) == {"a": 1}


def test_layout_levels(spark):
    rows = spark.createDataFrame([(1, 0, x) for x in (0, 100, 120, 240)], "doc_id long, run int, left_twips int")
    assert {r.left_twips: r.level for r in layout_levels(rows).collect()} == {0: 0, 120: 1, 240: 2}


def test_greedy_groups_are_disjoint(spark):
    rows = spark.createDataFrame([(1, 0, 1, 4, 3, 0.9), (1, 0, 3, 7, 4, 0.95), (1, 0, 7, 10, 3, 0.7)], "doc_id long, run long, start_i long, end_i long, size long, confidence double")
    assert [(r.start_i, r.end_i) for r in select_disjoint_groups(rows).orderBy("start_i").collect()] == [(3, 7), (7, 10)]
