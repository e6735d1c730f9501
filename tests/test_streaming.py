from veilspan import scan
from veilspan.sources.files import stream_documents
from veilspan.streaming.redaction import start, stream_findings, stream_redacted


def test_files_are_redacted_as_they_arrive(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()
    (src / "a.txt").write_text("mail someone@example.com\r\nJohn Doe")
    (src / "skip.png").write_bytes(b"x")

    def round_trip():
        redacted = stream_redacted(stream_documents(spark, str(src)), names=["John Doe"])
        start(redacted, str(out), str(mark)).awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(str(out)).collect())

    assert round_trip() == ["mail **********ample.com\n[REDACTED]"]
    (src / "b.md").write_text("ssn 123-45-6789")
    assert round_trip() == ["mail **********ample.com\n[REDACTED]", "ssn *******6789"]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "t"))
    query = (
        stream_findings(stream, "doc_id")
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "o"))
    )
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "o"))
    batch = scan(table, "doc_id").findings
    assert streamed.count() == batch.count() > 0
    assert streamed.select(batch.columns).exceptAll(batch).count() == 0
