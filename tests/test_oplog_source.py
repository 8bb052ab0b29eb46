from pathlib import Path

from engramlake.streaming.oplog_source import OplogReader, OplogSource


def append(root, device, text):
    p = Path(root) / device / "oplog-2026-01-01-001.jsonl"
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("a") as f:
        f.write(text)


def test_growing_files_torn_tail_and_restarts(spark, tmp_path):
    spark.dataSource.register(OplogSource)
    root, out = f"{tmp_path}/log", f"{tmp_path}/out"

    def run():
        # a query of its own each time, from the checkpoint, with stretches far below the files' size
        spark.readStream.format("oplog").option("maxBytesPerTask", 7).load(root).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{tmp_path}/cp"
        ).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    long = [f"line {i} " + "x" * 30 for i in range(20)]
    append(root, "d1", "a\nb\n" + "\n".join(long) + "\nto")
    append(root, "d2", "x\n")
    assert run() == sorted(["a", "b", "x", *long])
    append(root, "d1", "rn\nc\n")
    assert run() == sorted(["a", "b", "c", "torn", "x", *long])
    assert run() == sorted(["a", "b", "c", "torn", "x", *long])


def test_each_line_is_read_once_however_a_file_is_cut(tmp_path):
    text = "one\n\nthree\nfour and more\nlast"
    append(tmp_path, "d", text)
    for size in range(1, 40):
        r = OplogReader({"path": str(tmp_path), "maxBytesPerTask": str(size)})
        got = [line for part in r.partitions(r.initialOffset(), r.latestOffset()) for _, _, _, line in r.read(part)]
        assert got == ["one", "", "three", "four and more"], size
