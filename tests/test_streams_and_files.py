import datetime as dt
import hashlib
import uuid

from lensgraph.sources import files
from lensgraph.streaming import watch


def test_scan_prunes_and_skips(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src/A.java").write_bytes(b"class A\r\n{}")
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "src/big.xml").write_text("x" * 100)
    (tmp_path / "target/C.java").write_text("class C")
    got = {r.file_path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path), most=50).collect()}
    assert set(got) == {"A.java", "big.xml"}
    assert got["A.java"].content_hash == hashlib.sha256(b"class A\r\n{}").hexdigest()
    assert got["big.xml"].skipped and got["big.xml"].text is None


def test_graph_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(1, "a", [1.0])], "id long, name string, embedding array<double>")
    e = spark.createDataFrame([(1, 1, "CALLS")], "src long, dst long, rel_type string")
    files.write_graph(n, e, str(tmp_path))
    nodes, edges = files.read_graph(spark, str(tmp_path))
    assert nodes.columns == ["id", "name"] and edges.filter("rel_type = 'CALLS'").count() == 1


def test_enriched(spark):
    def client():
        return lambda rows: [{"id": r["id"], "n": len(r["text"])} for r in rows]

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    assert dict(files.enriched(df, client, ["id", "text"], "id long, n long").collect()) == {1: 2, 2: 3}


def test_watcher_sees_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/OrderService.java").write_text("x")
    got = watch.drained(watch.watch(spark, str(tmp_path / "in")), f"w{uuid.uuid4().hex}").collect()
    assert [(r.kind, r.content_hash) for r in got] == [("SERVICE", hashlib.sha256(b"x").hexdigest())]


def test_claim_times_out(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "file_path string, agent string, status string, ts timestamp"
    for k, rows in enumerate([[("a", "x", "CLAIMED", at(0)), ("b", "x", "CLAIMED", at(1))], [("b", "x", "COMPLETED", at(5)), ("c", "y", "CLAIMED", at(40))], [("c", "y", "PROCESSING", at(41))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {(r.file_path, r.status, r.retries) for r in watch.drained(watch.claims(stream), f"c{uuid.uuid4().hex}").collect()}
    assert ("a", "PENDING", 1) in got and ("b", "COMPLETED", 0) in got
    assert ("c", "PENDING", 1) not in got and ("b", "PENDING", 1) not in got
