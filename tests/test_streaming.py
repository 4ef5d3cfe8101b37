from maskwright.operators.quality import match
from maskwright.streaming.redact import redact_rows


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "SSN 123-45-6789, mail asha@corp.example.in", "x"), (2, None, "y"), (3, "", "z"), (4, "call +91 22 4009 4400 or 10.20.30.40", "w")]
    spark.createDataFrame(rows, "k long, text string, other string").write.parquet(str(tmp_path / "in"))
    batch = redact_rows(spark.read.parquet(str(tmp_path / "in")))
    stream = redact_rows(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("redacted").collect()))
    assert got == sorted(map(tuple, batch.collect()))
    text = {k: t for k, t, _ in got}
    assert text[2] is None and text[3] == "" and not any(s in text[1] + text[4] for s in ("123-45-6789", "corp.example.in", "4009 4400", "10.20.30.40"))


def test_greedy_match(spark):
    gold = spark.createDataFrame([("P", "a", 1, "Asha Rao"), ("P", "a", 2, "Asha"), ("P", "b", 1, "Ravi"), ("Q", "a", 1, "zz"), ("P", "a", 3, None)], "type string, part string, n long, text string")
    found = spark.createDataFrame([("P", "a", 7, "Asha"), ("P", "a", 8, "Asha Rao"), ("P", "c", 1, "Ravi"), ("Q", "a", 4, "yy")], "type string, part string, n long, text string")
    got = {(r["type"], r["part"], r["n"]): (r["found_n"], r["similarity"]) for r in match(gold, found).collect()}
    assert got == {("P", "a", 1): (8, 1.0), ("P", "a", 2): (7, 1.0), ("P", "b", 1): (None, None), ("Q", "a", 1): (None, None), ("P", "a", 3): (None, None)}
