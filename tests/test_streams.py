from receptorium.constants import INDEX_COLUMNS
from receptorium.streaming import ingest, limiter

EVENTS = [(f"k{k}", 10 * k + i, t) for k in range(2) for i, t in enumerate([0, 1, 2, 3, 4, 61, 62, 200])]


def events(spark):
    df = spark.createDataFrame(EVENTS, "key string, event_id long, t long")
    return df.selectExpr("key", "event_id", "timestamp_seconds(t) as ts")


WANT = [True, True, True, False, False, True, True, True]


def test_batch_limiter(spark):
    got = {r.event_id: r.accepted for r in limiter.limit_batch(events(spark), 3).collect()}
    assert [got[i] for i in range(8)] == WANT and [got[10 + i] for i in range(8)] == WANT


def test_stream_limiter(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = limiter.limit_stream(stream, 3).writeStream.format("memory").queryName("limited").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.event_id: r.accepted for r in spark.table("limited").collect()}
    assert [got[i] for i in range(8)] == WANT


def test_state_of_idle_keys_goes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []
    for n, batch in enumerate([[("a", 0, 0), ("a", 1, 1), ("b", 2, 2)], [("c", 3, 1000)], [("c", 4, 1001), ("a", 5, 1002), ("a", 6, 1003), ("a", 7, 1003)]]):
        df = spark.createDataFrame(batch, "key string, event_id long, t long").selectExpr("key", "event_id", "timestamp_seconds(1000000 + t) as ts")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema("key string, event_id long, ts timestamp").parquet(str(tmp_path / "in" / "*"))
        q = limiter.limit_stream(stream, 2, "10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")) \
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(90)
        rows.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:]))
    got = {r.event_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, True, True, True, True, False]
    assert rows[1] < rows[0] + 1  # a and b have left when c is alone


def test_a_busy_key_passes(spark):
    events = spark.range(300_000).selectExpr("'k' as key", "id as event_id", "timestamp_micros(id * 1000) as ts")
    assert limiter.limit_batch(events, 3).filter("accepted").count() == 3 * 5  # three a minute and a bit, for 300 seconds


def test_ingest_adds_only_new(spark, tmp_path, make_index):
    def land(name, rows):
        make_index(rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    a, b = dict(source="vdjdb", chain="beta", cdr3_aa="CASS"), dict(source="vdjdb", chain="beta", cdr3_aa="CASR")
    schema = ", ".join(f"{c} string" for c in INDEX_COLUMNS) + ", src_row long"
    for name, rows in (("one", [a, a]), ("two", [a, b])):
        land(name, rows)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(90)
    assert sorted(r.cdr3_aa for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["CASR", "CASS"]


def test_continuous_lookup_hands_on_the_whole_answer(spark, tmp_path, make_index):
    index = make_index([dict(source="iedb", source_record_id=f"iedb:{n}", species="human", chain="beta", cdr3_aa=c) for n, c in enumerate(("CSARDRGYTF", "CSARERGYTF"))])
    asked = "qid string, cdr3_aa string, cdr3_aa_b string, species string"
    spark.createDataFrame([("q", "CSARDRGYTF", "CIVRGDSNTF", None)], asked).coalesce(1).write.parquet(str(tmp_path / "asked"))
    seen = {}

    def sink(answer, batch_id):
        seen.update({name: [r.asDict() for r in part.collect()] for name, part in answer.items()})

    stream = spark.readStream.schema(asked).parquet(str(tmp_path / "asked"))
    ingest.continuous_lookup(stream, index, sink, str(tmp_path / "cp")).awaitTermination(120)
    assert [r["source_record_id"] for r in seen["exact"]] == ["iedb:0"] and [r["source_record_id"] for r in seen["neighbours"]] == ["iedb:1"]
    assert [r["total_matches"] for r in seen["totals"]] == [1] and [r["code"] for r in seen["warnings"]] == ["no_pairing_found"]
    assert seen["requests"] and seen["pairs"] == []


def test_lookup_sees_a_build_announced_between_batches(spark, tmp_path, make_index):
    from receptorium.sources import files

    root, seen = str(tmp_path / "index"), {}

    def sink(answer, _):
        for r in answer["exact"].select("qid", "source_record_id").collect():
            seen.setdefault(r.qid, []).append(r.source_record_id)

    for n, rows in ((1, ["old"]), (2, ["old", "new"])):
        files.write_index(make_index([dict(source="vdjdb", source_record_id=r, species="human", chain="beta", cdr3_aa="CASSLF", v_gene="TRBV1") for r in rows]), root, str(n))
        spark.createDataFrame([(n, "CASSLF")], "qid long, cdr3_aa string").coalesce(1).write.parquet(str(tmp_path / "q" / str(n)))
        stream = spark.readStream.schema("qid long, cdr3_aa string").parquet(str(tmp_path / "q" / "*"))
        ingest.continuous_lookup(stream, root, sink, str(tmp_path / "cp"), include_neighbours=False).awaitTermination(120)
    assert seen == {1: ["old"], 2: ["old", "new"]}
