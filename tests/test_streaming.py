from twinsieve.streaming import incremental


def test_files_that_arrive_in_turns(spark, tmp_path):
    schema = "path string, device long, inode long, len long, content binary"
    source, table, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "table", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame([(p, 1, i, len(c), c) for p, i, c in rows], schema).write.mode("append").parquet(source)
        incremental.follow(spark.readStream.schema(schema).parquet(source), table, checkpoint).awaitTermination()
        return sorted(r.path for r in incremental.members(spark, table).collect())

    assert arrive(("/a", 1, b"x"), ("/b", 2, b"y")) == []
    assert arrive(("/c", 3, b"x")) == ["/a", "/c"]
    assert arrive(("/b", 2, b"x"), ("/d", 3, b"x")) == ["/a", "/b", "/c", "/d"]
    assert arrive(("/a", 1, b"new"), ("/c", 3, b"new2"), ("/d", 3, b"new3")) == []
