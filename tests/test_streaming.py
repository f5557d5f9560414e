import json

from textweave.plans.config import Config
from textweave.plans.log import by_day, event, read_events
from textweave.streaming.events import event_stream, ingest, windowed_counts


def test_log_and_windows(spark, tmp_path):
    c = Config(root=str(tmp_path))
    event(c, "find", query="x")
    assert not c.index_dir.exists()
    c.log = True
    event(c, "find", query="x", bad=object())
    event(c, "find", query="x")
    assert by_day(read_events(spark, str(c.index_dir / "events.jsonl"))).first().n == 1
    src = tmp_path / "in"
    src.mkdir()
    rows = [("2024-01-01T00:01:00", "a"), ("2024-01-01T00:02:00", "a"), ("2024-01-01T00:12:00", "b")]
    (src / "1.json").write_text("\n".join(json.dumps({"ts": t, "type": k}) for t, k in rows))
    q = windowed_counts(event_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.type, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    seen = []
    ingest(event_stream(spark, str(src)), lambda df, n: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 3
