"""The attempt stream, stopped and started again, against one pass over all rows in the order of their time."""

import datetime as dt

from pyspark.sql import functions as F

from lakewright.streaming import events, retries

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
ROWS = [  # item, seconds, outcome, message
    [(1, 0, "started", None), (1, 5, "failed", "HTTP 503 from host"), (2, 6, "failed", "bad schema"), (3, 7, "failed", "ETIMEDOUT"), (None, 8, "started", None), (5, 9, "completed", None)],
    [(1, 40, "started", None), (1, 50, "completed", None), (2, 55, "completed", None), (3, 400, "failed", "read timeout"), (5, 410, "failed", "aborted"), (4, 420, "failed", "Interrupted")],
    [(3, 2000, "failed", "timeout"), (6, 2001, "started", None), (3, 2005, "completed", None)],
    [(6, 9000, "started", None), (7, 9001, "failed", "connection aborted")],
]


def plain(rows, most=3, wait=60):
    """Last (attempts, status, retryable, due) of each item, for timers that fire at once."""
    out = {}
    for item, at, outcome, message in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        attempts, status, due = out.get(item, (0, "pending", None))
        if status in ("completed", "final"):
            continue
        due = None
        if outcome == "started":
            status = "in_progress"
        else:
            attempts += 1
            low = (message or "").lower()
            transient = any(m in low for m in retries.TRANSIENT) or "http 503" in low
            status = outcome
            if outcome == "failed":
                status, due = ("failed", at + wait * 2 ** (attempts - 1)) if transient and attempts < most else ("final", None)
        out[item] = attempts, status, due
    mark = max(r[1] for r in rows) - 10
    done = {}
    for item, (attempts, status, due) in out.items():
        if due is not None and due <= mark:
            status, due = "pending", None
        done[item] = (attempts, "failed" if status == "final" else status, status not in ("completed", "final"), due)
    return done


def run(spark, folder, batches, parts):
    """Writes each batch as a file and runs the stream after every `parts` of them."""
    schema = "item long, ts timestamp, outcome string, message string"
    for k, rows in enumerate(batches, 1):
        data = [(i, START + dt.timedelta(seconds=s), o, m) for i, s, o, m in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k % parts == 0 or k == len(batches):
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            moved = retries.transitions(stream, "item", "ts", F.col("outcome"), F.col("message"), late="10 seconds")
            out = retries.run_into(moved, f"{folder}/out", f"{folder}/checkpoint")
    return out


def test_restarted_stream_ends_where_one_run_does(spark, tmp_path):
    want = plain([r for b in ROWS for r in b])
    for parts in (1, 2, 4):
        rows = run(spark, str(tmp_path / str(parts)), ROWS, parts)
        got = {r.item: (r.attempts, r.status, r.retryable, r.due and int(r.due.timestamp() - START.timestamp())) for r in retries.latest(rows).collect()}
        assert got == want
        assert rows.count() == rows.select("item", "step").distinct().count()
    steps = [(r.status, r.attempts) for r in rows.where("item = 3").orderBy("step").collect()]
    assert steps == [("failed", 1), ("pending", 1), ("failed", 2), ("pending", 2), ("failed", 3)]


def test_transient_messages(spark):
    rows = [("HTTP 500", True), ("http 404", False), ("x ECONNRESET y", True), ("Aborted", True), (None, False), ("bad", False)]
    df = spark.createDataFrame([(m,) for m, _ in rows], "m string")
    assert [r.t for r in df.select(retries.is_transient(F.col("m")).alias("t")).collect()] == [w for _, w in rows]


def test_stream_reads_lone_files(spark, sf_dir):
    assert events.stream_table(spark, f"{sf_dir}/events.parquet").isStreaming


def test_files_in_any_order_lose_no_rows(spark, sf_dir, tmp_path):
    """Each file holds the whole time of its users, so after the first one all rows of the others would be late."""
    import __spark_entry__ as e

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 4 < 2")
    for part in range(2):
        rows.where(f"user_id % 4 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/two/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")
    two, one = (sorted(map(tuple, e.queries()["attempt_states"](spark, f"{tmp_path}/{k}").collect())) for k in ("two", "one"))
    assert two == one and len(one) == rows.select("user_id").distinct().count()
