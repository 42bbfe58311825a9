import random

from pyspark.sql import functions as F

from tallyvox.operators.cells import Guards, assign_cells, cell_text, cells_of, data_cells


def walk(rows, guards):
    """The sequential rule: {event: cell}, {(ws, cell): reason}."""
    cells, reasons, held = {}, {}, {}
    for ws, event, ts, tokens in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        no, start, count, used = held.get(ws, (0, 0, 0, 0))
        full, late = count >= guards.max_count, ts - start >= guards.max_minutes * 60
        if count and (full or late or used + tokens > guards.max_tokens):
            reasons[ws, no] = "count_limit" if full else "window_limit" if late else "token_limit"
            count = 0
        if count == 0:
            no, start, used = no + 1, ts, 0
        held[ws] = (no, start, count + 1, used + tokens)
        cells[event] = no
    for ws, (no, _, count, used) in held.items():
        reasons[ws, no] = "token_limit" if count == 1 and used > guards.max_tokens else "stream_end"
    return cells, reasons


def frame(spark, rows):
    data = [(ws, event, ts, "x" * (4 * (tokens - 1))) for ws, event, ts, tokens in rows]
    return spark.createDataFrame(data, "ws long, event_id long, ts long, normalized_text string").withColumn(
        "occurred_at", F.timestamp_seconds("ts")
    )


def check(spark, rows, guards, partitions):
    want, reasons = walk(rows, guards)
    assigned = assign_cells(frame(spark, rows), guards, partitions)
    assert {r.event_id: r.cell_no for r in assigned.select("event_id", "cell_no").collect()} == want
    got = {(r.ws, r.cell_no): r.close_reason for r in cells_of(assigned, guards).collect()}
    assert got == reasons


def test_equals_the_walk(spark):
    random.seed(7)
    for trial, partitions in enumerate([1, 3, 17, 40]):
        guards = Guards(random.choice([2, 5, 40]), random.choice([5, 60]), random.choice([20, 6000]))
        rows, now = [], 0
        for event in range(300):
            now += random.choice([0, 0, 1, 30, 200, 4000])
            ws = 1 if random.random() < 0.7 else random.randrange(2, 5)  # one hot workspace
            rows.append((ws, event, now, random.randrange(1, 12)))
        check(spark, rows, guards, partitions)


def test_dense_single_workspace(spark):
    rows = [(9, e, e * 20, 2) for e in range(500)]
    check(spark, rows, Guards(), 11)


def test_forty_one_events(spark):
    rows = data_cells(frame(spark, [(1, e, e, 1) for e in range(41)]), partitions=4)
    got = {(r.cell_no, r.close_reason, r.event_count) for r in rows.collect()}
    assert got == {(1, "count_limit", 40), (2, "stream_end", 1)}


def test_cell_text_stops_at_the_first_overflow(spark):
    issues = spark.createDataFrame([(1, 1, "a", [1, 2, 3])], "ws long, cell_no long, canonical_key string, sample_event_ids array<long>")
    events = spark.createDataFrame([(1, "aaaa"), (2, "b" * 9), (3, "c")], "event_id long, sanitized_text string")
    assert cell_text(issues, events, cap=10).first().cell_text == "aaaa\n"
