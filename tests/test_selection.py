import random
from datetime import datetime, timedelta

from sheaf.operators.selection import apply_ops, select_contents, selection_state

START = datetime(2024, 1, 1)


def test_toggle_twice(spark):
    toggles = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("c",), ("c",)], "path string")
    got = {r.path: (r.toggles, r.is_selected) for r in selection_state(toggles).collect()}
    assert got == {"a": (2, False), "b": (1, True), "c": (3, True)}


def test_only_selected_files_go_out(spark):
    files = spark.createDataFrame(
        [("test1.txt", 100, b"one"), ("test2.txt", 200, b"two")], "path string, size bigint, content binary"
    )
    chosen = selection_state(spark.createDataFrame([("test1.txt",)], "path string")).where("is_selected")
    assert [r.path for r in select_contents(files, chosen).collect()] == ["test1.txt"]


def test_last_operation_wins(spark):
    def at(seconds):
        return START + timedelta(seconds=seconds)

    rows = [
        ("a", "write", "1", at(1), 1),
        ("a", "remove", None, at(2), 2),
        ("a", "write", "3", at(3), 3),
        ("b", "write", "1", at(1), 4),
        ("b", "remove", None, at(1), 5),  # same time: the sequence decides
        ("c", "remove", None, at(1), 6),
        ("d", "write", "new", at(9), 7),
        ("d", "write", "old", at(2), 8),
        ("e", "write", None, at(1), 9),
        ("", "write", "x", at(1), 10),
        (None, "write", "x", at(1), 11),
    ]
    schema = "path string, op string, content string, ts timestamp, seq bigint"
    got = {r.path: r.content for r in apply_ops(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "3", "d": "new", "e": None}


def test_random_operations_with_a_hot_path(spark):
    r = random.Random(5)
    rows, buffer = [], {}
    for seq in range(5000):
        path = "hot" if r.random() < 0.4 else f"p{r.randrange(300)}"
        op = r.choice(["write", "write", "remove"])
        rows.append((path, op, f"v{seq}", START + timedelta(seconds=seq // 3), seq))
        if op == "write":
            buffer[path] = f"v{seq}"
        else:
            buffer.pop(path, None)
    r.shuffle(rows)
    schema = "path string, op string, content string, ts timestamp, seq bigint"
    got = {x.path: x.content for x in apply_ops(spark.createDataFrame(rows, schema)).collect()}
    assert got == buffer
