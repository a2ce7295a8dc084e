"""Ordered sets of changes against applying them one by one to a dictionary."""

import datetime as dt
import random

from notequery.operators import ordered

DAY = dt.datetime(2025, 1, 1)
SCHEMA = "id long, path string, action string, new_path string, body string, expected timestamp, at timestamp"


def one_by_one(notes, changes):
    held, refused = {p: (b, m) for p, b, m in notes}, []
    for id_, path, action, target, body, expected, at in sorted(changes, key=lambda c: (c[6], c[0])):
        reason = None
        if action == "create":
            if path in held:
                reason = "taken"
            else:
                held[path] = (body, at)
        elif path not in held:
            reason = "absent"
        elif action == "save":
            if expected is not None and expected != held[path][1]:
                reason = "conflict"
            else:
                held[path] = (body, at)
        elif action == "move":
            if target in held and target != path:
                reason = "taken"
            else:
                held[target] = held.pop(path)
        elif action == "delete":
            del held[path]
        if reason:
            refused.append((id_, path, action, reason))
    return sorted((p, b, m) for p, (b, m) in held.items()), sorted(refused)


def test_random_sequences_equal_single_steps(spark):
    rng = random.Random(7)
    paths = [f"d{i % 3}/{i}.md" for i in range(40)]
    notes = [(p, f"body of {p}", DAY) for p in paths[:25]]
    changes = []
    for i in range(160):
        action, path = rng.choice(["create", "save", "save", "move", "move", "delete"]), rng.choice(paths)
        at = DAY + dt.timedelta(days=rng.randint(1, 20))
        changes.append((i, path, action, rng.choice(paths[:12] + [path]) if action == "move" else None, f"text {i}", rng.choice([None, DAY, at]) if action == "save" else None, at))
    frame = spark.createDataFrame([(p, p.rpartition("/")[0], b, m, [p]) for p, b, m in notes], "path string, folder string, body string, modified timestamp, tags array<string>")
    kept, refused = ordered.apply(frame, spark.createDataFrame(changes, SCHEMA))
    want, no = one_by_one(notes, changes)
    assert kept.columns == frame.columns
    assert sorted((r["path"], r["body"], r["modified"]) for r in kept.collect()) == want
    assert sorted((r["id"], r["path"], r["action"], r["reason"]) for r in refused.collect()) == no and len(no) > 20
    assert all(r["folder"] == r["path"].rpartition("/")[0] for r in kept.collect())


def test_no_changes_and_no_notes(spark):
    frame = spark.createDataFrame([("a.md", "x", None)], "path string, body string, modified timestamp")
    none = spark.createDataFrame([], SCHEMA)
    assert ordered.apply(frame, none)[0].count() == 1 and ordered.apply(frame, none)[1].count() == 0
    rows = spark.createDataFrame([(1, "a.md", "create", None, "x", None, DAY), (2, "a.md", "odd", None, None, None, DAY), (3, "b\\c.md", "save", None, None, None, DAY)], SCHEMA)
    kept, refused = ordered.apply(frame.limit(0), rows)
    assert [tuple(r) for r in kept.collect()] == [("a.md", "x", DAY)]
    assert sorted((r["path"], r["reason"]) for r in refused.collect()) == [("a.md", "unknown"), ("b/c.md", "absent")]
