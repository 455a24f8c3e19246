import json
import os

import pytest
from brainweave.operators import upsert
from brainweave.sources import feeds, paged, sync
from pyspark.sql import functions as F

TRANSPORT = "fake_transport:Service"


def serve(root, feed, units):
    with open(f"{root}/{feed}.json", "w") as f:
        json.dump(units, f)


def task(i, updated, parent=None, deleted=False, title=None):
    return {"id": f"t{i}", "updated": updated, "deleted": deleted, "title": title or f"task {i} v{updated}", "parent": parent, "listTitle": "home"}


def tasks_mirror(removes=False):
    rows = lambda raw: feeds.tasks(raw, ["home"]).withColumns({"task_id": F.md5("external_id"), "parent_task_id": F.lit(None).cast("string")})
    return sync.Mirror("tasks", feeds.TASKS, rows, finish=lambda t: upsert.resolve_parents(t), removes=removes, fixed=("task_id", "parent_task_id"))


def log(root):
    names = os.listdir(f"{root}/log") if os.path.isdir(f"{root}/log") else []
    return sorted(open(f"{root}/log/{n}").read() for n in names)


def test_pages_partitions_and_pushed_filters(spark, tmp_path):
    serve(tmp_path, "tasks", {"b": [task(i, i) for i in range(5)], "a": [task(9, 9)], "none": []})
    df = paged.read(spark, TRANSPORT, "tasks", root=str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    assert [(r.unit, r.id, r.updated) for r in df.orderBy("unit", "id").collect()] == [("a", "t9", 9), *(("b", f"t{i}", i) for i in range(5))]
    before = log(tmp_path)
    got = df.filter("unit = 'b' AND updated >= 3").collect()
    new = [x for x in log(tmp_path)]
    for x in before:
        new.remove(x)
    assert [r.id for r in got] == ["t3", "t4"] and new and all(x.startswith("tasks b ") and x.endswith(" 3") for x in new)
    assert df.filter("unit = 'nowhere'").count() == 0
    item = json.loads(df.filter("id = 't9'").first().payload)
    assert item["title"] == "task 9 v9"


def test_failing_pages_are_asked_again(spark, tmp_path):
    serve(tmp_path, "tasks", {"a": [task(i, i) for i in range(5)]})
    df = paged.read(spark, TRANSPORT, "tasks", root=str(tmp_path), broken="once", pause="0")
    assert df.count() == 5
    with pytest.raises(Exception, match="the page isn't there"):
        paged.read(spark, TRANSPORT, "tasks", root=str(tmp_path), broken="tasks", retries="1", pause="0").collect()


def mirror(spark, root, feed="tasks", before=10**9):
    df = sync.newest(spark, f"file://{root}/mirror/{feed}", before)
    return {} if df is None else {r.external_id: (r.title, r.parent_task_id) for r in df.collect()}


def test_round_is_repeatable_and_goes_on_after_a_failure(spark, tmp_path):
    root = f"file://{tmp_path}/mirror"
    contacts = sync.Mirror("contacts", feeds.CONTACTS, feeds.contacts)
    serve(tmp_path, "contacts", {"me": [{"id": "c", "updated": 1, "resourceName": "c", "names": [{"displayName": "Ann"}]}]})
    serve(tmp_path, "tasks", {"l": [task(1, 1), task(2, 1, parent="t1"), task(3, 1), {"id": "t4", "updated": 1}]})
    both = [tasks_mirror(), contacts]
    assert sync.sync_round(spark, both, TRANSPORT, root, 1, root=str(tmp_path), pause="0") == {"tasks": None, "contacts": None}
    (t1,) = [r.task_id for r in sync.newest(spark, f"{root}/tasks", 9).filter("external_id = 't1'").collect()]
    assert mirror(spark, tmp_path) == {"t1": ("task 1 v1", None), "t2": ("task 2 v1", t1), "t3": ("task 3 v1", None)}
    serve(tmp_path, "tasks", {"l": [task(1, 2), task(5, 2)], "m": [task(1, 1)]})
    for _ in range(2):  # run again: the same
        report = sync.sync_round(spark, both, TRANSPORT, root, 2, root=str(tmp_path), broken="contacts", retries="0", pause="0")
        assert report["tasks"] is None and report["contacts"]
        now = mirror(spark, tmp_path)
        assert {k: v[0] for k, v in now.items()} == {"t1": "task 1 v2", "t2": "task 2 v1", "t3": "task 3 v1", "t5": "task 5 v2"} and now["t2"][1] == t1
    assert mirror(spark, tmp_path, before=2)["t1"][0] == "task 1 v1" and sync.newest(spark, f"{root}/contacts", 9).count() == 1
    sync.sync_round(spark, [tasks_mirror(removes=True)], TRANSPORT, root, 3, root=str(tmp_path))
    assert set(mirror(spark, tmp_path)) == {"t1", "t5"}


def test_changes_as_a_stream_give_the_same_mirror(spark, tmp_path):
    root = f"file://{tmp_path}/mirror"
    items = [task(1, 1), task(2, 1, parent="t1"), task(3, 1)]
    serve(tmp_path, "tasks", {"l": items})
    follow = lambda: sync.follow(spark, tasks_mirror(), TRANSPORT, root, f"file://{tmp_path}/cp", root=str(tmp_path))
    follow()
    first = mirror(spark, tmp_path)
    items += [task(2, 2, parent="t1"), task(3, 2, deleted=True), task(4, 2), task(2, 3, parent="t4")]
    serve(tmp_path, "tasks", {"l": items, "m": [task(7, 1)]})
    follow()
    asked = len(log(tmp_path))
    follow()  # nothing new
    assert len(log(tmp_path)) == asked and set(first) == {"t1", "t2", "t3"}
    serve(tmp_path, "tasks", {"l": [task(1, 1), task(2, 3, parent="t4"), task(4, 2)], "m": [task(7, 1)]})
    sync.sync_round(spark, [tasks_mirror()], TRANSPORT, f"file://{tmp_path}/other", 1, root=str(tmp_path))
    want = {r.external_id: r.title for r in sync.newest(spark, f"file://{tmp_path}/other/tasks", 9).collect()}
    assert {k: v[0] for k, v in mirror(spark, tmp_path).items()} == want
