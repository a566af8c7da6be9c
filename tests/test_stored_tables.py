import datetime
import hashlib
import json
import os
import random
import resource

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import sync
from mediaquarry.operators.components import connected_components
from mediaquarry.operators.duplicates import near_links
from mediaquarry.operators.near_index import HashIndex
from mediaquarry.operators.tags import resolve
from mediaquarry.sources import files, in_tasks, sync_files
from mediaquarry.storage import replace_file, replace_keeping_old, restore_old
from mediaquarry.streaming import exports
from mediaquarry.streaming.imports import ImportStore, import_stream
from mediaquarry.streaming.upsert import SCHEMA, LinkTable


def shown(table):
    return sorted(map(tuple, table.collect()))


# -- links in buckets --------------------------------------------------------------------------------


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_batches_of_records_equal_one_resolution(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randrange(40), r.choice(["Sun", "sun", "SEA", "sea", "x"]), float(r.randrange(30)), r.random() < 0.3, n) for n in range(300)]
    table = LinkTable(spark, f"file://{tmp_path}/links", buckets=8)
    for batch in range(4):
        assert table.merge(records(spark, rows[75 * batch : 75 * (batch + 1)]), batch)
    assert shown(table.read()) == shown(resolve(records(spark, rows)).select(*table.read().columns))


def test_only_touched_buckets_are_written_and_replays_do_nothing(spark, tmp_path):
    table = LinkTable(spark, f"file://{tmp_path}/links", buckets=16)
    assert table.merge(records(spark, [(i, "sun", 1.0, False, i) for i in range(60)]), 0)
    before = table.manifest.read()["buckets"]
    times = {at: sorted((f, os.stat(f"{at[7:]}/{f}").st_mtime_ns) for f in os.listdir(at[7:])) for at in before.values()}
    assert table.merge(records(spark, [(7, "sun", 2.0, True, 0), (None, "x", 1.0, False, 1), (8, None, 1.0, False, 2), (9, "x", None, False, 3)]), 1)
    after = table.manifest.read()["buckets"]
    assert len(before) > 8 and sum(before[b] != after[b] for b in before) == 1
    assert {at: sorted((f, os.stat(f"{at[7:]}/{f}").st_mtime_ns) for f in os.listdir(at[7:])) for at in before.values()} == times
    want = shown(table.read())
    assert (7, "sun", "sun", 2.0, True) in want and len(want) == 60
    assert not table.merge(records(spark, [(7, "sun", 9.0, False, 0)]), 1) and not table.merge(records(spark, [(7, "sun", 9.0, False, 0)]), 0)
    assert shown(table.read()) == want
    # another stream has numbers of its own
    assert table.merge(records(spark, [(7, "sun", 9.0, False, 0)]), 0, "phone") and (7, "sun", "sun", 9.0, False) in shown(table.read())
    assert table.merge(records(spark, []), 2) and table.manifest.read()["batches"] == {"": 2, "phone": 0}


def test_a_batch_that_is_lost_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = LinkTable(spark, f"file://{tmp_path}/links", buckets=4)
    table.merge(records(spark, [(1, "sun", 1.0, False, 0)]), 0)
    want = shown(table.read())
    monkeypatch.setattr("mediaquarry.storage.replace_file", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.merge(records(spark, [(1, "sun", 2.0, True, 0)]), 1)
    monkeypatch.undo()
    assert shown(table.read()) == want
    assert table.merge(records(spark, [(1, "sun", 2.0, True, 0)]), 1) and shown(table.read()) == [(1, "sun", "sun", 2.0, True)]


def test_a_file_is_replaced_in_one_step(spark, tmp_path):
    for text in ("one", "two"):
        replace_file(spark, f"file://{tmp_path}/x.json", text)
        assert (tmp_path / "x.json").read_text() == text
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["x.json"]


def test_a_file_is_kept_until_the_new_one_is_in_its_place(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    for text in ("one", "two"):
        replace_keeping_old(spark, path, text)
        assert (tmp_path / "x.json").read_text() == text
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for fails in (1, 2):  # the old file can't step aside; the new one can't take its place
        calls = []

        def rename(a, b, calls=calls, fails=fails):
            calls.append(a)
            return len(calls) != fails and store.rename(a, b)

        with pytest.raises(OSError, match="x.json"):
            replace_keeping_old(spark, path, "three", rename)
        assert (tmp_path / "x.json").read_text() == "two"
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["x.json"]
    assert not restore_old(spark, path)
    (tmp_path / "x.json").rename(tmp_path / ".x.json.abc.bak")  # the process was lost in between
    (tmp_path / ".x.json.abc.tmp").write_text("three")
    assert restore_old(spark, path) and (tmp_path / "x.json").read_text() == "two"
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["x.json"]


# -- hashes ------------------------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_an_index_in_batches_equals_a_run_over_all(spark, tmp_path):
    r = random.Random(8)
    hashes = [r.getrandbits(64) for _ in range(60)]
    for _ in range(90):
        h = r.choice(hashes)
        for bit in r.sample(range(64), r.randrange(5)):
            h ^= 1 << bit
        hashes.append(h)
    r.shuffle(hashes)
    rows = [(i, signed(h), r.choice(["photo", "video"])) for i, h in enumerate(hashes)] + [(900, None, "photo"), (901, 5, None), (902, 5, None)]
    table = spark.createDataFrame(rows, "id long, h long, kind string")
    index = HashIndex(spark, f"file://{tmp_path}/index", max_distance=3, parts=8)
    order = rows[100:] + rows[:50] + rows[50:100]  # smaller ids come late
    for batch, part in enumerate((order[:60], order[60:120], [*order[60:70], *order[120:]])):
        assert index.add(spark.createDataFrame(part, "id long, h long, kind string"), batch)
    assert not index.add(table, 1)
    want = connected_components(near_links(table.withColumn("type", F.coalesce("kind", F.lit(""))), 3))
    assert shown(index.groups()) == shown(want)
    assert index.add(table, 3) and shown(index.groups()) == shown(want)  # all are there


def test_a_batch_reads_only_the_parts_of_its_keys(spark, tmp_path):
    index = HashIndex(spark, f"file://{tmp_path}/index", max_distance=0, parts=64)
    index.add(spark.createDataFrame([(i, signed(hash((i, "h")) & (1 << 64) - 1), "photo") for i in range(200)], "id long, h long, kind string"), 0)
    folders = [f"{tmp_path}/index/{x}" for x in os.listdir(tmp_path / "index") if x.startswith("keys")]
    assert len(folders) == 1 and len([x for x in os.listdir(folders[0]) if x.startswith("part=")]) > 40
    new = spark.createDataFrame([(500, 77, "photo"), (501, 77, "photo")], "id long, h long, kind string")
    other = HashIndex(spark, f"file://{tmp_path}/other", max_distance=0, parts=64)
    other.add(new, 0)
    (own,) = {x for f in os.listdir(tmp_path / "other") if f.startswith("keys") for x in os.listdir(tmp_path / "other" / f) if x.startswith("part=")}
    for x in os.listdir(folders[0]):  # the other parts can't be read any more
        if x.startswith("part=") and x != own:
            for f in os.listdir(f"{folders[0]}/{x}"):
                (tmp_path / "index" / folders[0] / x / f).write_bytes(b"broken")
    assert index.add(new, 1)
    assert shown(index.groups()) == [(500, 500), (501, 500)]


# -- imports -----------------------------------------------------------------------------------------


def document(machine, media=(), moves=(), **more):
    return json.dumps(
        {"format": sync_files.FORMAT, "version": 1, "machine_id": machine, "exported_at": 1.0, "media": [{"path": p, "size": s, "tags": [{"name": t, "updated_at": at, "deleted": gone}]} for p, s, t, at, gone in media],
         "moves": [{"from": a, "to": b, "size": s, "at": at} for a, b, s, at in moves]} | more
    )


def library(spark):
    rows = [(1, "/l", "", "1.jpg", "photo", 3, 1.0, True, "1.jpg"), (2, "/l", "", "2.jpg", "photo", 6, 1.0, True, "2.jpg"), (3, "/l", "", "3.mp4", "video", 7, 1.0, True, "3.mp4")]
    media = spark.createDataFrame(rows, "id long, root string, album string, filename string, type string, size long, mtime double, present boolean, rel_path string")
    links = spark.createDataFrame([(1, "sun", "sun", 5.0, False)], "media_id long, tag_key string, tag string, updated_at double, deleted boolean")
    return sync.Library(media, links, spark.createDataFrame([], "path string, tag string, updated_at double, deleted boolean"), spark.createDataFrame([], "from_path string, to_path string, size long, moved_at double"))


def test_documents_are_imported_once_across_restarts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    store = ImportStore(spark, f"file://{tmp_path}/library", own_machine="me")
    store.begin(library(spark))

    def run():
        import_stream(store, f"file://{inbox}", f"file://{tmp_path}/state").awaitTermination()

    (inbox / "sync-a.json").write_text(document("a", [("1.jpg", 3, "sun", 9.0, True), ("T/3.mp4", 7, "sea", 1.0, False), ("gone.jpg", 1, "x", 1.0, False)], [("3.mp4", "T/3.mp4", 7, 5.0), ("1.jpg", "T/x.jpg", 3, 6.0)]))
    (inbox / "sync-bad.json").write_text("{")
    (inbox / "sync-me.json").write_text(document("me", [("2.jpg", 6, "mine", 1.0, False)]))
    (inbox / "other.json").write_text("not asked for")
    run()
    first = {name: shown(t) for name, t in store.library()._asdict().items()}
    assert (3, "sea") in {(r[0], r[1]) for r in first["links"]} and (1, "sun", "sun", 9.0, True) in first["links"]
    assert [r[-1] for r in first["media"] if r[0] == 3] == ["T/3.mp4"] and len(first["log"]) == 1 and len(first["pending"]) == 1
    assert [(os.path.basename(r.file), r.problem) for r in store.quarantine().collect()] == [("sync-bad.json", "not a sync file")]
    assert sorted((os.path.basename(r.file), r.documents) for r in store.ledger().collect()) == [("sync-a.json", 1), ("sync-bad.json", 0), ("sync-me.json", 0)]
    assert shown(store.counters()) == [(0, 3, 1, 1, 1, 2, 1)]
    assert shown(store.skipped()) == [("1.jpg", "T/x.jpg", "move and rename in one", 0)]
    assert shown(store.summaries()) == [(0, "2 tag change(s), 1 file move(s), 1 record(s) for files not on this machine, 1 move(s) skipped, 1 file problem(s)")]

    # a new process: nothing is read twice; a new file is a new batch
    store = ImportStore(spark, f"file://{tmp_path}/library", own_machine="me")
    run()
    assert {name: shown(t) for name, t in store.library()._asdict().items()} == first and store.ledger().count() == 3
    (inbox / "sync-b.json").write_text(document("b", [("2.jpg", 6, "b", 2.0, False)]))
    run()
    assert store.ledger().count() == 4 and (2, "b", "b", 2.0, False) in shown(store.library().links)
    # the batch again, as after a crash between its manifest and the stream's own note
    version = store.manifest.read()
    again = spark.read.format("binaryFile").load(f"file://{inbox}/sync-b.json")
    assert not store.take(again, 1) and store.manifest.read() == version


def test_a_stream_of_documents_equals_one_import(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "sync-a.json").write_text(document("a", [("1.jpg", 3, "sun", 9.0, True), ("2.jpg", 6, "sea", 3.0, False)], [("3.mp4", "T/3.mp4", 7, 5.0)]))
    (inbox / "sync-b.json").write_text(document("b", [("2.jpg", 6, "Sea", 4.0, True), ("T/3.mp4", 7, "v", 1.0, False)]))
    store = ImportStore(spark, f"file://{tmp_path}/library")
    store.begin(library(spark))
    import_stream(store, f"file://{inbox}", f"file://{tmp_path}/state").awaitTermination()
    docs, _ = sync_files.read_documents(spark, f"file://{inbox}")
    want = sync.imported(library(spark), sync.flat_records(docs), sync.flat_moves(docs))[0]
    assert {n: shown(t) for n, t in store.library()._asdict().items()} == {n: shown(t) for n, t in want._asdict().items()}


# -- exports -----------------------------------------------------------------------------------------


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_edits_without_a_pause_are_one_export(spark):
    edits = spark.createDataFrame([("a", at(s)) for s in (0, 3, 7, 13, 18, 40)] + [("b", at(5)), ("b", None)], "machine string, at timestamp")
    found = exports.export_sessions(edits)
    assert shown(found.select("machine", "first_edit", "last_edit", "edits", "export_at")) == [
        ("a", at(0), at(7), 3, at(12)), ("a", at(13), at(18), 2, at(23)), ("a", at(40), at(40), 1, at(45)), ("b", at(5), at(5), 1, at(10))
    ]
    closed = exports.flushed(found, F.lit(at(42)))
    assert {(r.machine, r.export_at, r.flushed) for r in closed.where("first_edit >= '2024-01-01 00:00:12'").collect()} == {("a", at(23), False), ("a", at(42), True)}


def test_a_stream_of_edits_exports_once_they_have_paused(spark, tmp_path):
    source = tmp_path / "edits"
    source.mkdir()

    def put(name, *seconds):
        (source / name).write_text("\n".join(json.dumps({"machine": "a", "at": at(s).isoformat()}) for s in seconds))
        edits = spark.readStream.schema("machine string, at timestamp").json(f"file://{source}")
        runs = exports.export_sessions(edits, watermark="10 seconds")
        runs.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
        return shown(spark.read.schema("machine string, first_edit timestamp, last_edit timestamp, edits long, export_at timestamp").parquet(f"file://{tmp_path}/out"))

    assert put("1.json", 0, 3) == []
    assert put("2.json", 6, 30) == [("a", at(0), at(6), 3, at(11))]
    assert put("3.json", 31, 100) == [("a", at(0), at(6), 3, at(11)), ("a", at(30), at(31), 2, at(36))]


# -- files in tasks ----------------------------------------------------------------------------------


def test_contents_of_candidates_only_block_by_block(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3000)
    (tmp_path / "b").write_bytes(b"")
    paths = [(1, f"{tmp_path}/a"), (2, f"file://{tmp_path}/a"), (3, f"{tmp_path}/b"), (4, f"{tmp_path}/none"), (5, None), (1, f"{tmp_path}/a"), (6, str(tmp_path))]
    found = in_tasks.content_hashes(spark.createDataFrame(paths, "id long, path string"), block=1000)
    got = sorted((r.id, r.sha256, r.bytes, r.error is None) for r in found.collect())
    a, b = hashlib.sha256(b"x" * 3000).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got[:4] == [(1, a, 3000, True), (1, a, 3000, True), (2, a, 3000, True), (3, b, 0, True)]
    assert got[4:] == [(4, None, None, False), (5, None, None, True), (6, None, None, False)]
    assert in_tasks.content_hashes(spark.createDataFrame([], "path string")).count() == 0


def test_a_large_file_takes_little_memory(tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(1 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    store, at = in_tasks.opened(str(path))
    digest = in_tasks.digest(store, at)
    assert digest == (hashlib.file_digest(open(path, "rb"), "sha256").hexdigest(), 1 << 30)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 32 << 10  # KiB


def test_a_listing_by_tasks_equals_the_drivers(spark, tmp_path):
    r = random.Random(2)
    folders = [tmp_path]
    for i in range(30):
        folders.append(r.choice(folders) / f"d{i}")
        folders[-1].mkdir()
    for i in range(80):
        (r.choice(folders) / f"{i}.{r.choice(['jpg', 'mp4', 'txt', 'JPG'])}").write_bytes(b"x" * i)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.jpg").write_bytes(b"x")
    media, found = in_tasks.listing_in_tasks(spark, f"file://{tmp_path}")
    want = files.listing(spark, f"file://{tmp_path}")
    columns = ("root", "rel_path", "filename", "type", "size")
    # Spark's file source, which the driver lists with, passes empty files over
    assert shown(media.select(*columns).where("size > 0")) == shown(want.select(*columns)) and media.count() > 20
    assert shown(found.select("rel_path")) == shown(files.folders(spark, f"file://{tmp_path}").select("rel_path"))
    os.symlink(tmp_path, folders[3] / "round")  # leads back to the root
    os.symlink(folders[5], tmp_path / "again")
    media, found = in_tasks.listing_in_tasks(spark, str(tmp_path))
    assert "again" in {r.rel_path for r in found.collect()} and not any("round" in r.rel_path for r in found.collect())
    assert [tuple(r)[1:] for r in in_tasks.listing_in_tasks(spark, f"{tmp_path}/none")[1].select("root", "rel_path").collect()] == [("",)]
