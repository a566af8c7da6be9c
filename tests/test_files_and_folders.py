import json

import pytest
from pyspark.sql import functions as F

from mediaquarry.functions import text
from mediaquarry.operators import folders, rename, scan
from mediaquarry.sources import files
from mediaquarry.streaming.upsert import LinkTable, stream_into

MEDIA = "id long, root string, rel_path string, album string, filename string, type string, size long, mtime double, present boolean"


def media(spark, *rows):
    return spark.createDataFrame([(i, "/lib", p, p.rpartition("/")[0], p.split("/")[-1], "photo", 1, 1.0, here) for i, p, here in rows], MEDIA)


def value(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression).first()[0]


def test_listing_skips_hidden_and_other_files(spark, tmp_path):
    for name in ("a.jpg", "trips/2024/B.MP4", "trips/notes.txt", "trips/raw.cr2", ".hidden/x.jpg", "trips/.y.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = files.listing(spark, str(tmp_path))
    assert sorted((r.rel_path, r.type, r.size) for r in found.collect()) == [("a.jpg", "photo", 3), ("trips/2024/B.MP4", "video", 3)]
    (tmp_path / "empty" / "in").mkdir(parents=True)
    assert [r.rel_path for r in files.folders(spark, str(tmp_path)).orderBy("rel_path").collect()] == ["empty", "empty/in", "trips", "trips/2024"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert files.contents(spark, str(tmp_path / "a.jpg")).first().sha256 == "a665a45920422f9d417e4867efdc4fb8a04a1f3fff1fa07e998e86f7f7a27ae3"


def test_provider_listing(spark):
    rows = [("b", "image/png", 1, 5), ("A.jpg", None, None, 5), ("c.mp4", None, 2, None), ("d.txt", "text/plain", 1, 1), ("b", "image/png", 1, 5)]
    found = files.provider_listing(spark.createDataFrame(rows, "path string, mime string, size long, last_modified long"))
    assert [(r.rel_path, r.type, r.size, r.last_modified) for r in found.collect()] == [("A.jpg", "photo", 0, 5), ("b", "photo", 1, 5), ("c.mp4", "video", 2, 0)]
    tree = spark.createDataFrame([("b",), ("A",), ("b",), (".x/y",), ("a/c",)], "path string")
    assert [r.rel_path for r in files.provider_folders(tree).collect()] == ["A", "a/c", "b"]


def test_rescans(spark):
    disk = spark.createDataFrame([("/lib", "a.jpg", 1, 1.0), ("/lib", "t/B.mp4", 2, 1.0)], "root string, rel_path string, size long, mtime double")
    empty = media(spark).limit(0)

    def counts(listing, known):
        return tuple(scan.scan_counts(scan.scan_diff(listing, known, ["/lib"])).first())

    assert counts(disk, empty) == (2, 0, 0, 0)
    first = scan.refreshed(scan.scan_diff(disk, empty, ["/lib"]), empty, 1).cache()
    assert sorted((r.rel_path, r.album, r.type) for r in first.collect()) == [("a.jpg", "", "photo"), ("t/B.mp4", "t", "video")]
    assert counts(disk, first) == (0, 0, 0, 0)
    less = disk.where("rel_path <> 'a.jpg'")
    assert counts(less, first) == (0, 0, 1, 0)
    second = scan.refreshed(scan.scan_diff(less, first, ["/lib"]), first, 100).cache()
    assert {r.rel_path: r.present for r in second.collect()} == {"a.jpg": False, "t/B.mp4": True}
    assert counts(disk, second) == (0, 0, 0, 1)
    changed = disk.withColumn("size", F.col("size") + 1)
    assert counts(changed, first) == (0, 2, 0, 0)


def test_scans_of_one_root_leave_the_others_alone(spark):
    kind = "root string, rel_path string, size long, mtime double"
    both = spark.createDataFrame([("/A", "a.jpg", 1, 1.0), ("/B", "b.jpg", 1, 1.0)], kind)
    empty = media(spark).limit(0)
    known = scan.refreshed(scan.scan_diff(both, empty, ["/A", "/B"]), empty, 1).cache()
    listing = spark.createDataFrame([("/A", "a.jpg", 1, 1.0), ("/A", "B.JPG", 1, 1.0), ("/A", "new.jpg", 1, 1.0)], kind)
    diff = scan.scan_diff(listing, known, ["/A"])
    assert sorted((r.rel_path, r.status) for r in diff.collect()) == [("a.jpg", "same"), ("new.jpg", "added")]
    after = scan.refreshed(diff, known, 50)
    assert sorted((r.root, r.rel_path, r.present) for r in after.collect()) == [("/A", "a.jpg", True), ("/A", "new.jpg", True), ("/B", "b.jpg", True)]
    gone = scan.scan_diff(listing.limit(0), known, ["/A"])
    assert [(r.rel_path, r.status) for r in gone.collect()] == [("a.jpg", "missing")]
    twice = spark.createDataFrame([("/A", "x.jpg", 1, 1.0), ("/B", "X.jpg", 2, 1.0)], kind)
    assert [(r.root, r.status) for r in scan.scan_diff(twice, empty, ["/B", "/A"]).collect()] == [("/B", "added")]
    tree = spark.createDataFrame([("/A", "p", True), ("/B", "q", True)], "root string, rel_path string, present boolean")
    disk = spark.createDataFrame([("/A", "r")], "root string, rel_path string")
    assert sorted((r.root, r.rel_path, r.status) for r in scan.folder_diff(disk, tree, ["/A"]).collect()) == [("/A", "p", "missing"), ("/A", "r", "added")]


def test_prefix_renames(spark):
    rows = media(spark, (1, "b/x.jpg", True), (2, "a/y.mp4", True), (3, "a/Trip2.jpg", True), (4, "b/TRIP3.JPG", True))
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.id: (r.new_path, r.status) for r in rename.prefix_plan(rows, chosen, "trip").collect()}
    assert got == {3: ("a/trip1.jpg", "ok"), 2: ("a/trip2.mp4", "ok"), 1: ("b/trip3.jpg", "another file has the name")}
    for bad in ("", "a/b", "a\\b", ".", ".."):
        with pytest.raises(ValueError, match="prefix"):
            rename.prefix_plan(rows, chosen, bad)
    assert rename.prefix_plan(rows, chosen.limit(0), "t").count() == 0


def test_folder_counts_use_whole_parts(spark):
    rows = media(spark, (1, "Trip/a.jpg", True), (2, "Trips/b.jpg", True), (3, "Trips/in/c.jpg", True), (4, "Trips/d.jpg", False), (5, "50%_off/e.jpg", True), (6, "50x/f.jpg", True))
    got = {r.rel_path: r.n_media for r in folders.folder_counts(folders.folder_table(rows), rows).collect()}
    assert got == {"Trip": 1, "Trips": 2, "Trips/in": 1, "50%_off": 1, "50x": 1}


def test_relocation(spark):
    rows = media(spark, (1, "Old/a.jpg", True), (2, "old/Sub/b.jpg", False), (3, "Older/c.jpg", True))
    got = {r.id: (r.rel_path, r.album) for r in folders.relocated(rows, "/lib", "Old", "New/Place").collect()}
    assert got == {1: ("New/Place/a.jpg", "New/Place"), 2: ("New/Place/Sub/b.jpg", "New/Place/Sub"), 3: ("Older/c.jpg", "Older")}
    assert [r.from_path for r in folders.relocation_moves(rows, "/lib", "Old", "New/Place", 1.0).collect()] == ["Old/a.jpg"]


def test_folder_moves_are_checked(spark):
    known = spark.createDataFrame([("/lib", p) for p in ("A", "A/B", "C", "C/B")], "root string, rel_path string")
    asks = [("/lib", "A/B", "/lib", ""), ("/lib", "A", "/lib", "a/b"), ("/lib", "A/B", "/lib", "C"), ("/lib", "A", "/lib", "X"), ("/lib", "A", "/other", ""), ("/lib", "A/B", "/lib", "A")]
    got = [r.problem for r in folders.check_moves(known, spark.createDataFrame(asks, "root string, path string, to_root string, to_parent string").coalesce(1)).orderBy("path", "to_parent").collect()]
    assert sorted(map(str, got)) == sorted(["None", "not into itself or below", "the name is taken there", "the destination does not exist", "not between different libraries", "None"])


def test_created_folders_keep_stored_spelling(spark):
    known = spark.createDataFrame([("/lib", "Trips")], "root string, rel_path string")
    wanted = spark.createDataFrame([("/lib", " trips / 2024 \\x "), ("/lib", "con/a")], "root string, path string")
    assert sorted(r.rel_path for r in folders.created(known, wanted).collect()) == ["trips/2024", "trips/2024/x"]


def test_move_to_folder(spark):
    rows = media(spark, (1, "a/x.jpg", True), (2, "b/x.jpg", True), (3, "t/y.jpg", True), (4, "a/y.jpg", True), (5, "a/z.jpg", False))
    got = {r.id: r.outcome for r in folders.move_to_folder(rows, rows, "/lib", "t").collect()}
    assert got == {1: "moved", 2: "the name is taken there", 3: "already there", 4: "the name is taken there", 5: "file is missing"}


@pytest.mark.parametrize(
    ("name", "fine"), [("x.jpg", True), ("", False), (" x", False), (".x", False), ("a/b", False), ("a\\b", False), ("a?b", False), ("x.", False), ("COM1.jpg", False), ("a" * 201, False), ("console.jpg", True)]
)
def test_file_names(spark, name, fine):
    assert (value(spark, text.filename_problem(F.col("n")), n=name) is None) is fine


@pytest.mark.parametrize(("path", "fine"), [("Trips/2024", True), (" a \\ b ", True), ("//", False), (".x", False), ("a/nul", False), ("a/b.", False), ("a<b", False), ("x" * 121, False)])
def test_album_names(spark, path, fine):
    assert (value(spark, text.album_problem(F.col("p")), p=path) is None) is fine


def test_rename_plan(spark):
    rows = media(spark, (1, "t/a.jpg", True), (2, "t/b.jpg", True), (3, "t/c.jpg", True), (4, "t/d.jpg", False), (5, "t/e.jpg", True))
    names = [(1, 0, "b.jpg"), (2, 1, "a.jpg"), (3, 2, "C2.jpg"), (5, 3, "c2.jpg"), (4, 4, "q.jpg")]
    plan = rename.rename_plan(rows, spark.createDataFrame(names, "id long, pos int, new_name string"))
    assert {r.id: r.status for r in plan.collect()} == {1: "ok", 2: "ok", 3: "ok", 5: "two files would get the same name", 4: "file is missing"}
    taken = rename.rename_plan(rows, spark.createDataFrame([(1, 0, "C.jpg"), (2, 1, "d.jpg"), (3, 2, "c.jpg")], "id long, pos int, new_name string"))
    assert {r.id: r.status for r in taken.collect()} == {1: "the name is taken", 2: "an older record has that name", 3: "unchanged"}
    swap = rename.rename_plan(rows, spark.createDataFrame(names[:2], "id long, pos int, new_name string"))
    assert rename.is_applicable(swap).first().ok
    assert {r.id: r.rel_path for r in rename.renamed(rows, swap).collect()}[1] == "t/b.jpg"
    assert rename.rename_moves(rows, swap, 5.0).count() == 2


def test_numbered_names(spark):
    rows = spark.createDataFrame([(1, 0, "p.jpg"), (2, 1, "q.tar.gz"), (3, 1991, "none")], "id long, pos int, filename string")
    assert [r.new_name for r in rename.numbered_names(rows, "x", 9, 3).orderBy("id").collect()] == ["x009.jpg", "x010.gz", "x2000"]


def test_small_functions(spark):
    c = F.col("c")
    assert value(spark, text.parse_names(c), c=" Beach , beach,  sun  set,,") == ["Beach", "sun set"]
    assert value(spark, text.fold_ascii(c), c="ÜBer") == "Über"
    assert [value(spark, text.extension(c), c=x) for x in ("a.b.c", ".jpg", "..x.y", "none", "a.")] == [".c", "", ".y", "", "."]
    assert [value(spark, text.dirname(c), c=x) for x in ("a/b/c", "c", "")] == ["a/b", "", ""]
    assert value(spark, text.human_size(c), c=1536) == "1.5 KB"
    assert value(spark, text.luma(F.lit(255), F.lit(255), F.lit(255)), c=1) == 255
    assert [value(spark, text.in_folder(c, "Trips"), c=x) for x in ("TripsOld", "trips/x", "Trips")] == [False, True, True]
    assert folders.root_problem(["/a/b"], "/a/b/c") == "inside /a/b" and folders.root_problem(["/a/b"], "/a") == "contains /a/b" and folders.root_problem(["/a"], "/ab") is None


def test_stream_of_records(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    table = LinkTable(spark, f"file://{tmp_path}/links")

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("media_id", "tag", "updated_at", "deleted", "seq"), r, strict=True))) for r in rows))
        stream_into(spark, f"file://{source}", table, f"file://{tmp_path}/state").awaitTermination()

    put("1.json", (1, "Beach", 5.0, False, 0), (2, "sun", 1.0, False, 1))
    put("2.json", (1, "beach", 4.0, True, 0), (2, "sun", 9.0, True, 1))
    assert sorted((r.media_id, r.tag, r.deleted) for r in table.read().collect()) == [(1, "Beach", False), (2, "sun", True)]
