import json

import pytest
from pyspark.sql import functions as F

from mediaquarry.functions.text import safe_path
from mediaquarry.operators import moves, sync, tags
from mediaquarry.sources import settings, sync_files

MEDIA = "id long, rel_path string, root string, filename string, size long, present boolean"
LINKS = "media_id long, tag_key string, tag string, updated_at double, deleted boolean"
RECORDS = "path string, size long, tag string, updated_at double, deleted boolean, seq long"


def media(spark, *rows):
    return spark.createDataFrame([(i, p, "/lib", p.split("/")[-1], s, here) for i, p, s, here in rows], MEDIA)


def test_matching(spark):
    rows = media(spark, (1, "a/1.jpg", 3, True), (2, "b/2.jpg", 6, True), (3, "c/2.jpg", 7, True), (4, "d/gone.jpg", 5, False), (5, "e/u.jpg", 9, True))
    records = [
        ("A/1.JPG", 99, 1), ("x/2.jpg", 6, 2), ("x/2.jpg", None, None), ("d/gone.jpg", 5, None), ("x/u.jpg", None, 5), ("x/u.jpg", 8, None), ("x/none.jpg", 1, None),
    ]
    table = spark.createDataFrame([(p, s, "t", 1.0, False, i) for i, (p, s, _) in enumerate(records)], RECORDS)
    got = {r.seq: r.media_id for r in sync.matched(table, rows).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(records)}


def test_merge_sequence_and_ties(spark):
    rows = media(spark, (1, "1.jpg", 3, True))
    times = [(10.0, False), (5.0, True), (20.0, True), (15.0, False), (30.0, False), (30.0, True)]
    records = spark.createDataFrame([("1.jpg", 3, "a", t, d, i) for i, (t, d) in enumerate(times)], RECORDS)
    none = spark.createDataFrame([], LINKS)
    found = sync.matched(records, rows)
    assert [(r.updated_at, r.deleted) for r in sync.merged(none, found).collect()] == [(30.0, False)]
    assert sync.change_count(none, found).first().changed == 3
    again = sync.merged(none, found)
    assert sync.change_count(again, found).first().changed == 0


def test_held_records_are_attached_later(spark):
    records = spark.createDataFrame([("n.jpg", 1, "A", 5.0, False, 0), ("N.jpg", 1, "a", 9.0, False, 1), ("n.jpg", 1, "a", 7.0, True, 2)], RECORDS)
    nothing = spark.createDataFrame([], "path string, tag string, updated_at double, deleted boolean")
    pending = sync.held(nothing, sync.matched(records, media(spark, (1, "other.jpg", 2, True))))
    assert [(r.updated_at, r.deleted) for r in pending.collect()] == [(9.0, False)]
    links, rest = sync.attached(spark.createDataFrame([], LINKS), pending, media(spark, (7, "n.jpg", 1, True)))
    assert [(r.media_id, r.tag_key) for r in links.collect()] == [(7, "a")] and rest.count() == 0
    links, rest = sync.attached(spark.createDataFrame([], LINKS), pending, media(spark, (7, "n.jpg", 1, False)))
    assert links.count() == 0 and rest.count() == 1


def test_relink_needs_one_of_each(spark):
    rows = media(spark, (1, "a/x.jpg", 3, False), (2, "b/X.jpg", 3, True), (3, "a/y.jpg", 3, False), (4, "b/y.jpg", 3, True), (5, "c/y.jpg", 3, True), (6, "a/z.jpg", 1, False), (7, "b/z.jpg", 1, True))
    links = spark.createDataFrame([(1, "t", "t", 1.0, True), (3, "t", "t", 1.0, False), (2, "t", "t", 0.5, False)], LINKS)
    assert [(r.old_id, r.new_id) for r in sync.relinks(rows, links).collect()] == [(1, 2)]
    left, moved = sync.relinked(rows, links)
    assert 1 not in {r.id for r in left.collect()}
    assert {(r.media_id, r.deleted) for r in moved.collect()} == {(2, True), (3, False)}


@pytest.mark.parametrize(("path", "fine"), [("a/b.jpg", True), (".hid/x", True), ("", False), ("/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("c:x", False), ("a\\b", False), ("x" * 1025, False), (None, False), ("a/", False)])
def test_safe_paths(spark, path, fine):
    assert spark.createDataFrame([(path,)], "p string").select(safe_path(F.col("p"))).first()[0] is fine


def _move(i, src, dst, size=1, at=None):
    return (src, dst, size, float(i) if at is None else at, i)


def _replay(spark, rows, steps, log=()):
    kind = "from_path string, to_path string, size long, moved_at double"
    table = spark.createDataFrame(rows, "id long, rel_path string, size long, present boolean")
    outcomes, changes = moves.replayed(table, spark.createDataFrame(steps, kind + ", n long").withColumn("seq", F.struct("moved_at", "n")).drop("n"), spark.createDataFrame(list(log), kind))
    found = sorted((json.loads(r.key)["n"], r.outcome) for r in outcomes.collect())
    return [o for _, o in found], {r.id: (r.rel_path, r.replaced_by) for r in changes.collect()}


def test_chained_moves_out_of_order(spark):
    outcomes, final = _replay(spark, [(1, "a/1.jpg", 1, True)], [_move(0, "b/1.jpg", "c/1.jpg", at=2.0), _move(1, "a/1.jpg", "b/1.jpg", at=1.0)])
    assert outcomes == ["applied", "applied"] and final == {1: ("c/1.jpg", None)}


def test_move_decisions(spark):
    rows = [(1, "a/1.jpg", 1, True), (2, "a/2.jpg", 1, True), (3, "old/3.jpg", 4, False), (4, "new/3.jpg", 4, True)]
    steps = [
        _move(0, "../x", "b"), _move(1, "a/1.jpg", "a/1.jpg"), _move(2, "a/1.jpg", "b/9.jpg"), _move(3, "a/1.jpg", "b/1.jpg"), _move(4, "none/1.jpg", "b/1.jpg"),
        _move(5, "a/1.jpg", "c/1.jpg", size=5), _move(6, "a/2.jpg", "a/1.jpg"), _move(7, "old/3.jpg", "new/3.jpg", size=4), _move(8, "a/2.jpg", "a/two.jpg"),
    ]
    outcomes, final = _replay(spark, rows, steps, [("a/1.jpg", "b/1.jpg", 1, 3.0)])
    assert outcomes == ["skipped: malformed record", "unchanged", "skipped: move and rename in one", "known", "absent", "skipped: a different file", "skipped: destination occupied", "relinked", "applied"]
    assert final == {3: ("old/3.jpg", 4), 2: ("a/two.jpg", None)}


def test_a_swap_can_not_be_replayed(spark):
    outcomes, final = _replay(spark, [(1, "a/x.jpg", 1, True), (2, "b/x.jpg", 1, True)], [_move(0, "a/x.jpg", "b/x.jpg"), _move(1, "b/x.jpg", "a/x.jpg")])
    assert outcomes == ["skipped: destination occupied"] * 2 and final == {}


def test_documents_round_trip_and_bad_files(spark, tmp_path):
    rows = media(spark, (1, "a/1.jpg", 3, True), (2, "b.jpg", 6, True), (3, "c.jpg", 6, False))
    links = spark.createDataFrame([(1, "b", "B", 2.0, True), (1, "a", "A", 1.0, False), (3, "a", "A", 1.0, False)], LINKS)
    log = spark.createDataFrame([("x", "y", 1, 1e9), ("p", "q", 1, 1.0)], "from_path string, to_path string, size long, moved_at double")
    sync_files.write_document(rows, links, log, f"file://{tmp_path}", "me", 1e9 + 5)
    stored = json.loads((tmp_path / "sync-me.json").read_text())
    assert [t["name"] for t in stored["media"][0]["tags"]] == ["A", "B"] and len(stored["media"]) == 1
    assert stored["moves"] == [{"from": "x", "to": "y", "size": 1, "at": 1e9}]
    (tmp_path / "sync-broken.json").write_text("{")
    (tmp_path / "sync-alien.json").write_text('{"format": "other", "version": 1, "machine_id": "x"}')
    (tmp_path / "sync-future.json").write_text(json.dumps(stored | {"version": 99}))
    bad = {"name": "", "updated_at": 1.0}, {"name": "x", "updated_at": None}, {"name": " ok  then ", "updated_at": 4.0}
    (tmp_path / "sync-other.json").write_text(json.dumps(stored | {"machine_id": "other", "media": [{"path": "../up", "size": 1, "tags": [bad[2]]}, {"path": "fine.jpg", "tags": list(bad)}]}))
    sync_files.write_document(rows, links.limit(0), log, f"file://{tmp_path}", "me", 1e9 + 6)
    assert json.loads((tmp_path / "sync-me.json").read_text())["media"] == []
    with pytest.raises(ValueError, match="bytes"):
        sync_files.write_document(rows, links, log, f"file://{tmp_path}", "me", 1e9 + 7, max_bytes=50)
    assert json.loads((tmp_path / "sync-me.json").read_text())["exported_at"] == 1e9 + 6
    assert sorted(p.name for p in tmp_path.glob("*.json")) == ["sync-alien.json", "sync-broken.json", "sync-future.json", "sync-me.json", "sync-other.json"]
    good, problems = sync_files.read_documents(spark, f"file://{tmp_path}", "me")
    assert [(r.path, r.size, r.tag, r.deleted) for r in sync.flat_records(good).collect()] == [("fine.jpg", None, "ok then", False)]
    assert sync.flat_moves(good).count() == 1
    assert sorted(r.problem for r in problems.collect()) == ["not a sync file", "not a sync file", "written by a newer version"]


def test_two_machines_converge(spark):
    a = [(1, "x", 1.0, False), (1, "y", 5.0, True)]
    b = [(1, "X", 3.0, True), (1, "y", 4.0, False)]
    kind = "media_id long, tag string, updated_at double, deleted boolean, seq long"
    one, two = (tags.resolve(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], kind)) for rows in (a, b))

    def state(links):
        return sorted((r.media_id, r.tag_key, r.updated_at, r.deleted) for r in links.collect())

    assert state(tags.apply(one, two)) == state(tags.apply(two, one))


def test_settings(spark):
    empty = spark.createDataFrame([], "key string, value string")
    held = settings.set_setting(empty, "roots", '["/a", "/b", "/a"]')
    assert [r.root for r in settings.roots(held).orderBy("pos").collect()] == ["/a", "/b"]
    messy = settings.set_setting(empty, "roots", '["/x/../a/", "/a", "/b//c/.", 5]')
    assert [r.root for r in settings.roots(messy).orderBy("pos").collect()] == ["/a", "/b/c"]
    assert settings.roots(settings.set_setting(empty, "roots", "no json")).count() == settings.roots(empty).count() == 0
    held, own = settings.machine_id(held)
    assert len(own) == 12 and int(own, 16) >= 0 and settings.machine_id(held)[1] == own
    assert settings.get_setting(held, "none", "d") == "d"


def test_relink_query_has_unique_and_ambiguous_names(spark):
    from mediaquarry.plans import catalog
    from mediaquarry.plans.catalog_queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    got = {(r.old_id, r.new_id) for r in QUERIES["relink_all_media"](spark, sf_dir).collect()}
    ids = {r.id for r in catalog.media(spark, sf_dir).select("id").collect()}
    tagged = {r.media_id for r in catalog.links(spark, sf_dir).select("media_id").distinct().collect()}
    blocks = {i // 11 for i in ids}
    old, new = {}, {}
    for i in ids:
        b, place = divmod(i, 11)
        name = (b - b % 10 if b % 5 == 0 else b) if place in (0, 10) else b if place == 1 and b % 3 == 1 else None
        if name is not None and (place != 10 or i in tagged):
            (old if place == 10 else new).setdefault((name, 2 if place != 10 and b % 7 == 3 else 1), []).append(i)
    want = {(old[k][0], new[k][0]) for k in old if len(old[k]) == 1 and len(new.get(k, [])) == 1}
    assert got == want and 0 < len(want) < len(blocks)


def _library(spark, rows, links=(), pending=()):
    table = media(spark, *rows).withColumn("album", F.regexp_replace("rel_path", "/?[^/]*$", ""))
    log = spark.createDataFrame([], "from_path string, to_path string, size long, moved_at double")
    held = spark.createDataFrame(list(pending), "path string, tag string, updated_at double, deleted boolean")
    return sync.Library(table, spark.createDataFrame(list(links), LINKS), held, log)


def _file_moves(spark, *steps):
    return spark.createDataFrame([(*s[:4], i) for i, s in enumerate(steps)], "from_path string, to_path string, size long, moved_at double, n long").withColumn("seq", F.struct("moved_at", "n")).drop("n")


def test_import_takes_moves_then_records_then_relinks_and_attaches(spark):
    library = _library(
        spark, [(1, "1.jpg", 3, True), (2, "2.jpg", 6, True), (3, "old/gone.jpg", 4, False), (4, "new/gone.jpg", 4, True)], [(3, "old", "old", 1.0, False)], [("2.JPG", "Late", 2.0, False)]
    )
    records = spark.createDataFrame([("T/1.jpg", 3, "sun", 1.0, False, 0), ("none.jpg", 1, "x", 1.0, False, 1), ("none.jpg", 1, "X", 0.5, True, 2)], RECORDS)
    steps = _file_moves(spark, ("T/1.jpg", "U/1.jpg", 3, 20.0), ("1.jpg", "T/1.jpg", 3, 10.0), ("2.jpg", "V/2.jpg", 7, 5.0))
    after, counters = sync.imported(library, records, steps)
    assert tuple(counters.first()) == (2, 1, 1, 1)
    assert {r.id: (r.rel_path, r.album) for r in after.media.collect()} == {1: ("U/1.jpg", "U"), 2: ("2.jpg", ""), 4: ("new/gone.jpg", "new")}
    assert sorted((r.media_id, r.tag) for r in after.links.collect()) == [(1, "sun"), (2, "Late"), (4, "old")]
    assert [(r.path, r.tag) for r in after.pending.collect()] == [("none.jpg", "x")]
    assert sorted(r.to_path for r in after.log.collect()) == ["T/1.jpg", "U/1.jpg"]
    again, counters = sync.imported(after, records, steps)
    assert tuple(counters.first())[2:] == (0, 0)
    off, counters = sync.imported(library, records, steps, apply_moves=False)
    assert tuple(counters.first()) == (0, 0, 1, 1)
    assert sorted((r.media_id, r.tag) for r in off.links.collect()) == [(1, "sun"), (2, "Late"), (4, "old")]


def test_an_import_works_the_links_out_once(spark):
    library = _library(spark, [(i, f"{i}.jpg", 3, True) for i in range(20)])
    rows = spark.sparkContext.accumulator(0)

    def seen(link):
        rows.add(1)
        return link

    links = spark.createDataFrame(spark.sparkContext.parallelize([(i, "a", "A", 5.0, False) for i in range(20)], 2).map(seen), LINKS)
    records = spark.createDataFrame([(f"{i}.jpg", 3, "a", 4.0 + i % 3, True, i) for i in range(20)], RECORDS)
    after, counters = sync.imported(library._replace(links=links), records, _file_moves(spark, ("1.jpg", "T/1.jpg", 3, 1.0)))
    assert tuple(counters.first()) == (1, 0, 6, 0) and after.links.where("deleted").count() == 6
    assert rows.value == 20


def test_folded_keys_of_joins_are_columns(spark):
    library = _library(spark, [(1, "1.jpg", 3, True)], [(1, "a", "A", 5.0, False)], [("2.jpg", "Late", 2.0, False)])
    records, steps = spark.createDataFrame([("1.jpg", 3, "a", 1.0, False, 0)], RECORDS), _file_moves(spark, ("1.jpg", "T/1.jpg", 3, 1.0))
    alone = moves.judged_alone(library.media, moves.checked(steps, library.log))
    tables = sync.matched(records, library.media), sync.matched_strictly(records, library.media), *sync.attached(library.links, library.pending, library.media), sync.dry_run(library, records, steps), alone
    for table in tables:
        plan = spark._jvm.PythonSQLUtils.explainString(table._jdf.queryExecution(), "simple").splitlines()
        joins = [line for line in plan if "SortMergeJoin" in line or " Sort [" in line]
        assert joins and not [line for line in joins if "translate(" in line]


def test_an_import_onto_links_that_a_move_brings_along(spark):
    library = _library(
        spark, [(3, "old/gone.jpg", 4, False), (4, "new/gone.jpg", 4, True)], [(3, "a", "A", 5.0, False), (4, "a", "a", 5.0, True), (3, "b", "b", 2.0, False), (3, "c", "c", 2.0, False)], [("none.jpg", "Y", 2.0, True)]
    )
    tagged = [("new/gone.jpg", 4, "B", 3.0, True, 2), ("new/gone.jpg", 4, "a", 5.0, False, 1), ("new/gone.jpg", 4, "c", 9.0, False, 3)]
    waiting = [("none.jpg", 1, "x", 1.0, True, 5), ("None.jpg", 1, "X", 1.0, False, 4), ("none.jpg", 1, "y", 2.0, False, 6)]
    after, counters = sync.imported(library, spark.createDataFrame(tagged + waiting, RECORDS), _file_moves(spark, ("old/gone.jpg", "new/gone.jpg", 4, 1.0)))
    assert tuple(counters.first()) == (0, 0, 1, 1)
    assert sorted(map(tuple, after.links.collect())) == [(4, "a", "a", 5.0, True), (4, "b", "b", 3.0, True), (4, "c", "c", 9.0, False)]
    # of records as new as each other the first stays, and what was held before them
    assert sorted(map(tuple, after.pending.collect())) == [("None.jpg", "X", 1.0, False), ("none.jpg", "Y", 2.0, True)]


def test_a_dry_run_judges_everything_against_what_is_there(spark):
    library = _library(spark, [(1, "1.jpg", 3, True), (2, "2.jpg", 6, True)], [(2, "sun", "sun", 5.0, False)])
    records = spark.createDataFrame([("2.jpg", 6, "Sun", 6.0, True, 0), ("2.jpg", 6, "sun", 7.0, True, 1), ("2.jpg", 6, "sun", 4.0, True, 2), ("gone.jpg", 1, "x", 1.0, False, 3), ("gone.jpg", 1, "x", 1.0, False, 4)], RECORDS)
    steps = _file_moves(spark, ("1.jpg", "T/1.jpg", 3, 1.0), ("T/1.jpg", "U/1.jpg", 3, 2.0), ("../x", "y", 1, 1.0))
    assert tuple(sync.dry_run(library, records, steps).first()) == (1, 1, 2, 2)
    assert tuple(sync.dry_run(library, records.limit(0), steps.limit(0)).first()) == (0, 0, 0, 0)


def test_lonely_moves_are_judged_as_in_a_replay(spark):
    rows = [(1, "a/1.jpg", 1, True), (2, "a/2.jpg", 1, True), (3, "old/3.jpg", 4, False), (4, "new/3.jpg", 4, True), (5, "e/5.jpg", 9, False)]
    steps = [
        _move(0, "../x", "b"), _move(1, "a/1.jpg", "b/1.jpg"), _move(2, "a/2.jpg", "c/3.jpg"), _move(3, "old/3.jpg", "new/3.jpg", size=4), _move(4, "e/5.jpg", "f/5.jpg", size=9), _move(5, None, "q"),
    ]
    outcomes, final = _replay(spark, rows, steps)
    assert outcomes == ["skipped: malformed record", "applied", "skipped: move and rename in one", "relinked", "absent", "skipped: malformed record"]
    assert final == {1: ("b/1.jpg", None), 3: ("old/3.jpg", 4)}


def test_mobile_documents(spark):
    rows = [(1, "m"), (0, "m"), (2, " "), (1, None), (1, "x" * 129), (1, "x" * 128)]
    docs = spark.createDataFrame([((v, m),) for v, m in rows], "doc struct<version: int, machine_id: string>")
    assert [len(r.doc.machine_id) for r in sync.strict_documents(docs).collect()] == [1, 128]


def test_tags_by_path(spark):
    from mediaquarry.operators import path_tags

    kind = "library string, path string, name string, updated_at double, deleted boolean"
    store = spark.createDataFrame([("L", "a.jpg", "Sun", 1.0, False), ("L", "b.jpg", "sun", 2.0, True), ("M", "a.jpg", "sun", 1.0, False)], kind)

    def state(table):
        return sorted((r.library, r.path, r.name, r.updated_at, r.deleted) for r in table.collect())

    at = spark.createDataFrame([("L", "A.jpg"), ("L", "b.jpg")], "library string, path string")
    assert state(path_tags.remove(store, at, " SUN", 9.0)) == [("L", "a.jpg", "Sun", 9.0, True), ("L", "b.jpg", "sun", 2.0, True), ("M", "a.jpg", "sun", 1.0, False)]
    assert state(path_tags.add(store, at, ["SUN", "sun", " "], 9.0)) == [("L", "A.jpg", "SUN", 9.0, False), ("L", "b.jpg", "SUN", 9.0, False), ("M", "a.jpg", "sun", 1.0, False)]
    assert state(path_tags.rename(store, "L", "sun", "SuN", 9.0))[0] == ("L", "a.jpg", "SuN", 1.0, False)
    assert state(path_tags.rename(store, "L", "sun", "moon", 9.0)) == [
        ("L", "a.jpg", "Sun", 9.0, True), ("L", "a.jpg", "moon", 9.0, False), ("L", "b.jpg", "sun", 2.0, True), ("M", "a.jpg", "sun", 1.0, False),
    ]
    with pytest.raises(ValueError):
        path_tags.rename(store, "L", "sun", " ", 9.0)
    way = spark.createDataFrame([("L", "A.JPG", "b.jpg"), ("M", "a.jpg", "A.jpg")], "library string, from_path string, to_path string")
    assert state(path_tags.moved(store, way)) == [("L", "b.jpg", "sun", 2.0, True), ("M", "a.jpg", "sun", 1.0, False)]
    files = spark.createDataFrame([(1, "L", "a.jpg", 5, True), (2, "L", "b.jpg", 6, False)], "id long, library string, rel_path string, size long, present boolean")
    assert [tuple(r) for r in path_tags.move_records(files, way, 3.0).collect()] == [("L", "A.JPG", "b.jpg", 5, 3.0)]
    assert [(r.id, r.name) for r in path_tags.by_media(files, store).collect()] == [(1, "Sun")]
    held = spark.createDataFrame([("L", "a.jpg", "sun", 3.0, True)], kind)
    new = spark.createDataFrame([("L", "a.jpg", "sun", 3.0, False), ("L", "b.jpg", "new", 1.0, False), ("L", "b.jpg", "sun", 5.0, True), ("L", "a.jpg", "x", 1.0, True)], kind)
    kept, pending, counters = path_tags.merge(store, held, files, new)
    assert tuple(counters.first()) == (3, 1)
    assert ("L", "a.jpg", "x", 1.0, True) in state(kept) and len(state(kept)) == 4
    assert state(pending) == [("L", "a.jpg", "sun", 3.0, True), ("L", "b.jpg", "new", 1.0, False), ("L", "b.jpg", "sun", 5.0, True)]


def test_a_stream_of_moves_without_repeats(spark, tmp_path):
    from mediaquarry.streaming.upsert import retained

    (tmp_path / "in").mkdir()
    rows = [{"from_path": "a", "to_path": "b", "size": 1, "moved_at": "2024-05-01T00:00:00Z"}, {"from_path": "a", "to_path": "b", "size": 1, "moved_at": "2024-05-01T00:00:00Z"}]
    rows.append(rows[0] | {"moved_at": "2024-05-02T00:00:00Z"})
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("from_path string, to_path string, size long, moved_at timestamp").json(f"file://{tmp_path}/in")
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"

    def run():
        retained(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    (tmp_path / "in" / "2.json").write_text("\n".join(map(json.dumps, [rows[0], rows[0] | {"size": 2}])))
    run()
    assert sorted((r.moved_at.day, r.size) for r in spark.read.parquet(out).collect()) == [(1, 1), (1, 2), (2, 1)]
