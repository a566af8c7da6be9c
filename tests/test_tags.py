import random

import pytest

from mediaquarry.operators import tags

SCHEMA = "media_id long, tag string, updated_at double, deleted boolean, seq long"


def table(spark, rows):
    return tags.resolve(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA))


def live(links):
    return sorted((r.media_id, r.tag) for r in links.where("not deleted").collect())


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "media_id long")


def test_first_spelling_stays_and_tombstones_block(spark):
    links = table(spark, [(1, "Beach", 1.0, False), (2, "beach", 2.0, False)])
    assert live(links) == [(1, "Beach"), (2, "Beach")]
    links = tags.apply(links, tags.remove_tag(links, ids(spark, 1), " BEACH", 5.0))
    assert live(links) == [(2, "Beach")]
    assert live(tags.apply(links, tags.add_tags(links, ids(spark, 1), ["beach"], 4.0))) == [(2, "Beach")]
    assert live(tags.apply(links, tags.add_tags(links, ids(spark, 1), ["beach"], 6.0))) == [(1, "Beach"), (2, "Beach")]


def test_rename(spark):
    links = table(spark, [(1, "old", 1.0, False), (2, "old", 1.0, False), (2, "new", 1.0, False), (3, "new", 1.0, False), (4, "old", 1.0, True)])
    merged = tags.rename_tag(links, "old", " new ", 9.0)
    assert live(merged) == [(1, "new"), (2, "new"), (3, "new")]
    assert [(r.tag, r.n) for r in tags.tag_counts(merged).collect()] == [("new", 3)]
    assert live(tags.rename_tag(links, "OLD", "Old", 9.0))[0] == (1, "Old")
    with pytest.raises(ValueError):
        tags.rename_tag(links, "old", "  ", 9.0)


def test_counts_and_lists(spark):
    links = table(spark, [(1, "both", 1.0, False), (2, "both", 1.0, False), (1, "one", 1.0, False), (9, "gone", 1.0, True)])
    assert {r.tag: r.n for r in tags.selection_tag_counts(links, ids(spark, 1, 2)).collect()} == {"both": 2, "one": 1}
    assert tags.selection_tag_counts(links, ids(spark)).count() == 0
    assert {r.media_id: r.tags for r in tags.tags_of(links).collect()} == {1: ["both", "one"], 2: ["both"]}
    assert live(tags.apply(links, tags.delete_tag(links, "both", 2.0))) == [(1, "one")]


def test_order_of_records_does_not_matter_without_ties(spark):
    r = random.Random(1)
    rows = [(r.randint(1, 4), r.choice("ab"), float(t), r.random() < 0.4) for t in r.sample(range(1000), 60)]
    want = None
    for _ in range(3):
        r.shuffle(rows)
        got = sorted((x.media_id, x.tag_key, x.updated_at, x.deleted) for x in table(spark, rows).collect())
        want = want or got
        assert got == want


def test_accepted_and_changed_follow_the_sequence(spark):
    rows = [(1, "a", 10.0, False, 0), (1, "a", 5.0, True, 1), (1, "A", 20.0, True, 2), (1, "a", 15.0, False, 3), (1, "a", 30.0, True, 4), (1, "b", 1.0, True, 5)]
    got = [(x.seq, x.accepted, x.changed) for x in tags.accepted_records(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()]
    assert got == [(0, True, True), (1, False, False), (2, True, True), (3, False, False), (4, True, False), (5, True, False)]


def test_move_tags(spark):
    links = table(spark, [(1, "a", 5.0, False), (2, "a", 5.0, True), (1, "b", 1.0, False)])
    moved = tags.move_tags(links, spark.createDataFrame([(1, 2)], "media_id long, to_id long"))
    assert sorted((r.media_id, r.tag, r.deleted) for r in moved.collect()) == [(2, "a", True), (2, "b", False)]
