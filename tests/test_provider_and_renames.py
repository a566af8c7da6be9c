import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import rename
from mediaquarry.operators.provider import DIRECTORY, traversed

ENTRIES = "document_id string, parent_id string, name string, mime string, size long, last_modified long"


def walk(entries, root):
    """Level by level, one folder after the other."""
    below = defaultdict(list)
    for e in entries:
        if e[0] is not None and e[2] is not None and not e[2].startswith("."):
            below[e[1]].append(e)
    paths, frontier = {root: ""}, [root]
    while frontier:
        found = defaultdict(list)
        for parent in frontier:
            for e in below[parent]:
                if e[3] == DIRECTORY and e[0] not in paths:
                    found[e[0]].append((parent, e[2]))
        for d, ways in found.items():
            parent, name = min(ways)
            paths[d] = f"{paths[parent]}/{name}".lstrip("/")
        frontier = list(found)
    media, folders = [], set()
    for parent, folder in paths.items():
        for e in below[parent]:
            path = f"{folder}/{e[2]}" if folder else e[2]
            if e[3] == DIRECTORY:
                folders.add(path)
            elif e[2].endswith(".jpg") or (e[3] or "").startswith("video/"):
                media.append((e[0], path, "photo" if e[2].endswith(".jpg") else "video", e[4] or 0, e[5] or 0))
    return sorted(media), sorted(folders)


def found(spark, entries, root="r"):
    media, folders = traversed(spark.createDataFrame(entries, ENTRIES), root)
    return sorted(tuple(r) for r in media.collect()), sorted(r.rel_path for r in folders.collect())


def test_a_tree_with_cycles_orphans_hidden_and_nameless_entries(spark):
    entries = [
        ("a", "r", "A", DIRECTORY, None, None), ("b", "a", "B", DIRECTORY, None, None), ("r", "b", "home", DIRECTORY, None, None), ("a", "a", "self", DIRECTORY, None, None),
        ("x", "y", "X", DIRECTORY, None, None), ("y", "x", "Y", DIRECTORY, None, None), ("h", "r", ".hidden", DIRECTORY, None, None), ("p0", "h", "no.jpg", None, 1, 1),
        ("p1", "b", "1.jpg", "image/jpeg", 5, 9), ("p2", "r", "2.bin", "video/x", None, None), ("p3", "y", "3.jpg", None, 1, 1), ("p4", "a", None, "image/png", 1, 1),
        (None, "a", "5.jpg", None, 1, 1), ("p6", "a", "6.txt", "text/plain", 1, 1), ("p7", "lost", "7.jpg", None, 1, 1), ("b", "r", "B2", DIRECTORY, None, None), ("p1", "r", "again.jpg", None, 5, 9),
    ]
    assert found(spark, entries) == walk(entries, "r")
    assert ("p1", "B2/1.jpg", "photo", 5, 9) in found(spark, entries)[0]  # the shorter way wins
    assert found(spark, []) == ([], [])


@pytest.mark.parametrize("seed", range(2))
def test_random_trees(spark, seed):
    r = random.Random(seed)
    dirs = [f"d{i}" for i in range(25)]
    entries = [(d, r.choice(dirs), f"n{r.randrange(9)}", DIRECTORY, None, None) for d in dirs for _ in range(r.choice([1, 1, 1, 2]))]
    entries += [(f"f{i}", r.choice(dirs), f"{i}.jpg", None, i, i % 7) for i in range(60)]
    assert found(spark, entries, "d0") == walk(entries, "d0")


def test_a_deep_tree(spark):
    entries = [(f"d{i + 1}", f"d{i}", f"n{i}", DIRECTORY, None, None) for i in range(9)] + [("f", "d9", "f.jpg", None, 1, 1)]
    assert found(spark, entries, "d0") == walk(entries, "d0")


# -- renames -------------------------------------------------------------------------------------------


def played(files, steps):
    """Files by path after the steps of all groups, which must never meet a name in use; groups in any order."""
    files = dict(files)
    for row in sorted(steps, key=lambda x: (x[0], x[1])):
        src, dst = row[-2].lower(), row[-1].lower()
        assert src in files and (dst == src or dst not in files), row
        files[dst] = files.pop(src)
    return files


PLAN = "id long, old_path string, new_path string, status string"


def plan_of(pairs):
    return [(i, old, new, "ok") for i, (old, new) in enumerate(pairs, 1)]


CASES = {
    "swap": [("t/a.jpg", "t/b.jpg"), ("t/b.jpg", "t/a.jpg")],
    "circle and chain": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("h", "i")],
    "case only": [("t/a.JPG", "t/a.jpg"), ("t/b.jpg", "t/A2.jpg")],
    "letters of another case": [("A.jpg", "b.jpg"), ("B.jpg", "a.jpg")],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_schedules_never_meet_a_name_in_use(spark, name):
    rows = plan_of(CASES[name])
    steps = [tuple(r) for r in rename.rename_schedule(spark.createDataFrame(rows, PLAN)).collect()]
    files = {old.lower(): i for i, old, _, _ in rows}
    assert played(files, steps) == {new.lower(): i for i, _, new, _ in rows}


def test_kinds_turns_and_temporary_names(spark):
    rows = plan_of(CASES["circle and chain"])
    steps = sorted(tuple(r) for r in rename.rename_schedule(spark.createDataFrame(rows, PLAN)).collect())
    assert [s for s in steps if s[0] == 1] == [(1, 0, 1, "cycle", "a", ".rename-1"), (1, 1, 3, "cycle", "c", "a"), (1, 2, 2, "cycle", "b", "c"), (1, 3, 1, "cycle", ".rename-1", "b")]
    assert [(s[1], s[2], s[3]) for s in steps if s[0] == 6] == [(0, 6, "chain"), (1, 5, "chain"), (2, 4, "chain")]
    assert [(s[1], s[2], s[3]) for s in steps if s[0] == 7] == [(0, 7, "single")]


def test_a_failed_step_is_rolled_back(spark):
    rows = plan_of(CASES["circle and chain"])
    schedule = rename.rename_schedule(spark.createDataFrame(rows, PLAN)).cache()
    files = {old: i for i, old, _, _ in rows}
    steps = sorted(tuple(r) for r in schedule.collect())
    for group, length in ((1, 4), (6, 3), (7, 1)):
        for turn in range(length):
            done = played(files, [s for s in steps if s[0] == group and s[1] < turn])
            back = rename.rolled_back(schedule, spark.createDataFrame([(group, turn)], "step_group long, turn long"))
            assert played(done, [tuple(r) for r in back.collect()]) == files


def test_random_permutations_in_one_folder(spark):
    r = random.Random(3)
    names = [f"f{i}" for i in range(60)]
    pairs = [(a, b) for a, b in zip(names, r.sample(names + [f"g{i}" for i in range(20)], 60), strict=True) if a != b]
    # who keeps a name must not be in the way
    kept = set(names) - {a for a, _ in pairs}
    pairs = [(a, b) for a, b in pairs if b not in kept]
    while True:
        stay = {a for a in names} - {a for a, _ in pairs}
        fine = [(a, b) for a, b in pairs if b not in stay]
        if fine == pairs:
            break
        pairs = fine
    rows = plan_of(pairs)
    steps = [tuple(x) for x in rename.rename_schedule(spark.createDataFrame(rows, PLAN)).collect()]
    assert played({a: i for i, a, _, _ in rows}, steps) == {b: i for i, _, b, _ in rows}


def test_several_files_need_numbers(spark):
    media = spark.createDataFrame([(1, "a/x.jpg", "/l", True, 1), (2, "a/y.mp4", "/l", True, 1)], "id long, rel_path string, root string, present boolean, size long")
    chosen = spark.createDataFrame([(1, 0), (2, 1)], "id long, pos int")
    assert {r.status for r in rename.numbered_plan(media, chosen, "n", number=False).collect()} == {"several files need numbers so that their names differ"}
    assert {(r.new_path, r.status) for r in rename.numbered_plan(media, chosen, " n ").collect()} == {("a/n1.jpg", "ok"), ("a/n2.mp4", "ok")}
    assert [(r.new_path, r.status) for r in rename.numbered_plan(media, chosen.where("id = 1"), "n", number=False).collect()] == [("a/n.jpg", "ok")]
