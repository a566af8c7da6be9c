import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.llm.line_dedup import line_dedup, probes, within_edits, without_lines


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def mutated(r, text, most):
    text = list(text)
    for _ in range(r.randint(0, most)):
        i, what = r.randint(0, len(text)), r.random()
        if what < 0.35:
            text.insert(i, r.choice("abcdé "))
        elif text and what < 0.7:
            text.pop(i % len(text))
        elif text:
            text[i % len(text)] = r.choice("abcdé ")
    return "".join(text)


def test_bit_parallel_distance_equals_the_table(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(600):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        pairs.append((a, mutated(r, a, 4)))
    table = spark.createDataFrame(pairs, "a string, b string")
    for t in (0, 1, 2, 3):
        got = table.select("a", "b", within_edits(F.col("a"), F.col("b"), t).alias("near")).collect()
        assert [x.near for x in got] == [edits(x.a, x.b) <= t for x in got]


def brute(rows, t, max_words=0, words_per_edit=5):
    """Every pair of distinct lines compared: by words where the shorter one has enough, else by characters."""
    occurrences = sorted(((i is None, i or 0, no, k), line) for k, (i, text) in enumerate(rows) for no, line in enumerate((text or "").split("\n")))
    first = {}
    for at, line in occurrences:
        first.setdefault(line, at)
    lines = [x for x in first if x.strip(" \t\r\x0b\x0c")]

    def near(a, b):
        p, q = a.split(" "), b.split(" ")
        limit = min(max_words, min(len(p), len(q)) // words_per_edit)
        if limit:
            return abs(len(p) - len(q)) <= limit and edits(p, q) <= limit
        return abs(len(a) - len(b)) <= t and edits(a, b) <= t

    later = {b for a in lines for b in lines if first[a] < first[b] and near(a, b)}
    out = []
    for k, (i, text) in enumerate(rows):
        own = (text or "").split("\n")
        gone = [no for no, x in enumerate(own) if x.strip(" \t\r\x0b\x0c") and (x in later or first[x] != (i is None, i or 0, no, k))]
        out.append((i, len(own), len(gone), gone))
    return sorted(out, key=str)


def run(table, **settings):
    return sorted((tuple(x) for x in line_dedup(table, **settings).collect()), key=str)


@pytest.mark.parametrize("t, hot_lines", [(1, 1000), (2, 2)])
def test_character_edits_against_brute_force(docs, t, hot_lines):
    r = random.Random(t)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(10, 40))) for _ in range(10)]
    rows = [(d, "\n".join(mutated(r, r.choice(base), 3) if r.random() < 0.85 else r.choice(["", " ", "x"]) for _ in range(r.randint(0, 8)))) for d in range(50)]
    rows += [(60, None), (None, rows[3][1]), (5, rows[5][1]), (61, "\n".join(["q" * 5000, "q" * 4999]))]
    assert run(docs(rows).coalesce(1), max_edits=t, max_words=0, hot_lines=hot_lines) == brute(rows, t)


@pytest.mark.parametrize("t", [1, 2])
def test_lines_of_one_to_fifteen_characters(docs, t):
    r = random.Random(10 + t)
    rows = [(d, "\n".join("".join(r.choice("abcdefghijk ") for _ in range(r.randint(1, 15))) for _ in range(r.randint(1, 4)))) for d in range(60)]
    rows += [(100 + n, "\n".join(["x" * n, "y" * n, "x" * (n - 1) + "z"])) for n in range(1, 6)]
    rows += [(200, "fifteen letters"), (201, "fifteen lettexs")]
    found = run(docs(rows).coalesce(1), max_edits=t)
    assert found == brute(rows, t, max_words=2)
    assert (201, 1, 1, [0]) in found


def test_lookups_are_as_few_as_the_partition_allows():
    assert [len(probes(t)) for t in (0, 1, 2, 3)] == [1, 4, 12, 26]


def test_plan_cleaning_and_empty_table(docs):
    table = docs([(1, "a line of some length\nsecond"), (2, "a line of some lengths\nother"), (3, None)])
    verdict = line_dedup(table)
    plan = verdict._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert {r.doc_id: r.text for r in without_lines(table, verdict).collect()} == {1: "a line of some length\nsecond", 2: "other", 3: None}
    assert without_lines(table, verdict).columns == table.columns
    assert line_dedup(docs([])).count() == 0


def test_swapped_and_dropped_words(docs):
    """Against brute force: as many word edits as the shorter line's words allow, else character edits."""
    r = random.Random(7)
    word = ["alpha", "of", "é", "gamma", "", "delta", "x", "epsilon"]
    base = [" ".join(r.choice(word) for _ in range(n)) for n in (2, 4, 5, 6, 9, 9, 10, 11, 12, 25)]

    def changed(line):
        ws = line.split(" ")
        for _ in range(r.randint(0, 3)):
            i, what = r.randrange(len(ws)), r.random()
            if what < 0.5:
                ws[i] = r.choice(word)
            elif what < 0.75 and len(ws) > 1:
                ws.pop(i)
            else:
                ws.insert(i, r.choice(word))
        return mutated(r, " ".join(ws), 1)

    rows = [(d, "\n".join(changed(r.choice(base)) for _ in range(r.randint(1, 8)))) for d in range(60)]
    for most in (1, 2, 3):
        assert run(docs(rows).coalesce(1), max_words=most) == brute(rows, 1, max_words=most)


def test_a_group_of_near_lines_is_not_expanded_into_pairs(docs):
    """Hundreds of lines that differ in one word of the same place: each leaves the join once."""
    base = [f"w{i}" for i in range(30)]
    rows = [(d, " ".join([*base[:7], f"v{d}", *base[8:]])) for d in range(400)]
    assert [x[2] for x in sorted(run(docs(rows)))] == [0] + [1] * 399


def test_the_query_finds_a_swapped_word(docs, spark, monkeypatch):
    from mediaquarry.llm import queries

    line = "the quick brown fox jumps over the lazy dog"
    table = docs([(1, line), (2, line.replace("quick", "careful")), (3, line.replace("lazy ", "")), (4, "another line that has nothing in common")])
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    assert {x.doc_id: x.n_dropped for x in queries.op5_line_dedup(spark, "").collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
