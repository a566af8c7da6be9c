"""Line dedup by a segment-partition edit join, in DataFrame operations only.

If two lines are within t edits, and the shorter one is cut into t + 1 segments, one segment occurs unchanged
in the longer one, near its place. Every distinct line therefore files its segments under (length,
segment number, segment), and looks up, for each length from its own down to t less, the substrings that
could be such a segment; the places are those that leave room for no more than t edits on both sides. A
segment of a line shorter than t + 1 can be empty: then all lines of that length meet.

The edits of a pair are counted in words, and t grows with the number of words of the shorter line; lines too
short for a word edit are compared by characters.

Only keys under which different lines meet go on. Lines that meet are compared within the join: a 64-bit
parity of the words, of which an edit changes two bits at most (three, if it is one character that joins or
splits words), sorts out most pairs, the others are verified by a bit-parallel edit distance over a
band of 2 t + 1 diagonals. The join is a semi join: a line leaves it once, when an earlier near line is
found, so groups of near lines are not expanded into pairs.

Equal lines are folded before the join, so a line that is everywhere is one line there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.llm.common import materialise, text_of

#: Most lines there can be whose verdicts are broadcast.
_HOT = 100_000


def segment(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of a segment: as even as can be, the longer ones last."""
    base, extra = F.floor(length / parts), length % parts
    late = parts - extra
    return number * base + F.greatest(F.lit(0), number - late), base + (number >= late).cast("int")


def probes(max_edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment number, offset from the segment's start) of every lookup."""
    out = []
    for shorter in range(max_edits + 1):
        for i in range(max_edits + 1):
            low, high = max(-i, shorter - (max_edits - i)), min(i, shorter + (max_edits - i))
            out += [(shorter, i, offset) for offset in range(low, high + 1)]
    return out


def _key(line: Column, length: Column, number: int, offset: int, parts: int) -> Column:
    start, size = segment(length, number, parts)
    at = start + offset
    return F.when(at >= 0, F.xxhash64(length, F.lit(number), F.substring(line, (at + 1).cast("int"), size.cast("int"))))


def _word_key(words: Column, count: Column, number: int, offset: int, parts: int) -> Column:
    start, size = segment(count, number, parts)
    at = start + offset
    return F.when(at >= 0, F.xxhash64(F.lit(-1 - number), count, F.slice(words, (at + 1).cast("int"), size.cast("int"))))


def word_limit(count: Column, max_words: int, words_per_edit: int) -> Column:
    """Word edits allowed for a pair of lines whose shorter one has ``count`` words."""
    return F.least(F.lit(max_words), F.floor(F.greatest(count, F.lit(0)) / words_per_edit).cast("int"))


def parity(words: Column) -> Column:
    """64 bits, each the parity of how often the words of its class occur; ``words`` are hashes."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def within_edits(pattern: Column, text: Column, max_edits: int) -> Column:
    """Whether two lines are within ``max_edits`` edits, by a banded bit-parallel edit distance.

    Bit B - 1 - x of a word of B = 2 t + 1 bits stands for the row x below the top diagonal of the band.
    ``plus`` and ``minus`` mark vertical steps of +1 and -1 in the last column, ``top`` is the distance on
    the top diagonal; rows past the pattern count as characters that match nothing.
    """
    near = F.abs(F.length(pattern) - F.length(text)) <= max_edits
    return _within(F.split(pattern, ""), F.split(text, ""), near, max_edits, F.lit(max_edits))


def within_word_edits(pattern: Column, text: Column, max_words: int, words_per_edit: int) -> Column:
    """Whether two lines are within the word edits that the shorter one's number of words allows."""
    p, q = F.split(pattern, " "), F.split(text, " ")
    limit = word_limit(F.least(F.size(p), F.size(q)), max_words, words_per_edit)
    return _within(p, q, F.abs(F.size(p) - F.size(q)) <= limit, max_words, limit)


def _within(pattern: Column, text: Column, near: Column, t: int, limit: Column) -> Column:
    """Whether two arrays are within ``limit`` <= t edits; ``near`` says that their sizes are."""
    width = 2 * t + 1
    full = (1 << width) - 1
    one = F.lit(1).cast("long")

    def inverse(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full).cast("long"))

    def walk(p: Column, q: Column) -> Column:
        def column(state: Column, j: Column) -> Column:
            own = F.get(q, j)
            rows = [F.when((j + t - x >= 0) & (F.get(p, F.greatest(j + t - x, F.lit(0))) == own), F.lit(1 << (width - 1 - x)).cast("long")).otherwise(F.lit(0).cast("long")) for x in range(width)]
            same = reduce(lambda a, b: a.bitwiseOR(b), rows)

            def after(s: Column) -> Column:
                eq, plus, minus = s["eq"], state["plus"], state["minus"]
                diagonal = (eq.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(eq).bitwiseOR(minus).bitwiseAND(F.lit(full).cast("long"))
                return _let(diagonal, next_state)

            def next_state(d0: Column) -> Column:
                plus, minus = state["plus"], state["minus"]
                right_plus = minus.bitwiseOR(inverse(d0.bitwiseOR(plus)))
                right_minus = d0.bitwiseAND(plus)
                moved = F.shiftright(d0, 1)
                return F.struct(
                    right_minus.bitwiseOR(inverse(moved.bitwiseOR(right_plus))).alias("plus"),
                    moved.bitwiseAND(right_plus).alias("minus"),
                    (state["top"] + 1 - F.shiftright(d0, width - 1)).cast("long").alias("top"),
                )

            return _let(F.struct(same.alias("eq")), after)

        start = F.struct(
            F.lit(((1 << (t + 1)) - 1) << (width - t - 1)).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), F.lit(t).cast("long").alias("top")
        )
        n, m = F.size(q), F.size(p)

        def distance(end: Column) -> Column:
            # from the top diagonal's row n + t down to row m, over the steps between them
            between = F.lit(full >> 1).cast("long").bitwiseXOR(F.call_function("shiftright", F.lit(full >> 1).cast("long"), n + t - m))
            return end["top"] - F.bit_count(end["plus"].bitwiseAND(between)) + F.bit_count(end["minus"].bitwiseAND(between))

        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, column, distance)

    both = F.struct(pattern.alias("p"), text.alias("q"))
    return near & F.when(near, _let(both, lambda s: walk(s["p"], s["q"])) <= limit).otherwise(False)


def near_lines(x: Column, y: Column, max_edits: int, max_words: int, words_per_edit: int) -> Column:
    """Whether two lines are near; their number of words says how edits are counted."""
    fewer = F.least(F.size(F.split(x, " ")), F.size(F.split(y, " ")))
    by_letters = word_limit(fewer, max_words, words_per_edit) == 0
    return F.when(by_letters, within_edits(x, y, max_edits)).otherwise(within_word_edits(x, y, max_words, words_per_edit) if max_words else F.lit(False))


def line_dedup(
    docs: DataFrame,
    *,
    max_edits: int = 1,
    max_words: int = 2,
    words_per_edit: int = 5,
    hot_lines: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Which lines of each document repeat an earlier line: id, n_lines, n_dropped, dropped (line numbers from 0).

    Lines are what stands between line feeds. Of equal lines the first occurrence stays: the smallest id
    (null last), then the smallest line number. A line is also dropped, with all its occurrences, if a near
    line occurs before it; so the earliest line of every group of near lines stays. Lines are near if they are
    within t word edits (words swapped, dropped or added, between single spaces), where t is one for every
    ``words_per_edit`` words of the shorter of the two, ``max_words`` at most; where that is none, if they are
    within ``max_edits`` character edits, however short they are. Blank lines are never dropped. A null text is the
    empty text, one blank line. Null ids are kept; repeated rows are rows of their own, of which the later
    lose their lines; an empty table gives an empty result; other columns are not read. Lines that occur
    ``hot_lines`` times or more find their verdict without a shuffle; this changes no result.
    """
    def looks(t: int) -> list[tuple[int, int, int]]:
        """Lookups besides those of a line's own segments, which are filed under the same keys."""
        return [(shorter, i, offset) for shorter, i, offset in probes(t) if shorter or offset]

    def limit(n: Column) -> Column:
        return word_limit(n, max_words, words_per_edit)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    lines = rows.select("row", "id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    # most lines are told by their first character
    blank = (F.ascii("line") <= 32) & (F.btrim("line", F.lit(" \t\r\x0b\x0c")) == "")
    # two hashes stand for a line
    own = (F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("g"))
    occurrences = materialise(lines.select("row", "id", "no", *own, blank.alias("blank")), "lines")

    line, length, words, count = F.col("line"), F.length("line"), F.col("words"), F.size("words")
    parts = max_edits + 1
    filed = [F.when(limit(count) == 0, _key(line, length, i, 0, parts)) for i in range(parts)]
    asked = [F.when((limit(count - max_edits) == 0) & (length > s), _key(line, length - s, i, o, parts)) for s, i, o in looks(max_edits)]
    # a line has one number of word edits, so its word segments share columns
    for i in range(max_words + 1 if max_words else 0):
        filed.append(F.coalesce(*[F.when(limit(count) == t, _word_key(words, count, i, 0, t + 1)) for t in range(max(i, 1), max_words + 1)]))
    for t in range(1, max_words + 1):
        asked += [F.when(limit(count - s) == t, _word_key(words, count - s, i, o, t + 1)) for s, i, o in looks(t)]
    # keys are read off the lines again rather than stored: those of all occurrences are larger than the lines
    spelled = lines.where(~blank).select("line", *own, F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("words"))
    named = [c.alias(f"f{i}") for i, c in enumerate(filed)] + [c.alias(f"a{i}") for i, c in enumerate(asked)]
    keyed = spelled.select("h", "g", parity(words).alias("sig"), *named)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "no", "row")).alias("first")
    firsts = occurrences.where("not blank").groupBy("h", "g").agg(first, F.count(F.lit(1)).alias("n"))
    segments = keyed.groupBy("h", "g").agg(*[F.max(c).alias(c) for c in keyed.columns if c not in "hg"])
    # numbers are shorter than hashes in what the joins shuffle; written once, so they stay the same
    distinct = materialise(firsts.join(segments, ["h", "g"]).withColumn("num", F.monotonically_increasing_id()), "distinct-lines")

    def unfolded(mark: str, n: int) -> DataFrame:
        keys = distinct.select("num", F.explode(F.array(*[f"{mark}{i}" for i in range(n)])).alias("key"), F.lit(mark == "f").alias("filed"))
        return keys.where("key is not null")

    postings = unfolded("f", len(filed)).unionByName(unfolded("a", len(asked))) if asked else unfolded("f", len(filed))
    same_key = Window.partitionBy("key")
    n_filed, n_all = F.count(F.when(F.col("filed"), 1)).over(same_key), F.count(F.lit(1)).over(same_key)
    met = postings.select("*", n_filed.alias("n_filed"), n_all.alias("n_all")).where("n_filed > 0 and n_all > 1").select("key", "num", "filed")
    met = materialise(met, "lines-that-meet")

    wanted = met.select("num").distinct().join(distinct.select("num", "h", "g", "sig", "first"), "num")
    # the first occurrence brings the text; rows that repeat an id can bring it more than once
    wanted = wanted.select("num", "sig", "first", F.col("h").alias("own_h"), F.col("g").alias("own_g"), F.col("first.id").alias("first_id"), F.col("first.no").alias("first_no"))
    at = (F.col("h") == F.col("own_h")) & (F.col("g") == F.col("own_g")) & F.col("id").eqNullSafe(F.col("first_id")) & (F.col("no") == F.col("first_no"))
    texts = lines.where(~blank).select("id", "no", "line", *own).join(wanted, at)
    texts = materialise(texts.groupBy("num", "sig", "first").agg(F.min("line").alias("line")), "lines-to-compare")
    compared = materialise(met.join(texts, "num"), "line-segments")

    def side(rows: DataFrame, mark: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{c}_{mark}") for c in ("key", "num", "sig", "first", "line")])

    def later(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Lines of ``rows`` that have an earlier near line among ``others`` under one of their keys."""
        close = F.bit_count(F.col("sig_x").bitwiseXOR(F.col("sig_y"))) <= max(3 * max_edits, 2 * max_words)
        near = near_lines(F.col("line_x"), F.col("line_y"), max_edits, max_words, words_per_edit)
        earlier = (F.col("key_x") == F.col("key_y")) & (F.col("first_x") < F.col("first_y"))
        return side(rows, "y").join(side(others, "x"), earlier & close & near, "left_semi").select(F.col("num_y").alias("num"))

    by_filed = later(compared, compared.where("filed"))
    by_asked = later(compared.where("filed"), compared.where("not filed"))
    gone = materialise(by_filed.union(by_asked).distinct(), "later-lines").withColumn("later", F.lit(True))

    verdict = distinct.select("num", "h", "g", "first", "n").join(gone, "num", "left").where("n > 1 or later")
    verdict = materialise(verdict.select(F.col("h").alias("own_h"), F.col("g").alias("own_g"), "first", "n", F.coalesce("later", F.lit(False)).alias("later")), "line-verdicts")
    total = verdict.agg(F.sum("n")).first()[0] or 0
    # at most _HOT lines occur that often
    hot = F.col("n") >= max(hot_lines, -(-total // _HOT))
    same = (F.col("h") == F.col("own_h")) & (F.col("g") == F.col("own_g"))
    judged = occurrences.where("not blank").join(F.broadcast(verdict.where(hot)), same, "left")
    usual = judged.where("own_h is null").select("row", "id", "no", "h", "g").join(verdict.where(~hot), same, "left")
    judged = judged.where("own_h is not null").select("row", "id", "no", "later", "first").unionByName(usual.select("row", "id", "no", "later", "first"))
    is_first = (F.col("first.row") == F.col("row")) & (F.col("first.no") == F.col("no"))
    dropped = F.coalesce("later", F.lit(False)) | ~F.coalesce(is_first, F.lit(True))
    # documents without a line to judge are brought in by their blank lines
    marked = judged.select("row", "id", F.when(dropped, F.col("no")).alias("gone")).unionByName(
        occurrences.where("blank").select("row", "id", F.lit(None).cast("int").alias("gone"))
    )
    return (
        marked.groupBy("row", "id")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.count("gone").alias("n_dropped"), F.sort_array(F.collect_list("gone")).alias("dropped"))
        .drop("row")
        .withColumnRenamed("id", id_col)
    )


def without_lines(docs: DataFrame, dropped: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; ids must be unique, rows without a verdict stay as they are."""
    verdict = dropped.select(F.col(id_col).alias("_for"), F.col("dropped").alias("_dropped"))
    kept = F.filter(F.split(F.col("_row")[text_col], "\n", -1), lambda _, i: ~F.array_contains("_dropped", i))
    text = F.when(F.size("_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("_row")[text_col])
    met = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id")).join(verdict, F.col("_id").eqNullSafe(F.col("_for")), "left")
    return met.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
