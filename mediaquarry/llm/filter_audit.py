"""How filters interact: what each removes in every order, what it alone removes, and what it costs in labelled documents.

A document fails some of k filters: a mask of k bits. For each part and label the 2^k signed parity sums over the
masks are aggregated, W[s] = sum of (-1)^|mask & s|; these Walsh-Hadamard coefficients add up over rows, tasks and tables,
and the transform is its own inverse up to the factor 2^k, so the number of documents of each mask follows
exactly. All orders are then evaluated on the 2^k cells. A document that fails c filters is removed by each of them in
k!/c of the k! orders, which gives a filter's Shapley sum in closed form.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquarry.llm.common import WORD, materialise, text_of


def text_failures(text: Column) -> dict[str, Column]:
    """The text filters' failure conditions: A few words, B words that repeat, C capitals, D markup characters."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": count < 200,
        "B": 100 * distinct < 50 * count,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """_id, _part, _mask and _n: how many rows of an id and part fail which of A to E; bit i of the mask is the i-th letter.

    E fails where a smaller id has the same text. Texts are told apart by SHA-256. A row is the first of its text where
    id and digest are those of the text's smallest id, so rows meet by both: no key is as frequent as a text. A null text
    is the empty text, a null part the empty string; a null id is not smaller than any and fails no E; rows that repeat an id
    and a text fail E together.
    """
    text = text_of(text_col)
    marks = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    failures = text_failures(F.col("_text"))
    mask = sum(F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures.values()))
    marks = materialise(marks.select("_id", "_part", F.unhex(F.sha2("_text", 256)).alias("_sha"), mask.alias("_mask")), "failure-marks")
    rows = marks.groupBy("_id", "_part", "_sha", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    firsts = marks.groupBy("_sha").agg(F.min("_id").alias("_first")).select(F.col("_sha").alias("_same"), "_first")
    met = rows.join(firsts, (F.col("_sha") == F.col("_same")) & (F.col("_id") == F.col("_first")), "left")
    later = F.col("_id").isNotNull() & F.col("_first").isNull()
    return met.select("_id", "_part", (F.col("_mask") + F.when(later, 1 << len(failures)).otherwise(0)).alias("_mask"), "_n")


def labelled(rows: DataFrame, labels: DataFrame, kinds: Mapping[str, Column], *, id_col: str = "doc_id") -> DataFrame:
    """A row of ``rows`` (_id, ...) for the label '' and for each kind of label that holds for its id: adds _label.

    ``kinds``: conditions on the columns of ``labels``. A kind holds for an id if it does in any of its rows; null conditions and
    ids without a row have none.
    """
    flags = [F.max(F.coalesce(condition, F.lit(False))).alias(f"_is_{kind}") for kind, condition in kinds.items()]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_of")).agg(*flags)
    # rows without an id have no label; they do not meet in the task of the null key
    met = rows.where("_id is not null").join(known, F.col("_id") == F.col("_of"), "left").drop("_of")
    none = rows.where("_id is null").select("*", *[F.lit(False).alias(f"_is_{kind}") for kind in kinds])
    found = F.array(F.lit(""), *[F.when(F.col(f"_is_{kind}"), kind) for kind in kinds])
    return met.unionByName(none).select(*rows.columns, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_label"))


def sign(mask: Column, s: Column) -> Column:
    """(-1) to the number of bits that two masks share."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(s)) % 2)


def parity_sums(rows: DataFrame, filters: int) -> DataFrame:
    """For each _part and _label the signed parity sums over the masks of (_part, _label, _mask, _n): _sums, an array of 2^filters longs."""
    sums = [F.sum(F.col("_n") * sign(F.col("_mask"), F.lit(s))) for s in range(1 << filters)]
    return rows.groupBy("_part", "_label").agg(*[x.alias(f"_w{s}") for s, x in enumerate(sums)]).select("_part", "_label", F.array(*[f"_w{s}" for s in range(1 << filters)]).alias("_sums"))


def mask_cells(sums: Column, filters: int) -> Column:
    """The number of documents of each mask: the transform of the sums once more, divided by 2^filters without a rest."""
    places = F.sequence(F.lit(0), F.lit((1 << filters) - 1))

    def cell(mask: Column) -> Column:
        return F.shiftright(F.aggregate(places, F.lit(0).cast("long"), lambda n, s: n + F.get(sums, s) * sign(mask, s)), filters)

    return F.transform(places, cell)


def steps_of_orders(rows: DataFrame, letters: str) -> DataFrame:
    """Each row for every order of the filters and every step of it: adds _order, _step (from 1 on), _bit of the step's filter and _before, the bits before it."""
    orders = ",".join(map("".join, permutations(letters)))

    def bits(text: Column) -> Column:
        return sum(F.when(F.contains(text, F.lit(letter)), 1 << i).otherwise(0) for i, letter in enumerate(letters))

    each = rows.withColumn("_order", F.explode(F.split(F.lit(orders), ","))).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    return each.withColumns({"_bit": bits(F.substring("_order", F.col("_step"), F.lit(1))), "_before": bits(F.substring("_order", F.lit(1), F.col("_step") - 1))})


def audit(rows: DataFrame, letters: str, kinds: list[str]) -> DataFrame:
    """Every part, order and step of masked, labelled rows (_part, _label, _mask, _n).

    part, filter_order, step, kept, removed, redundant, unique_fails, <kind>_lost for each kind of label, and shapley. Parts are
    those of the rows; all orders and steps of a part are there, zeros included; an empty table has no parts.
    """
    k = len(letters)
    places = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    cells = parity_sums(rows, k).select("_part", "_label", mask_cells(F.col("_sums"), k).alias("_cells"))
    # a part has one row for each label; kinds that no document has are zeros
    own = [F.max(F.when(F.col("_label") == kind, F.col("_cells"))) for kind in ("", *kinds)]
    zeros = F.array_repeat(F.lit(0).cast("long"), 1 << k)
    parts = cells.groupBy("_part").agg(*[F.coalesce(c, zeros).alias(f"_c{i}") for i, c in enumerate(own)])

    bit, before = F.col("_bit"), F.col("_before")

    def total(cells: str, holds) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda n, m: n + F.when(holds(m), F.get(F.col(cells), m)).otherwise(0))

    def fails(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    def untouched(m: Column) -> Column:
        return m.bitwiseAND(before) == 0

    shares = F.array(*[F.lit(factorial(k) // max(1, c)).cast("long") for c in range(k + 1)])
    shapley = F.aggregate(places, F.lit(0).cast("long"), lambda n, m: n + F.when(fails(m), F.get("_c0", m) * F.get(shares, F.bit_count(m))).otherwise(0))
    return steps_of_orders(parts, letters).select(
        F.col("_part").alias("part"),
        F.col("_order").alias("filter_order"),
        F.col("_step").alias("step"),
        total("_c0", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("_c0", lambda m: fails(m) & untouched(m)).alias("removed"),
        total("_c0", lambda m: fails(m) & ~untouched(m)).alias("redundant"),
        F.get("_c0", bit).alias("unique_fails"),
        *[total(f"_c{i}", lambda m: fails(m) & untouched(m)).alias(f"{kind}_lost") for i, kind in enumerate(kinds, 1)],
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five text filters over whole texts, audited by part; ``labels`` (id, quality, toxic) gives good and toxic documents.

    See ``failure_masks`` for nulls and repeated rows, ``labelled`` for labels, ``audit`` for the columns. An empty table gives
    an empty result; other columns, whatever their names, are not read.
    """
    masks = failure_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    kinds = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return audit(labelled(masks, labels, kinds, id_col=id_col), "ABCDE", list(kinds))
