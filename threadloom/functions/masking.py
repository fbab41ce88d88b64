"""Masking of secrets and personal data in text columns, whole or in pieces.

The rules run one after another, specific ones first, so that a result never depends on chance. Finding and hiding in one
text is in ``secrets``; here Arrow batches of texts go through it, and texts in several rows are masked as one.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.secrets import (
    RULE_NAMES,
    RULES,
    Finder,
    Rule,
    first_cut,
    mask_text,
    replace_values,
    uri_passwords,
    values_of,
)
from threadloom.session import cut_lineage, release

VALUES_PER_ROW = 20_000
VALUES_PER_TASK = 100_000  # most values that a task holds to search pieces for
TEXTS_AT_ONCE = 64  # texts of a batch that are Python objects at one time

_MASKED = pa.struct([("text", pa.string()), ("counts", pa.list_(pa.int32()))])
_CUT = pa.struct([("first", pa.int32()), ("at_end", pa.bool_())])
_OPEN = pa.struct([("closed", pa.bool_()), ("open", pa.bool_()), ("may", pa.int32())])


def _mask_batch(names: list[str]) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        rules = [r for r in RULES if r.name in names]
        parts = []
        for start in range(0, max(len(texts), 1), TEXTS_AT_ONCE):
            out = []
            for value in texts.slice(start, TEXTS_AT_ONCE).to_pylist():
                masked, counts = mask_text(value, rules) if value is not None else (None, [0] * len(rules))
                out.append({"text": masked, "counts": counts})
            parts.append(pa.array(out, _MASKED))
        return pa.concat_arrays(parts)

    return run


def _masked(text: Column, names: list[str]) -> Column:
    """struct<text, counts>: the masked text and the number of items per rule; a null text stays null, without items."""
    # Not to be run a second time where the optimizer would copy it into a filter.
    return F.arrow_udf(_mask_batch(names), "text string, counts array<int>").asNondeterministic()(text)


def mask(
    df: DataFrame,
    text: str,
    into: str = "masked_text",
    count: str = "items_masked",
    rules: list[str] | None = None,
) -> DataFrame:
    """Add the masked text and the number of masked items; keeps all other columns.

    Label rules count once per label, the others once per value found.
    """
    names = RULE_NAMES if rules is None else rules
    total = F.aggregate(F.col("_masked.counts"), F.lit(0), lambda acc, n: acc + n)
    return (
        df.withColumn("_masked", _masked(F.col(text), names))
        .withColumns({into: F.col("_masked.text"), count: total})
        .drop("_masked")
    )


def mask_counts(df: DataFrame, text: str) -> DataFrame:
    """Number of masked items per rule, each as the full chain counts it."""
    counts = {f"n_{name.lower()}": F.element_at("_masked.counts", i + 1) for i, name in enumerate(RULE_NAMES)}
    return df.withColumn("_masked", _masked(F.col(text), RULE_NAMES)).withColumns(counts).drop("_masked")


# ---------------------------------------------------------------- texts in pieces


def _cut(texts: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("first", "at_end"), first_cut(t), strict=True)) for t in texts.to_pylist()], _CUT)


def _open_ends(texts: pa.Array) -> pa.Array:
    ends = []
    for text in (t.as_py() for t in texts):
        (some, closed), (more, open_) = uri_passwords(text), uri_passwords(text, True)
        found = [some or more if rule.name == "DB_URI" else values_of(rule, text, text) for rule in RULES]
        ends.append({"closed": closed, "open": open_, "may": sum(1 << i for i, values in enumerate(found) if values)})
    return pa.array(ends, _OPEN)


def recut(df: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """The pieces with borders where no value can cross them; read in ``order`` they are the same text.

    What stands before the first such place of a piece moves to the end of an earlier one, so a word that crosses a border
    ends up whole in the piece that it begins in, however many pieces it goes through. Every piece keeps its row. Only the
    places are sorted per group; of the texts, only what moves is gathered.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    places = cut_lineage(df.select(group, *order, F.arrow_udf(_cut, "first int, at_end boolean").asNondeterministic()(whole).alias("_cut")))
    by = W.partitionBy(group).orderBy(*order)
    key = F.struct(*order)
    start = F.when(F.coalesce(F.lag("_cut.at_end").over(by), F.lit(True)), 0).when(F.col("_cut.first") >= 0, F.col("_cut.first"))
    homes = places.select(group, *order, start.alias("_start"))
    homes = homes.withColumn("_home", F.last(F.when(F.col("_start").isNotNull(), key), True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    homes = cut_lineage(homes)
    release(places)
    pieces = df.withColumn(text, whole)
    if homes.where("_start is null or _start > 0").isEmpty():
        return pieces
    cut = pieces.join(homes, [group, *order])
    length = F.coalesce(F.col("_start"), F.char_length(text))
    moved = cut.where(length > 0).select(group, "_home", key.alias("_from"), F.substring(F.col(text), F.lit(1), length).alias("_head"))
    tails = moved.groupBy(group, "_home").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_from", "_head")))["_head"], "").alias("_tail"))
    rest = F.substring(F.col(text), length + 1, F.char_length(text))
    return (
        cut.withColumn("_home", key)
        .join(tails, [group, "_home"], "left")
        .withColumn(text, F.concat(rest, F.coalesce("_tail", F.lit(""))))
        .select(*df.columns)
    )


def _inside(pieces: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """``group, order, _inside, _may``: whether a piece begins behind the scheme of a connection string without its colon
    yet, and a bit for every rule that finds values in the piece as it is.

    Each piece maps the state before it to the state behind it. Of these maps some are constant; the others keep or turn
    the state, so the last constant and the number of turns since then give it.
    """
    by = W.partitionBy(group).orderBy(*order)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    ends = pieces.select(group, *order, F.arrow_udf(_open_ends, "closed boolean, open boolean, may int").asNondeterministic()(F.col(text)).alias("_end"))
    turns = F.col("_end.closed") & ~F.col("_end.open")
    counted = cut_lineage(ends).withColumn("_turns", F.sum(turns.cast("int")).over(by))
    fixed = F.when(F.col("_end.closed") == F.col("_end.open"), F.struct(F.col("_end.closed").alias("state"), F.col("_turns").alias("turns")))
    marked = counted.withColumns({"_fixed": F.last(fixed, True).over(before), "_sum": F.coalesce(F.max("_turns").over(before), F.lit(0))})
    since = (F.col("_sum") - F.coalesce(F.col("_fixed.turns"), F.lit(0))) % 2 == 1
    return marked.select(group, *order, (F.coalesce(F.col("_fixed.state"), F.lit(False)) != since).alias("_inside"), F.col("_end.may").alias("_may"))


def _find(rule: Rule) -> Column:
    name = rule.name

    def run(now: pa.Array, original: pa.Array, inside: pa.Array) -> pa.Array:
        rule = RULES[RULE_NAMES.index(name)]
        rows = zip(now.to_pylist(), original.to_pylist(), inside.to_pylist(), strict=True)
        return pa.array([values_of(rule, *row) for row in rows], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>").asNondeterministic()("_now", "_original", "_inside")


def _replace(placeholder: str) -> Column:
    def run(now: pa.Array, values: pa.Array) -> pa.Array:
        rows = zip(now.to_pylist(), values.to_pylist(), strict=True)
        return pa.array([replace_values(t, v, placeholder) if v else None for t, v in rows], pa.string())

    touched = F.when(F.col("_values").isNotNull(), F.col("_now"))  # the other pieces stay in the JVM
    return F.coalesce(F.arrow_udf(run, "string").asNondeterministic()(touched, "_values"), "_now")


def _lists_by_piece(out: DataFrame, values: DataFrame, listed: list[str], group: str, order: list[str], placeholder: str) -> DataFrame:
    """``group, order, _values``: of the values of its group, those that replacing in a piece can meet, in order.

    ``listed`` are all values of all groups. A task searches its pieces for them with one automaton.
    """
    spark = out.sparkSession
    find = spark.sparkContext.broadcast(Finder(listed, placeholder))

    def run(now: pa.Array) -> pa.Array:
        return pa.array([find.value(t.as_py()) for t in now], pa.list_(pa.int32()))

    numbered = spark.createDataFrame(list(enumerate(listed)), "_no int, _value string")
    ranked = cut_lineage(values.join(numbered, "_value").select(group, "_no", "_value", "_first"))
    in_some = out.join(values.select(group).distinct(), group, "left_semi")
    met = in_some.select(group, *order, F.explode(F.arrow_udf(run, "array<int>").asNondeterministic()("_now")).alias("_no"))
    rows = F.array_sort(F.collect_list(F.struct("_first", "_value")))
    lists = cut_lineage(met.join(ranked, [group, "_no"]).groupBy(group, *order).agg(rows["_value"].alias("_values")))
    release(ranked)
    return lists


def mask_parts(df: DataFrame, group: str, order: list[str], text: str, into: str, count: str) -> DataFrame:
    """Mask texts that come in several rows per ``group``, read in ``order``, as one text each.

    The masked pieces in order are the masked text, wherever the borders are; a value that crosses one stands, masked, in
    the piece that it begins in. ``order`` tells the rows of a group apart. A null piece counts as empty.

    One round per rule that finds something. A value found in any row of a group is hidden in all of them, in order of first
    appearance. Pieces are searched for the values of all groups at once, and each gets those of its group that it holds.
    Beyond ``VALUES_PER_TASK`` of them every piece gets the values of its group, in rows of at most ``VALUES_PER_ROW``. The
    texts stay in their rows. The number of items of a group stands on its first row.
    """
    pieces = recut(df, group, order, text)
    state = pieces.join(_inside(pieces, group, order, text), [group, *order])
    out = cut_lineage(state.withColumns({"_original": F.col(text), "_now": F.col(text), "_changed": F.lit(False)}))
    counts = []

    def next_state(after: DataFrame) -> None:
        nonlocal out
        before, out = out, cut_lineage(after)
        release(before)

    def replaced(lists: DataFrame, keys: list[str]) -> DataFrame:
        changed = F.col("_changed") | F.col("_values").isNotNull()
        return out.join(lists, keys, "left").withColumns({"_now": _replace(rule.placeholder), "_changed": changed}).drop("_values")

    for bit, rule in enumerate(RULES):
        # What a rule finds in a piece that no rule has changed is known from the first look at it.
        asked = F.col("_may").bitwiseAND(F.lit(1 << bit)) != 0
        found = out.where(asked if rule.on_original else asked | F.col("_changed")).select(group, *order, F.posexplode(_find(rule)).alias("_at", "_value"))
        first = F.min(F.struct(*order, "_at")).alias("_first")
        values = cut_lineage(found.groupBy(group, "_value").agg(first, F.count("*").alias("_times")))
        if values.isEmpty():
            release(values)
            continue
        hits = values.groupBy(group).agg(F.sum("_times").alias("_hits"))
        if rule.per_label:
            seen = out.where(F.col("_now").contains(rule.placeholder)).select(group).distinct()
            hits = hits.join(seen, group, "left_anti").withColumn("_hits", F.lit(1).cast("long"))
        counts.append(cut_lineage(hits))
        distinct = values.select("_value").where("_value <> ''").distinct()
        few = distinct.limit(VALUES_PER_TASK + 1).collect()
        if len(few) <= VALUES_PER_TASK:
            lists = _lists_by_piece(out, values, sorted(row._value for row in few), group, order, rule.placeholder)
            next_state(replaced(lists, [group, *order]))
            release(lists, values)
            continue
        rank = F.row_number().over(W.partitionBy(group).orderBy("_first")) - 1
        ranked = values.select(group, rank.alias("_rank"), "_value").withColumn("_row", F.floor(F.col("_rank") / VALUES_PER_ROW).cast("int"))
        listed = F.array_sort(F.collect_list(F.struct("_rank", "_value")))["_value"]
        lists = cut_lineage(ranked.groupBy(group, "_row").agg(listed.alias("_values")))
        release(values)
        for row in range(lists.agg(F.max("_row")).first()[0] + 1):
            next_state(replaced(lists.where(F.col("_row") == row).drop("_row"), [group]))
        release(lists)
    done = out.withColumn(into, F.col("_now")).select(*df.columns, into)
    if not counts:
        return done.withColumn(count, F.lit(0))
    hits = counts[0]
    for more in counts[1:]:
        hits = hits.unionByName(more)
    total = hits.groupBy(group).agg(F.sum("_hits").cast("int").alias("_hits"))
    first = out.groupBy(group).agg(F.min(F.struct(*order)).alias("_first")).join(total, group, "left")
    number = F.when(F.struct(*order) == F.col("_first"), F.coalesce("_hits", F.lit(0))).otherwise(0)
    return done.join(first, group).withColumn(count, number).select(*df.columns, into, count)
