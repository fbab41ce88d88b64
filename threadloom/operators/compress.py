"""Rendering of ranked symbols as full text or skeleton, and packing into prompts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.hashing import ccr_key
from threadloom.functions.paths import fence
from threadloom.functions.text import clean_lines, savings_percent, skeleton, token_estimate

FULL_SCORE = 0.8
LINES_PER_PIECE = 2000
REQUESTS_PER_ROW = 4096  # about the most requests that one row of places lists
PROMPT_TASKS = 2000  # most tasks that join prompts
RETRIEVE_TOOL = "context_retrieve"
PREAMBLE_STAGE, SECTION_STAGE, QUESTION_STAGE = 0, 1, 2


def preamble(tool: str = RETRIEVE_TOOL) -> str:
    """Fixed three lines before the files; names the tool that gives left-out bodies back."""
    return (
        "Below is the relevant codebase context optimized for this request.\n"
        "NOTE: Less relevant method/function bodies are optimized out to save tokens.\n"
        "To retrieve the original full implementation of any optimized block, use the tool "
        f"'{tool}' with its respective CCR Key.\n\n"
    )


def full_body(score: Column, distance: Column) -> Column:
    return (score >= FULL_SCORE) | (distance == 0)


def renderings(symbols: DataFrame, strip_brace: bool = False) -> DataFrame:
    """Both texts of every symbol, made once per symbol however many requests want it."""
    path = F.col("file_path")
    keyed = symbols.withColumn("ccr_key", ccr_key(F.col("body")))
    texts = keyed.select(
        "id",
        "file_path",
        "line_start",
        "ccr_key",
        F.octet_length("body").alias("raw_bytes"),
        clean_lines(F.col("body"), path).alias("full_text"),
        clean_lines(
            skeleton(F.col("signature"), F.col("ccr_key"), path, strip_brace), path
        ).alias("skeleton_text"),
    )
    return texts.withColumns(
        {"full_bytes": F.octet_length("full_text"), "skeleton_bytes": F.octet_length("skeleton_text")}
    )


def flags(ranked: DataFrame) -> DataFrame:
    """Which text each ranked symbol gets: (request_id, id, full)."""
    return ranked.select("request_id", "id", full_body(F.col("score"), F.col("distance")).alias("full"))


def render(ranked: DataFrame, symbols: DataFrame, strip_brace: bool = False) -> DataFrame:
    """Text of each ranked symbol: (request_id, id, file_path, line_start, full, ccr_key, raw_bytes, text_bytes, text)."""
    full = full_body(F.col("score"), F.col("distance"))
    return ranked.join(renderings(symbols, strip_brace), "id").select(
        "request_id",
        "id",
        "file_path",
        "line_start",
        full.alias("full"),
        F.when(~full, F.col("ccr_key")).alias("ccr_key"),
        "raw_bytes",
        F.when(full, F.col("full_bytes")).otherwise(F.col("skeleton_bytes")).alias("text_bytes"),
        F.when(full, F.col("full_text")).otherwise(F.col("skeleton_text")).alias("text"),
    )


def compression_stats(rendered: DataFrame) -> DataFrame:
    """Bytes before and after, savings and symbol count per request."""
    return (
        rendered.groupBy("request_id")
        .agg(
            F.sum("raw_bytes").alias("raw_bytes"),
            F.sum("text_bytes").alias("optimized_bytes"),
            F.count("*").alias("included_count"),
        )
        .withColumn("savings_percent", savings_percent(F.col("raw_bytes"), F.col("optimized_bytes")))
    )


def _piece() -> Column:
    return F.floor((F.greatest("line_start", F.lit(1)) - 1) / LINES_PER_PIECE).cast("int")


def pack_by_file(rendered: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Sections of the prompt: (request_id, file_path, piece, text), to be read in that order.

    A section is a file in line order under its heading. A piece holds the symbols that start within
    a fixed range of lines, so a huge file becomes several rows; the heading goes with the first piece,
    the closing fence with the last.

    With ``texts``, the ``renderings`` of all symbols, only the ``flags`` of ``rendered`` are read: every
    symbol's text travels once, and a request brings the places of its symbols instead of their texts.
    """
    if texts is None:
        pieces = (
            rendered.select("request_id", "file_path", _piece().alias("piece"), F.struct("line_start", "id", "text").alias("row"))
            .groupBy("request_id", "file_path", "piece")
            .agg(F.collect_list("row").alias("rows"))
        )
        return _framed(_ends(pieces), F.col("rows"))
    # Never null, so that one hash serves the groups and the join of both sides.
    file = F.coalesce(F.concat(F.lit("/"), "file_path"), F.lit(""))
    texts = texts.withColumns({"_file": file, "piece": _piece()})
    row = F.struct("line_start", "id", "full_text", "skeleton_text")
    units = texts.groupBy("_file", "piece").agg(F.sort_array(F.collect_list(row.alias("row"))).alias("all"))
    order = W.partitionBy("_file", "piece").orderBy("line_start", "id")
    places = texts.repartition("_file").select("id", "_file", "piece", (F.row_number().over(order) - 1).alias("_at"))

    # Requests of one symbol, and later of one piece, travel together, so no row repeats an id or a path for each.
    blocks = -(-rendered.select("request_id").distinct().count() // REQUESTS_PER_ROW)
    block = F.lit(0) if blocks <= 1 else F.pmod(F.xxhash64("request_id"), F.lit(blocks)).cast("int")
    asked = (
        rendered.select("id", block.alias("_block"), F.struct("request_id", "full").alias("ask"))
        .groupBy("id", "_block")
        .agg(F.collect_list("ask").alias("asks"))
        .join(places, "id")
        .repartition("_file")
    )
    mark = F.shiftleft("_at", 1) + F.coalesce("full", F.lit(False)).cast("int")
    marked = asked.select("_file", "piece", "_block", "_at", F.inline("asks")).groupBy("request_id", "_file", "piece")
    wanted = _ends(marked.agg(F.first("_block").alias("_block"), F.collect_list(mark).alias("_marks")), "_file")
    by_unit = wanted.groupBy("_file", "piece", "_block").agg(
        F.collect_list(F.struct("request_id", "_first", "_last", "_marks")).alias("requests")
    )
    met = by_unit.join(units, ["_file", "piece"]).select("_file", "piece", "all", F.inline("requests"))

    def picked(mark: Column) -> Column:
        at = F.get("all", F.shiftright(mark, 1))
        text = F.when(mark.bitwiseAND(F.lit(1)) == 1, at["full_text"]).otherwise(at["skeleton_text"])
        return F.struct(at["line_start"].alias("line_start"), at["id"].alias("id"), text.alias("text"))

    path = F.when(F.col("_file") != "", F.expr("substring(_file, 2)"))
    return _framed(met.withColumn("file_path", path), F.transform("_marks", picked))


def _ends(pieces: DataFrame, path: str = "file_path") -> DataFrame:
    """Adds the first and the last piece of the file in the prompt."""
    file = W.partitionBy("request_id", path)
    return pieces.withColumns({"_first": F.min("piece").over(file), "_last": F.max("piece").over(file)})


def _framed(pieces: DataFrame, rows: Column) -> DataFrame:
    """Text of each piece from its ``rows(line_start, id, text)``, with heading and closing fence."""
    path = F.col("file_path")
    head = F.concat(F.lit("### File: "), path, F.lit("\n```"), fence(path), F.lit("\n"))
    return pieces.select(
        "request_id",
        "file_path",
        "piece",
        F.concat(
            F.when(F.col("piece") == F.col("_first"), head).otherwise(F.lit("")),
            F.array_join(F.sort_array(rows)["text"], "\n\n"),
            F.lit("\n\n"),
            F.when(F.col("piece") == F.col("_last"), F.lit("```\n\n")).otherwise(F.lit("")),
        ).alias("text"),
    )


def assemble(sections: DataFrame, requests: DataFrame | None = None, tool: str = RETRIEVE_TOOL) -> DataFrame:
    """Prompts in pieces: (request_id, stage, file_path, piece, prompt).

    The preamble stands at stage 0, the sections at stage 1; read in (stage, file_path, piece) order they are the prompt,
    whatever its size, and no row grows with it. ``requests`` are those that have sections; without it they are found there.
    """
    with_context = (sections if requests is None else requests).select("request_id").distinct()
    intro = with_context.select(
        "request_id",
        F.lit(PREAMBLE_STAGE).alias("stage"),
        F.lit("").alias("file_path"),
        F.lit(0).alias("piece"),
        F.lit(preamble(tool)).alias("prompt"),
    )
    return intro.unionByName(sections.withColumn("stage", F.lit(SECTION_STAGE)).withColumnRenamed("text", "prompt"))


def whole_prompts(prompts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(request_id, prompt): each prompt as one string, which must fit into a row.

    Pieces are sorted into their order and joined as they come, so a task holds one prompt at a time. With ``requests``,
    those that have a prompt, a task gets about one of them.
    """

    def row(request: pa.Array, pieces: list[pa.Array]) -> pa.RecordBatch:
        texts = pa.concat_arrays(pieces)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")
        return pa.RecordBatch.from_arrays([request, whole], ["request_id", "prompt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request, pieces = None, []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for start, end in pairwise([*starts, len(ids)]):
                own = batch.column(0).slice(start, 1)
                if pieces and not own.equals(request):
                    yield row(request, pieces)
                    pieces = []
                request = own
                pieces.append(batch.column(1).slice(start, end - start).drop_null())
        if pieces:
            yield row(request, pieces)

    tasks = [] if requests is None else [min(max(requests.select("request_id").distinct().count(), 1), PROMPT_TASKS)]
    ordered = prompts.repartition(*tasks, "request_id").sortWithinPartitions("request_id", "stage", "file_path", "piece")
    key = prompts.schema["request_id"].dataType.simpleString()
    return ordered.select("request_id", "prompt").mapInArrow(run, f"request_id {key}, prompt string")


def elided_bodies(rendered: DataFrame, symbols: DataFrame) -> DataFrame:
    """Key and body of every symbol that some request shows as a skeleton; the ``flags`` of ``rendered`` are enough."""
    shown = rendered.where(~F.col("full")).select("id").distinct()
    keyed = symbols.where(F.col("body").isNotNull()).select("id")
    return ccr_store(symbols.join(shown, "id", "left_semi").join(keyed, "id", "left_semi"))


def ccr_store(symbols: DataFrame) -> DataFrame:
    """Key and body of every distinct body."""
    return (
        symbols.select(ccr_key(F.col("body")).alias("key"), "body")
        .groupBy("key")
        .agg(F.min("body").alias("body"))
    )


def ccr_retrieve(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Body for each asked key; a miss has success = false."""
    return keys.join(store, "key", "left").withColumn("success", F.col("body").isNotNull())


@dataclass(frozen=True)
class Compressed:
    """Outcome of packing: prompts, per-request numbers, and the bodies to keep for retrieval."""

    prompts: DataFrame
    stats: DataFrame
    ccr: DataFrame


def compress(ranked: DataFrame, symbols: DataFrame, strip_brace: bool = False) -> Compressed:
    rendered = render(ranked, symbols, strip_brace)
    return Compressed(
        assemble(pack_by_file(flags(ranked), renderings(symbols, strip_brace)), ranked),
        compression_stats(rendered),
        elided_bodies(flags(ranked), symbols),
    )


def token_stats(stats: DataFrame) -> DataFrame:
    """Bytes as estimated tokens."""
    return stats.select(
        "request_id",
        token_estimate(F.col("raw_bytes")).alias("raw_tokens"),
        token_estimate(F.col("optimized_bytes")).alias("optimized_tokens"),
        F.col("savings_percent").alias("token_savings"),
        "included_count",
    )
