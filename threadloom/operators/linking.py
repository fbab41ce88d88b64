"""Dependency links between symbols.

A file sees *scopes* and belongs to scopes; a reference resolves to every symbol of that simple name in
a scope its file sees. Links are kept in this factored form, as references (symbol -> scope, name) and
definitions (scope, name -> symbol): it grows with the symbols, while the list of resolved pairs can grow
with their square when one directory or one name is hot. Traversal works on the factored form;
``resolved_edges`` spells the pairs out where a caller wants them as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.paths import directory, last_segment, package, simple_name
from threadloom.operators.skew import spread_join
from threadloom.operators.substring import substring_matches
from threadloom.session import cut_lineage

NAMES_PER_SCOPE = 4096  # a scope with more names is not searched for name by name
WORDS_KEPT = 100_000  # words of one file whose names are remembered


@dataclass(frozen=True)
class Scopes:
    """``sees(file_path, scope)`` and ``holds(scope, file_path)``."""

    sees: DataFrame
    holds: DataFrame


@dataclass(frozen=True)
class Links:
    """``refs(id, scope, name)`` and ``defs(scope, name, id)``."""

    refs: DataFrame
    defs: DataFrame


def file_scopes(files: DataFrame, symbols: DataFrame | None = None) -> Scopes:
    """Scopes by directory, by imported package name and by imported path text.

    ``files(file_path, imports)`` are the registered files; ``symbols`` may stand in other files, which
    see only their directory and are reached by directory or path text.
    """
    registered = files.select("file_path", "imports").dropDuplicates(["file_path"])
    paths = registered.select("file_path", F.lit(True).alias("registered"))
    if symbols is not None:
        paths = (
            paths.unionByName(symbols.select("file_path", F.lit(False).alias("registered")).distinct())
            .groupBy("file_path")
            .agg(F.max("registered").alias("registered"))
        )
    imports = registered.select("file_path", F.explode("imports").alias("item")).where(
        F.col("item") != ""
    )
    by_text = substring_matches(
        imports.select(F.col("item").alias("term")).distinct(),
        paths.select(F.col("file_path").alias("word")),
    ).select(F.concat(F.lit("i:"), "term").alias("scope"), F.col("word").alias("file_path"))

    local = paths.select("file_path", F.concat(F.lit("d:"), directory(F.col("file_path"))).alias("scope"))
    sees = local.unionByName(
        imports.select(
            "file_path",
            F.explode(
                F.array(
                    F.concat(F.lit("p:"), last_segment(F.col("item"))),
                    F.concat(F.lit("i:"), F.col("item")),
                )
            ).alias("scope"),
        )
    ).distinct()
    holds = (
        local.unionByName(
            paths.where("registered").select(
                "file_path", F.concat(F.lit("p:"), package(F.col("file_path"))).alias("scope")
            )
        )
        .unionByName(by_text)
        .select("scope", "file_path")
    )
    return Scopes(cut_lineage(sees), cut_lineage(holds))


def visible_scopes(scopes: Scopes) -> DataFrame:
    """Every scope a file sees, with the number of files in it (itself included)."""
    sizes = scopes.holds.groupBy("scope").agg(F.count("*").alias("n_files"))
    return scopes.sees.join(sizes, "scope").select("file_path", "scope", "n_files")


@dataclass(frozen=True)
class Seen:
    """``files(file_path, names, hot)``: the names each file can resolve; ``hot_names(term)``: those of hot scopes.

    A scope with more than ``NAMES_PER_SCOPE`` names is hot. Its names stand in no array, the files that see it are marked.
    """

    files: DataFrame
    hot_names: DataFrame | None


def seen_names(symbols: DataFrame, scopes: Scopes, names_per_scope: int = NAMES_PER_SCOPE) -> Seen:
    """Names defined in the scopes that a file sees, in one bounded array per file."""
    named = symbols.select("file_path", simple_name(F.col("name")).alias("name")).where(F.col("name").isNotNull())
    defined = cut_lineage(named.distinct().join(scopes.holds, "file_path").select("scope", "name").distinct())
    hot = cut_lineage(defined.groupBy("scope").agg(F.count("*").alias("_n")).where(F.col("_n") > names_per_scope).select("scope"))
    some_hot = not hot.isEmpty()
    listed = defined.join(hot, "scope", "left_anti") if some_hot else defined
    listed = listed.groupBy("scope").agg(F.collect_list("name").alias("names"), F.lit(False).alias("hot"))
    if some_hot:
        listed = listed.unionByName(hot.select("scope", F.array().cast("array<string>").alias("names"), F.lit(True).alias("hot")))
    files = (
        scopes.sees.join(listed, "scope")
        .groupBy("file_path")
        .agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.max("hot").alias("hot"))
    )
    terms = defined.join(hot, "scope", "left_semi").select(F.col("name").alias("term")).distinct() if some_hot else None
    return Seen(cut_lineage(files), terms)


def call_names(symbols: DataFrame, seen: Seen | None = None) -> DataFrame:
    """Simple names a symbol calls, from its ``dependencies``: (id, file_path, name), repeats kept.

    With ``seen`` only names that the file can resolve, and those of files that see a hot scope, each once.
    """
    calls = F.transform("dependencies", simple_name)
    if seen is not None:
        symbols = symbols.join(seen.files, "file_path")
        calls = F.when(F.col("hot"), F.array_distinct(calls)).otherwise(F.array_intersect(calls, "names"))
    return symbols.select("id", "file_path", F.explode(calls).alias("name"))


def lexical_names(symbols: DataFrame, seen: Seen | None = None) -> DataFrame:
    """Simple names that occur as text in the body of a symbol: (id, file_path, name), repeats kept.

    Names are identifiers, so an occurrence lies inside one run of word characters. With ``seen`` a body is searched
    for the names that its file can resolve, and meets the names of hot scopes through the vocabulary of such runs;
    without it, all bodies meet all names that way.
    """
    if seen is None:
        return _names_in_runs(symbols, symbols.select(simple_name(F.col("name")).alias("term")).distinct())
    identifiers = F.filter("names", lambda n: (n != "") & ~n.rlike(r"(?U)\W"))
    listed = seen.files.select("file_path", F.array_join(identifiers, "\n").alias("names"))
    bodies = symbols.select("id", "file_path", "body").join(listed, "file_path")
    found = bodies.select("id", "file_path", F.explode(_contained("body", "names")).alias("name"))
    if seen.hot_names is None:
        return found
    sources = symbols.join(seen.files.where("hot").select("file_path"), "file_path", "left_semi")
    return found.unionByName(_names_in_runs(sources, seen.hot_names))


def _contained(body: str, names: str) -> Column:
    """Those of the names, one a line, that the body contains; names hold no white space."""

    def run(bodies: pa.Array, names: pa.Array) -> pa.Array:
        out, before, by_start, size, inside = [], None, {}, 1, {}
        for text, listed in zip(bodies, names, strict=True):
            text, listed = text.as_py(), listed.as_py()
            if listed != before:
                before, known, inside = listed, listed.split(), {}
                size = min(map(len, known), default=1)
                by_start = {}
                for name in known:
                    by_start.setdefault(name[:size], []).append(name)
            found = set()
            for word in set(text.split()) if text and by_start else ():
                hits = inside.get(word)
                if hits is None:
                    starts = ((i, by_start.get(word[i : i + size])) for i in range(len(word) - size + 1))
                    hits = [n for i, some in starts if some for n in some if word.startswith(n, i)]
                    if len(inside) < WORDS_KEPT:
                        inside[word] = hits
                found.update(hits)
            out.append(list(found))
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(body, names)


def _names_in_runs(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms inside the runs of word characters of each body."""
    runs = symbols.select(
        "id",
        "file_path",
        F.explode(F.array_distinct(F.split("body", r"(?U)\W+"))).alias("word"),
    ).where(F.col("word") != "")
    matches = substring_matches(terms, runs.select("word").distinct())
    return runs.join(matches, "word").select("id", "file_path", F.col("term").alias("name"))


def factored_links(symbols: DataFrame, scopes: Scopes, names: DataFrame) -> Links:
    """Resolve ``names(id, file_path, name)`` through the scopes."""
    defs = cut_lineage(
        symbols.select("id", "file_path", simple_name(F.col("name")).alias("name"))
        .join(scopes.holds, "file_path")
        .select("scope", "name", "id")
    )
    refs = (
        names.join(scopes.sees, "file_path")
        .join(defs.select("scope", "name").distinct(), ["scope", "name"], "left_semi")
        .select("id", "scope", "name")
        .distinct()
    )
    return Links(refs, defs)


def link_symbols(symbols: DataFrame, files: DataFrame) -> Links:
    """Links from calls and from names found in bodies, materialised for the many uses they have."""
    scopes = file_scopes(files, symbols)
    seen = seen_names(symbols, scopes)
    names = call_names(symbols, seen).unionByName(lexical_names(symbols, seen))
    links = factored_links(symbols, scopes, names)
    return Links(cut_lineage(links.refs), links.defs)


def resolved_edges(links: Links) -> DataFrame:
    """The links as distinct (src_id, dst_id) rows, without self links."""
    refs = links.refs.withColumnRenamed("id", "src_id")
    defs = links.defs.withColumnRenamed("id", "dst_id")
    return (
        spread_join(refs, defs, ["scope", "name"])
        .where(F.col("src_id") != F.col("dst_id"))
        .select("src_id", "dst_id")
        .distinct()
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse once."""
    back = edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return edges.select("src_id", "dst_id").unionByName(back).distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Who refers to a symbol."""
    return edges.select(F.col("dst_id").alias("id"), F.col("src_id").alias("referrer_id")).distinct()


def name_index(symbols: DataFrame, ids_per_row: int = 4096) -> DataFrame:
    """Symbols by simple name, in rows of bounded size: (name, shard, n_ids, ids).

    Most names need one row. A hot name is dealt over several by a digest of the id.
    """
    named = symbols.select(simple_name(F.col("name")).alias("name"), "id")
    shards = named.groupBy("name").agg(
        F.ceil(F.count("*") / ids_per_row).cast("int").alias("shards")
    )
    digest = F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("bigint")
    return (
        named.join(shards, "name")
        .withColumn("shard", F.pmod(digest, F.col("shards")).cast("int"))
        .groupBy("name", "shard")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("name", "shard", F.size("ids").alias("n_ids"), "ids")
    )
