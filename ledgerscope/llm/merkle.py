"""A Merkle manifest of a dataset: a tree for each group, a tree over the groups, and a proof for each row.

A leaf's place in its group comes from bitmaps and not from sorting: 64 ids share a word of bits, only words with a bit
are kept, and a directory of counts, a tree of nodes with at most 4096 children, gives the rows before each word. The place is
what stands before the word plus the bits below the id. Leaves then go to slots of blocks keyed by their place, and a block
of ten levels becomes one node, until one is left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.text import stored

#: Bits of an id within a word, and of a word's number at each level of the directory.
WORD_BITS, NODE_BITS = 6, 12
#: Levels of the tree that a block holds: 1024 slots.
BLOCK_BITS = 10


def field(value: Column) -> Column:
    """A value as its count of UTF-8 bytes, a colon and the text; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def places(rows: DataFrame, group: str, id: str, order: list[str]) -> DataFrame:
    """Adds ``place``, how many rows of the group come before by ``id``, and ``group_size``. Null is a group; null ids come first.

    Rows that share an id are told apart by ``order``; only words that hold such rows are sorted, each by itself.
    """
    g, word = F.col(group), F.shiftright(F.col(id), WORD_BITS)
    low = rows.agg(F.min(word).alias("a"), F.max(word).alias("z")).first()
    least = (low.a or 0) - 1  # the word of null ids
    span = max((low.z or 0) - least, 1)
    keyed = rows.withColumn("__w", F.coalesce(word - F.lit(least), F.lit(0)))
    bit = F.coalesce(F.expr(f"shiftleft(1L, cast(`{id}` & 63 as int))"), F.lit(0).cast("long"))
    words = stored(keyed.groupBy(g.alias("__g"), "__w").agg(F.bit_or(bit).alias("__bits"), F.count("*").alias("__n")), "words")
    levels = -(-span.bit_length() // NODE_BITS)
    # counts of the nodes, from the words up; then what stands before each, from the top down
    nodes = [words.select("__g", "__w", "__n")]
    for _ in range(levels):
        nodes.append(nodes[-1].groupBy("__g", F.shiftright("__w", NODE_BITS).alias("__w")).agg(F.sum("__n").alias("__n")))
    before = nodes[-1].select("__g", F.col("__w").alias("__up"), F.lit(0).cast("long").alias("__b0"))
    for level in reversed(nodes[:-1]):
        inside = Window.partitionBy("__g", "__up").orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
        own = level.withColumn("__up", F.shiftright("__w", NODE_BITS)).withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        own = own.withColumnRenamed("__g", "__h").withColumnRenamed("__up", "__u")
        met = own.join(before, F.col("__h").eqNullSafe(F.col("__g")) & (F.col("__u") == F.col("__up")))
        before = met.select("__g", F.col("__w").alias("__up"), (F.col("__b0") + F.col("__in")).alias("__b0"))
    sizes = nodes[-1].select(F.col("__g").alias("__s"), F.col("__n").alias("group_size"))
    ranked = before.join(sizes, F.col("__g").eqNullSafe(F.col("__s"))).drop("__s")
    ranked = ranked.join(words.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__up") == F.col("__w"))).drop("__h", "__w")
    directory = stored(ranked, "directory")
    found = keyed.join(directory, g.eqNullSafe(F.col("__g")) & (F.col("__w") == F.col("__up")))
    single = F.bit_count("__bits") == F.col("__n")
    at = f"cast(`{id}` & 63 as int)"
    below = F.bit_count(F.col("__bits").bitwiseAND(F.expr(f"if({at} = 0, 0L, shiftrightunsigned(-1L, 64 - {at}))")))
    names = [*rows.columns, "place", "group_size"]
    alone = found.filter(single).withColumn("place", F.col("__b0") + below)
    shared = found.filter(~single).withColumn("place", F.col("__b0") + F.row_number().over(Window.partitionBy("__g", "__up").orderBy(F.asc_nulls_first(id), *order)) - 1)
    return alone.select(names).unionByName(shared.select(names))


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    """A block's nodes level by level: each two consecutive ones, at the end maybe one, become their digest."""
    out = [nodes]
    for _ in range(height):
        at = out[-1]
        out.append([_digest(at[i : i + 2]) for i in range(0, len(at), 2)])
    return out


def _siblings(levels: list[list[str]], slot: int) -> list[str]:
    """From a slot up: L or R and the digest of the sibling, or N where a node is alone in its run."""
    found = []
    for at in levels[:-1]:
        i = slot ^ 1
        found.append(("L" if slot & 1 else "R") + at[i] if i < len(at) else "N")
        slot >>= 1
    return found


def split_path(path: str) -> list[str]:
    return re.findall("[LR][0-9a-f]{64}|N", path)


def fold(leaf: str, siblings: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for s in siblings:
        leaf = _digest([leaf] if s == "N" else [s[1:], leaf] if s[0] == "L" else [leaf, s[1:]])
    return leaf


def _height(size: Column) -> Column:
    """Levels of a tree with so many leaves."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (g, place, height, digest, ...) and, ten levels up each, what they become, until every tree is one node. A block of slots is one group of at most 1024 rows."""

    def block_top(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        h = int(p["height"].iloc[0])
        top = _levels(list(p["digest"]), min(h, BLOCK_BITS))[-1][0]
        return pd.DataFrame({"g": p["g"].iloc[:1], "place": p["place"].iloc[:1] // (1 << BLOCK_BITS), "height": [max(h - BLOCK_BITS, 0)], "digest": [top]})

    tables, tallest = [nodes], nodes.agg(F.max("height")).first()[0] or 0
    while tallest > 0:
        block = F.shiftright("place", BLOCK_BITS).alias("block")
        due = tables[-1].select("g", "place", "height", "digest").groupBy("g", block)
        tables.append(stored(due.applyInPandas(block_top, "g string, place long, height int, digest string"), "nodes"))
        tallest -= BLOCK_BITS
    return tables


def _opener(names: list[str]):
    """A function of a block's nodes and its own row (path, subroot, root): the nodes with their paths and ``names``."""

    def open_(p: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        levels, above = _levels(list(p["digest"]), min(int(p["height"].iloc[0]), BLOCK_BITS)), up["path"].iloc[0]
        paths = ["".join(_siblings(levels, k)) + above for k in range(len(p))]
        return p[["g", "place", "digest", *names]].assign(path=paths, subroot=up["subroot"].iloc[0], root=up["root"].iloc[0])

    return open_


def _descend(tables: list[DataFrame], top: DataFrame, extra: str) -> DataFrame:
    """From (g, place 0, path, subroot, root) of the trees' tops to the same of the first table's nodes, with its columns ``extra`` (a schema)."""
    for level, nodes in reversed(list(enumerate(tables[:-1]))):
        more = extra if level == 0 else ""
        names = [c.split()[0] for c in more.split(",") if c]
        schema = "g string, place long, digest string, " + (more + ", " if more else "") + "path string, subroot string, root string"
        left = nodes.select("g", "place", "height", "digest", *names).groupBy("g", F.shiftright("place", BLOCK_BITS).alias("block"))
        right = top.select("g", "place", "path", "subroot", "root").groupBy("g", F.col("place").alias("block"))
        top = left.cogroup(right).applyInPandas(_opener(names), schema)
    return top


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``id``, leaf, subroot, root, proof_sha256, folded_root, verified, and ``path``, the siblings themselves.

    A leaf is the digest of ``columns``. Leaves of a group ascend by ``id``, and every two consecutive nodes become the digest of
    both, a lone last one of itself, up to the group's subroot; subroots, in the order of their groups' UTF-8 bytes, likewise
    become the root. ``tampered`` maps columns to what they are when the root is folded again from leaf and path; a row whose
    columns are unchanged, or null there, folds to the root.

    Null is a group and comes first, so do null ids within one. Null columns count as ``-``, empty texts as ``0:``. Rows with
    equal ids follow each other by leaf, then by their place in the table, so repeated rows are leaves each. Further columns are
    ignored. An empty table gives an empty result. Groups are taken as few: their order is found in one task.
    """
    change = tampered or {}
    own = [F.col(c) for c in columns]
    other = [change.get(c, F.col(c)) for c in columns]
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    touched = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(x) for c, x in change.items()], F.lit(False))
    leaves = docs.select(F.col(id).alias("doc_id"), key.alias("g"), leaf_hash(own).alias("digest"), F.when(touched, leaf_hash(other)).alias("bad"))
    leaves = stored(leaves, "leaves").withColumn("__row", F.monotonically_increasing_id())
    placed = places(leaves, "g", "doc_id", ["digest", "__row"])
    nodes = stored(placed.select("g", "place", _height(F.col("group_size")).alias("height"), "digest", "doc_id", "bad"), "placed")
    tables = _climb(nodes)
    subroots = tables[-1].select("g", "digest")
    n = subroots.count()
    rank = F.row_number().over(Window.orderBy("g")) - 1
    over = stored(subroots.select(F.lit("").alias("g"), rank.cast("long").alias("place"), _height(F.lit(n)).alias("height"), "digest", F.col("g").alias("name")), "subroots")
    upper = _climb(over)
    root = upper[-1].select("g", "place", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    if len(upper) == 1:
        tops = root.crossJoin(over.select("name", "digest"))
    else:
        tops = _descend(upper, root, "name string")
    tops = stored(tops.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"), "tops")

    def prove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            paths = [split_path(x) for x in p["path"]]
            folded = [fold(leaf if bad is None else bad, x) for leaf, bad, x in zip(p["digest"], p["bad"].where(p["bad"].notna(), None), paths, strict=True)]
            proof = [_digest([s[1:] for s in x]) for x in paths]
            out = p[["doc_id", "digest", "subroot", "root"]].rename(columns={"digest": "leaf"})
            yield out.assign(proof_sha256=proof, folded_root=folded, verified=[a == b for a, b in zip(folded, p["root"], strict=True)], path=p["path"])

    kind = docs.select(F.col(id).cast("long").alias("doc_id")).schema["doc_id"].dataType.simpleString()
    if len(tables) > 1:
        opened = _descend(tables, tops, f"doc_id {kind}, bad string")
    else:  # no group has two leaves
        opened = nodes.join(tops.drop("place"), "g")
    out = opened.select("doc_id", "digest", "bad", "path", "subroot", "root")
    return out.mapInPandas(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string")
