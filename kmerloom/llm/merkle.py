"""Merkle manifest of a dataset as postorder append logs.

A row is a leaf; the leaves of a group, in the order of their keys, are the
leaves of a tree in which every three nodes in a row become one, and the
trees' roots, in the order of the groups, are the leaves of one more tree.

A tree is written by aligned builders: each takes the leaves below one node
at a height that is a multiple of ``HEIGHT`` and appends nodes as they are
complete, children before parents.  So its log is a run of the tree's
postorder, a row a builder, and the top is its last node; tops are the
leaves of the next builders.  The place of any node in postorder follows
from the sizes of the subtrees before it (``position``), which is how proofs
find the siblings on a leaf's way to the root: in bulk inside the builders'
logs, top down (``proofs``), or for some leaves in the log of the whole tree
(``prove``).  A builder holds at most ``ARITY ** HEIGHT`` leaves at a time, and the
driver sees counts only.

Digests are SHA-256 of their inputs in a row, digests among them as hex text.
A leaf hashes its columns: ``-`` for null, else the number of UTF-8 bytes, a
colon and the value, integers as decimals.

Defined results: a null group is a group of its own, before all others; null
keys come first in their group; rows of one key are ordered by their digests,
and repeated rows are leaves each; an empty table has no rows and no root; a
lone leaf is its own root and its proof hashes the empty text; other columns
do not matter, whatever their names.  Where two divides the crc32 of the
key's text (empty for null) a row can be tampered with: the line feeds of its
text are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import key_mod, shared_dir, small_batches, written

ARITY = 3
#: Levels of nodes that a builder adds above its leaves: 729 leaves a builder.
HEIGHT = 6
#: Columns that a leaf hashes, in this order (fixed).
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_BYTES = 32


def node(children: list[bytes]) -> bytes:
    """The digest of nodes in a row."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def levels(n: int) -> int:
    """How many levels a tree of ``n`` leaves has above them."""
    out = 0
    while n > 1:
        n = -(-n // ARITY)
        out += 1
    return out


def level_sizes(n: int, height: int) -> list[int]:
    """Nodes of each level, the leaves' first."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out


def position(level, index, n: int, height: int | None = None):
    """Place in postorder of the ``index``-th node of a level; arrays give arrays.

    Complete before it are, of each lower level, all nodes up to the end of
    its own subtree, of its own level all before it, and of each higher level
    those whose subtrees end before it begins.
    """
    level, index = np.broadcast_arrays(np.asarray(level, np.int64), np.asarray(index, np.int64))
    out = np.zeros(level.shape, np.int64)
    for j, size in enumerate(level_sizes(n, levels(n) if height is None else height)):
        below = np.minimum((index + 1) * ARITY ** np.maximum(level - j, 0), size)
        above = index // ARITY ** np.maximum(j - level, 0)
        out += np.where(j < level, below, above)
    return out


def siblings(index, n: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels and places in postorder of the others of each run on the way up from leaves, left to right (-1: no such node)."""
    index = np.asarray(index, np.int64)
    at = []
    for level, size in enumerate(level_sizes(n, height)[:-1]):
        own = index // ARITY**level
        first = own // ARITY * ARITY
        for c in range(ARITY - 1):
            other = first + c
            other = other + (other >= own)
            here = (other < size) & (other < first + ARITY)
            at.append(np.where(here, position(level, np.where(here, other, 0), n, height), -1))
    return np.repeat(np.arange(height), ARITY - 1), np.stack(at, 1) if at else np.zeros((len(index), 0), np.int64)


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a subtree in the order in which they are complete."""
    open_: list[list[bytes]] = [[] for _ in range(height + 1)]
    log: list[bytes] = []

    def append(level: int, digest: bytes) -> None:
        log.append(digest)
        if level < height:
            open_[level].append(digest)
            if len(open_[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        append(level + 1, node(run))

    for leaf in leaves:
        append(0, leaf)
    for level in range(height):
        if open_[level]:
            close(level)
    return log


def fold(digest: bytes, index: int, n: int, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and the siblings of its path make, and what is left of the path."""
    while n > 1:
        own = index % ARITY
        run = min(ARITY, n - (index - own))
        others = [path[i * _BYTES : (i + 1) * _BYTES] for i in range(run - 1)]
        path = path[(run - 1) * _BYTES :]
        digest = node([*others[:own], digest, *others[own:]])
        index, n = index // ARITY, -(-n // ARITY)
    return digest, path


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The digest (binary) of a row's columns."""
    return F.unhex(F.sha2(F.concat(*map(_field, columns)), 256))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``i``, their place in their tree by ``order``, and ``n``, the tree's size.

    Rows are dealt into sorted ranges; what a tree has in the ranges before
    comes from a table of trees by ranges.  ``order`` must tell rows apart.
    """
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    per = dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    every = Window.partitionBy(tree)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "n": F.sum("_size").over(every)})
    found = dealt.join(per.drop("_size"), [tree, "_part"])
    return found.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("i"), "n")


def _build(rows: DataFrame, payload: str, height: int) -> DataFrame:
    """Builders' logs of one height: ``tree``, ``block``, ``n`` (nodes of the tree at this height), ``log`` and the payload of each node below."""

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("i")
        n = int(batch["n"].iloc[0])
        log = append_log([bytes(x) for x in batch["digest"]], min(height, levels(n)))
        head = {"tree": batch["tree"].iloc[:1].tolist(), "block": [int(batch["i"].iloc[0]) // ARITY**height], "n": [n], "log": [b"".join(log)]}
        return pd.DataFrame(head | {"payload": [[x if x == x else None for x in batch["payload"]]]})

    kind = rows.schema[payload].dataType.simpleString()
    given = rows.select("tree", "i", "n", "digest", F.col(payload).alias("payload"), F.expr(f"i div {ARITY**height}").alias("_block"))
    return given.groupBy("tree", "_block").applyInPandas(build, f"tree string, block bigint, n bigint, log binary, payload array<{kind}>")


def grow(rows: DataFrame, payload: str, height: int = HEIGHT) -> list[DataFrame]:
    """The logs of trees over ``rows`` (``tree``, ``i``, ``n``, ``digest`` and a payload column), written, lowest builders first."""
    most = rows.agg(F.max("n")).first()[0] or 0
    base, out = shared_dir(rows.sparkSession), []
    while not out or most > 1:
        out.append(written(_build(rows, "i" if out else payload, height), f"{base}/{len(out)}"))
        most = -(-most // ARITY**height)
        # every tree has a log in every pass: a tree of one node adds nothing
        rows = tops(out[-1]).select("tree", F.col("block").alias("i"), F.expr(f"(n + {ARITY**height - 1}) div {ARITY**height}").alias("n"), "digest")
    return out


def tops(logs: DataFrame) -> DataFrame:
    """The last node of each builder's log."""
    return logs.select("tree", "block", "n", F.substring("log", -_BYTES, _BYTES).alias("digest"))


def proofs(logs: list[DataFrame], above: DataFrame, carried: dict[str, str], height: int = HEIGHT) -> DataFrame:
    """Per leaf: ``tree``, ``i``, ``n``, ``digest``, ``payload``, ``root`` (its tree's), ``path`` (siblings up to and with ``above``'s).

    ``above`` has ``tree``, ``path`` and the ``carried`` columns (name: type)
    per tree, which go down to the leaves.
    """
    names = ", ".join(f"{c} {kind}" for c, kind in carried.items())
    top = above.withColumns({"block": F.lit(0).cast("long"), "root": F.lit(None).cast("binary")})
    for depth, table in reversed(list(enumerate(logs))):

        def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    here = len(r.payload)
                    nodes = [r.log[a : a + _BYTES] for a in range(0, len(r.log), _BYTES)]
                    here_levels = min(height, levels(int(r.n)))
                    own = position(0, np.arange(here), here, here_levels)
                    _, at = siblings(np.arange(here), here, here_levels)
                    out = {
                        "tree": r.tree,
                        "i": np.arange(here) + int(r.block) * ARITY**height,
                        "n": int(r.n),
                        "digest": [nodes[p] for p in own],
                        "payload": list(r.payload),
                        "root": [nodes[-1] if r.root is None else r.root] * here,
                        "path": [b"".join(nodes[p] for p in way if p >= 0) + r.path for way in at.tolist()],
                    }
                    yield pd.DataFrame(out | {c: [getattr(r, c)] * here for c in carried})

        kind = table.schema["payload"].dataType.elementType.simpleString()
        columns = f"tree string, i bigint, n bigint, digest binary, payload {kind}, root binary, path binary" + (f", {names}" if names else "")
        found = table.join(top, ["tree", "block"]).mapInPandas(descend, columns)
        if depth:
            top = found.select("tree", F.col("payload").alias("block"), "root", "path", *carried)
    return found


def node_log(logs: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """The whole logs: ``tree``, ``position`` (in the tree's postorder), ``level``, ``index`` and ``digest`` of every node."""
    out = None
    for depth, table in enumerate(logs):
        leaves_of = logs[0].groupBy("tree").agg(F.max("n").alias("leaves"))  # equal in all of a tree's logs

        def place(batches: Iterator[pd.DataFrame], lowest: int = depth * height) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    here_levels = min(height, levels(int(r.n)))
                    sizes = level_sizes(int(r.here), here_levels)
                    level = np.repeat(np.arange(here_levels + 1), sizes)
                    index = np.concatenate([np.arange(s) for s in sizes])
                    at = position(level, index, int(r.here), here_levels)
                    index = index + int(r.block) * ARITY ** (height - level)
                    some = level >= (lowest > 0)  # a builder's leaves are nodes of the builders below
                    digests = [r.log[a * _BYTES : (a + 1) * _BYTES] for a in at[some]]
                    whole = position(level[some] + lowest, index[some], int(r.leaves))
                    yield pd.DataFrame({"tree": r.tree, "position": whole, "level": level[some] + lowest, "index": index[some], "digest": digests})

        shaped = table.select("tree", "block", "n", "log", F.size("payload").alias("here")).join(leaves_of, "tree")
        part = shaped.mapInPandas(place, "tree string, position bigint, level int, index bigint, digest binary")
        out = part if out is None else out.union(part)
    return out


def prove(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """``tree``, ``i``, ``path`` of some leaves (``tree``, ``i``, ``n``): their siblings are taken from the whole log by position."""

    def address(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                _, at = siblings([int(r.i)], int(r.n), levels(int(r.n)))
                at = at[0][at[0] >= 0]
                yield pd.DataFrame({"tree": r.tree, "i": int(r.i), "step": np.arange(len(at)), "position": at})

    asked = wanted.mapInPandas(address, "tree string, i bigint, step int, position bigint")
    found = asked.join(log.select("tree", "position", "digest"), ["tree", "position"])
    steps = F.array_sort(F.collect_list(F.struct("step", "digest")))  # two nodes a level
    paths = found.groupBy("tree", "i").agg(F.aggregate(steps, F.lit(b""), lambda s, x: F.concat(s, x["digest"])).alias("path"))
    return wanted.select("tree", "i").join(paths, ["tree", "i"], "left").withColumn("path", F.coalesce("path", F.lit(b"")))


def tree_of(group: Column) -> Column:
    """A group's tree: a name that is never null and sorts as the groups do, the null group first."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, text: str = "text", height: int = HEIGHT) -> DataFrame:
    """Per row: key, ``leaf``, ``subroot``, ``root``, ``path`` (siblings' digests in a row), ``folded_root`` and ``verified``.

    All but the key and ``verified`` are binary.  ``folded_root`` comes from
    the leaf of the row as it is after tampering, where that happens.
    """
    small_batches(docs.sparkSession)
    given = [F.col(c) for c in columns]
    deleted = [F.replace(c, F.lit("\n"), F.lit("")) if name == text else c for name, c in zip(columns, given, strict=True)]
    changed = F.when(key_mod(F.col(key), 2) == 0, leaf(*deleted))
    rows = docs.select(F.col(key).cast("long").alias("key"), tree_of(F.col(group)).alias("tree"), leaf(*given).alias("digest"), changed.alias("changed"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    leaves = numbered(rows, "tree", "key", "digest", "row")
    # the payload of a leaf is its key in eight bytes, if it has one, behind a tampered leaf, if there is one
    packed = F.concat(
        F.when(F.col("key").isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), F.unhex(F.lpad(F.hex("key"), 16, "0")))),
        F.coalesce("changed", F.lit(b"")),
    )
    logs = grow(leaves.withColumn("packed", packed), "packed", height)
    roots = tops(logs[-1]).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = grow(numbered(roots, "tree", "name"), "name", height)
    over = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(b"").alias("path"))
    way = proofs(upper, over, {}, height)
    above = way.select(F.col("payload").alias("tree"), "path", F.col("i").alias("tree_i"), F.col("n").alias("trees"), F.col("root").alias("whole"))
    sizes = logs[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    above = above.join(sizes, "tree")
    carried = {"tree_i": "bigint", "trees": "bigint", "whole": "binary", "leaves": "bigint"}

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = []
            for r in batch.itertuples():
                packed = r.payload
                digest = packed[9:] if packed[0] else packed[1:]
                digest, rest = fold(digest or r.digest, int(r.i), int(r.leaves), r.path)
                folded.append(fold(digest, int(r.tree_i), int(r.trees), rest)[0])
            keys = [int.from_bytes(p[1:9], "big", signed=True) if p[0] else None for p in batch["payload"]]
            out = {"key": pd.array(keys, "Int64"), "leaf": batch["digest"], "subroot": batch["root"], "root": batch["whole"], "path": batch["path"], "folded_root": folded}
            yield pd.DataFrame(out)

    found = proofs(logs, above, carried, height).mapInPandas(check, "key bigint, leaf binary, subroot binary, root binary, path binary, folded_root binary")
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)
