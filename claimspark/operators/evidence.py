"""Tamper evidence: hashes of rows, Merkle roots and proofs, checkpoints and receipts.

Leaves are hashed in Spark. The tree is the one of RFC 6962: a node is the hash of 0x01 and its two
children, a level's last odd node moves up unchanged. Levels are built by a group-by on half the
index, so no task holds the leaves; a proof reads one node of each level.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .recursion import written

EMPTY = hashlib.sha256(b"").hexdigest()


def leaf(data: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), data), 256)


def leaves(rows: DataFrame, order: str, columns: list[str], width: int = 1 << 16) -> DataFrame:
    """idx (from 0, in order, by two passes of counting) and hash of each row."""
    text = F.to_json(F.struct(*columns))
    cut = rows.select(F.col(order).alias("__o"), F.floor(F.col(order) / width).alias("__range"), leaf(text.cast("binary")).alias("hash"))
    counts = cut.groupBy("__range").count()
    before = counts.select("__range", F.coalesce(F.sum("count").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range").orderBy("__o", "hash")) - 1
    return cut.withColumn("__n", place).join(before, "__range").select((F.col("__before") + F.col("__n")).alias("idx"), "hash")


def parents(level: DataFrame) -> DataFrame:
    """The level above."""
    left, right = (F.max(F.when(F.col("idx") % 2 == side, F.col("hash"))) for side in (0, 1))
    both = level.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(left.alias("l"), right.alias("r"))
    node = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("l"), F.unhex("r")), 256)
    return both.select("idx", F.when(F.col("r").isNull(), F.col("l")).otherwise(node).alias("hash"))


def levels(bottom: DataFrame, small: int = 1024) -> tuple[list[DataFrame], list[list[str]]]:
    """The levels as tables, and, once one has at most ``small`` nodes, the rest on the driver."""
    made = [written(bottom, "merkle")]
    size = made[0].count()
    while size > small:
        made.append(written(parents(made[-1]), "merkle"))
        size = (size + 1) // 2
    top = [r.hash for r in made[-1].orderBy("idx").collect()]
    rest = [top]
    while len(rest[-1]) > 1:
        rest.append(above(rest[-1]))
    return made, rest


def above(hashes: list[str]) -> list[str]:
    pairs = [hashes[i : i + 2] for i in range(0, len(hashes), 2)]
    return [hashlib.sha256(b"\x01" + bytes.fromhex(p[0]) + bytes.fromhex(p[1])).hexdigest() if len(p) == 2 else p[0] for p in pairs]


Tree = tuple[list[DataFrame], list[list[str]]]


def top_of(tree: Tree) -> str:
    return tree[1][-1][0] if tree[1][-1] else EMPTY


def root(bottom: DataFrame) -> str:
    return top_of(levels(bottom))


def nodes(tree: Tree, wanted: list[tuple[int, int]]) -> list[str | None]:
    """The hashes at some (level, index), each level read once; None where there is no such node."""
    made, rest = tree
    found: dict[tuple[int, int], str] = {}
    for depth in {level for level, _ in wanted}:
        ask = sorted({at for level, at in wanted if level == depth})
        if depth < len(made) - 1:
            found |= {(depth, r.idx): r.hash for r in made[depth].where(F.col("idx").isin(ask)).collect()}
        elif depth - len(made) + 1 < len(rest):
            row = rest[depth - len(made) + 1]
            found |= {(depth, at): row[at] for at in ask if at < len(row)}
    return [found.get(w) for w in wanted]


def inclusion(tree: Tree, idx: int) -> list[tuple[str, str]]:
    """(side, hash) of the neighbours on the way up from a leaf."""
    depth = len(tree[0]) + len(tree[1]) - 2
    ways = [(level, idx >> level) for level in range(depth)]
    others = nodes(tree, [(level, at ^ 1) for level, at in ways])
    return [("left" if at % 2 else "right", other) for (_, at), other in zip(ways, others, strict=True) if other is not None]


def covering(begin: int, end: int) -> tuple[int, int]:
    """The (level, index) of the node over leaves ``begin`` to ``end``, which a split of the tree made."""
    level = (end - begin - 1).bit_length()
    return level, begin >> level


def consistency(tree: Tree, before: int, size: int) -> list[str]:
    """What shows that the tree of the first ``before`` leaves grew into the one of all ``size``."""
    if not 0 < before <= size:
        raise ValueError("an earlier tree has at least one leaf, and no more than the later one")
    begin, end, whole, out = 0, size, True, []
    while before != end:
        half = 1 << (end - begin - 1).bit_length() - 1
        if before - begin <= half:
            out.append(covering(begin + half, end))
            end = begin + half
        else:
            out.append(covering(begin, begin + half))
            begin, whole = begin + half, False
    if not whole:
        out.append(covering(begin, end))
    return nodes(tree, out[::-1])


def verify_consistency(before: int, size: int, old: str, new: str, proof: list[str]) -> bool:
    """Whether a tree of ``size`` leaves with root ``new`` starts with the ``before`` leaves of root ``old``."""
    if before == size:
        return not proof and old == new
    both = lambda a, b: hashlib.sha256(b"\x01" + a + b).digest()
    path = [bytes.fromhex(p) for p in proof]
    if before & (before - 1) == 0:
        path.insert(0, bytes.fromhex(old))
    if not path:
        return False
    at, last = before - 1, size - 1
    while at & 1:
        at, last = at >> 1, last >> 1
    mine = theirs = path[0]
    for other in path[1:]:
        if not last:
            return False
        if at & 1 or at == last:
            mine, theirs = both(other, mine), both(other, theirs)
            while not at & 1 and at:
                at, last = at >> 1, last >> 1
        else:
            theirs = both(theirs, other)
        at, last = at >> 1, last >> 1
    return mine.hex() == old and theirs.hex() == new and not last


def frontier(tree: Tree, size: int) -> list[tuple[int, str]]:
    """(level, hash) of the full subtrees that ``size`` leaves make, left to right: all that appending needs."""
    wanted, begin = [], 0
    for level in reversed(range(size.bit_length())):
        if size >> level & 1:
            wanted.append((level, begin >> level))
            begin += 1 << level
    return [(level, h) for (level, _), h in zip(wanted, nodes(tree, wanted), strict=True)]


def grown(front: list[tuple[int, str]], leaf_hash: str) -> list[tuple[int, str]]:
    """The frontier after one more leaf."""
    level, at, out = 0, leaf_hash, list(front)
    while out and out[-1][0] == level:
        at = above([out.pop()[1], at])[0]
        level += 1
    return [*out, (level, at)]


def root_of_frontier(front: list[tuple[int, str]]) -> str:
    at = None
    for _, h in reversed(front):
        at = h if at is None else above([h, at])[0]
    return at or EMPTY


def verify(leaf_hash: str, proof: list[tuple[str, str]], root_hash: str) -> bool:
    at = bytes.fromhex(leaf_hash)
    for side, other in proof:
        pair = (bytes.fromhex(other), at) if side == "left" else (at, bytes.fromhex(other))
        at = hashlib.sha256(b"\x01" + b"".join(pair)).digest()
    return at.hex() == root_hash


def checkpoint(previous: str | None, covered: int, root_hash: str) -> str:
    """A link of the chain of checkpoints."""
    return hashlib.sha256(f"{previous or ''}|{covered}|{root_hash}".encode()).hexdigest()


def programme_hash(programme) -> str:
    """What a programme says, as a hash: the same for the same declarations."""
    return "sha256:" + hashlib.sha256(repr(programme).encode()).hexdigest()


def set_hash(answer: DataFrame) -> str:
    """Hash of an answer as a bag of rows, whatever their order.

    A tree over prefixes of the rows' hashes: equal rows are counted first, and no group has more
    than 16 ** 4 members, so none grows with the answer.
    """
    level = answer.select(F.sha2(F.to_json(F.struct("*")).cast("binary"), 256).alias("h")).groupBy("h").count()
    level = level.select(F.col("h").alias("p"), F.concat_ws(":", "h", "count").alias("h"))
    for n in (12, 8, 4, 0):
        level = level.groupBy(F.substring("p", 1, n).alias("p")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("h"))), 256).alias("h"))
    first = level.first()
    return first.h if first else EMPTY


def receipt(answer: DataFrame, programme, checkpoint_hash: str) -> str:
    """Binds an answer to the programme and the checkpoint that it was read at."""
    return hashlib.sha256(f"{programme_hash(programme)}|{checkpoint_hash}|{set_hash(answer)}".encode()).hexdigest()


def pack(rows: DataFrame, order: str, columns: list[str], path: str, upto: int) -> dict:
    """Export the rows up to a position; what is returned proves them."""
    part = rows.where(F.col(order) <= upto).select(order, *(c for c in columns if c != order))
    part.write.parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    return {"covered": upto, "rows": stored.count(), "root": root(leaves(stored, order, columns))}


def verify_pack(stored: DataFrame, order: str, columns: list[str], told: dict) -> bool:
    """Whether a pack is what was exported: no row changed, added, lost or moved."""
    return stored.count() == told["rows"] and root(leaves(stored, order, columns)) == told["root"]
