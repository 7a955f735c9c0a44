"""Merkle manifest of a dataset, with a proof for every row, by pointer jumping.

A row is a leaf: the sha256 of its fields. Leaves stand in order within their group; every
``fan`` consecutive nodes become their parent until one, the group's subroot, is left.
Subroots in group order make one more tree, whose top is the root. A digest is hashed as
its 64 hex digits; tables hold its 32 bytes.

Every node knows an ancestor and a segment: the siblings on its way there, per level those
to the left and to the right of the path. At first the ancestor is the parent. A round
joins all nodes with their ancestors, takes over the ancestor's ancestor and appends its
segment, which doubles the distance, so a tree of depth d is done after log2(d) rounds.
Nodes whose ancestor is the root rest. A leaf's segment is its proof.

At scale: places in a group come from ranges (``ordering``), so a group may hold any share
of all rows. A run has at most ``fan`` rows, partial lists are combined before the
shuffle, and a level has a ``fan``-th of the rows of the one below. Ancestors of distance
d are few (a ``fan ** d``-th of all); they are sent to the executors only if their counted
bytes are small. Texts are hashed where they are read and not moved.

Defined results: a null field counts as ``-``; null ids stand first in their group, equal
ids are ordered by leaf, equal leaves are interchangeable and each row has its own place; a
null group is the first; a group of one row has its leaf as subroot; one group's subroot is
the root; a row without siblings has an empty proof; an empty table gives an empty result;
other columns are not read unless named as fields or carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from convoscope.llm.common import stage
from convoscope.llm.ordering import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Bytes of segments that may be sent to every executor.
SENT_BYTES = 8_000_000

_NODE = "struct<tree:bigint,level:int,i:bigint>"
_SEGMENT = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """Lower-case hex sha256 of the fields in order."""
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(children: Column) -> Column:
    """Their digests' bytes one after another."""
    return F.aggregate(children, F.lit(b""), lambda done, c: F.concat(done, c["digest"]))


def fold(digest: Column, segment: Column) -> Column:
    """The hex digest that a node of hex ``digest`` has at the end of a segment."""
    return F.aggregate(
        segment, digest,
        lambda at, s: F.sha2(F.concat(_hex(s["left"]), at, _hex(s["right"])).cast("binary"), 256),
    )


def segment_digest(segment: Column) -> Column:
    """Hex sha256 of a segment's siblings, level by level, left to right."""
    return F.sha2(
        F.array_join(F.transform(segment, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "").cast("binary"), 256
    )


def _node(tree: Column, level: int, i: Column) -> Column:
    return F.struct(tree.cast("bigint").alias("tree"), F.lit(level).alias("level"), i.cast("bigint").alias("i"))


def _grown(nodes: DataFrame, most: int, fan: int, name: str) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Trees over nodes ``(tree, i, n, id, digest, row)``, n the nodes of the tree's level.

    Gives the tops in the same form, the links ``(id, anc, seg, row)`` from every other
    node to its parent, and the number of levels; ``most`` is the largest n.
    """
    now, level, tops, links = nodes, 0, [], []
    while most > 1:
        up = F.floor(F.col("i") / fan).cast("bigint")
        runs = stage(
            now.where("n > 1").groupBy("tree", up.alias("up"), "n")
            .agg(F.collect_list(F.struct("i", "id", "digest", "row")).alias("children"))
            .withColumn("children", F.array_sort("children", lambda a, b: (a["i"] - b["i"]).cast("int"))),
            f"{name}-{level}",
        )
        tops.append(now.where("n = 1"))
        level += 1
        anc = _node(F.col("tree"), level, F.col("up"))
        seg = F.array(F.struct(
            _joined(F.slice("children", F.lit(1), F.col("k"))).alias("left"),
            _joined(F.slice("children", F.col("k") + 2, F.lit(fan))).alias("right"),
        ))
        links.append(
            runs.select(anc.alias("anc"), "children", F.posexplode("children").alias("k", "child"))
            .select("child.id", "anc", seg.alias("seg"), "child.row")
        )
        own = F.sha2(F.array_join(F.transform("children", lambda c: _hex(c["digest"])), "").cast("binary"), 256)
        now = runs.select(
            "tree", F.col("up").alias("i"), F.ceil(F.col("n") / fan).cast("bigint").alias("n"), anc.alias("id"),
            F.unhex(own).alias("digest"), F.lit(None).cast(nodes.schema["row"].dataType).alias("row"),
        )
        most = -(-most // fan)
    tops.append(now)
    return tops, links, level


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def proofs(rows: DataFrame, group: str, order: str, digest: str, fan: int = 8) -> tuple[DataFrame, str | None]:
    """Every row as ``row`` with its group's ``subroot`` (hex) and its ``segment`` up to the
    root; and the root (hex), None for an empty table. ``digest`` names the leaves, as bytes."""
    if fan < 2:
        raise ValueError(f"fan {fan}")
    leaves = stage(
        rows.select(
            F.col(group).cast("string").alias("of"), F.col(order).alias("at"), F.col(digest).alias("digest"),
            F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key"),
        ),
        "leaves",
    )
    places, groups = placed(leaves, [F.asc_nulls_first("of"), F.asc_nulls_first("at"), F.asc("digest"), F.asc("key")], "leaf-order", ["of"])
    trees, _ = placed(groups.withColumnRenamed("_size", "leaves"), [F.asc_nulls_first("of")], "groups")
    trees = stage(trees.select(F.col("of").alias("tree_of"), F.col("_pos").alias("tree"), "leaves"), "trees")
    n_trees, most = trees.agg(F.count("*"), F.max("leaves")).first()
    if not n_trees:
        empty = leaves.where("false")
        return empty.select("row", F.lit("").alias("subroot"), F.expr(f"cast(array() as {_SEGMENT})").alias("segment")), None
    nodes = places.join(trees, F.col("of").eqNullSafe(F.col("tree_of"))).select(
        "tree", F.col("_pos").alias("i"), F.col("_size").alias("n"), _node(F.col("tree"), 0, F.col("_pos")).alias("id"),
        "digest", "row",
    )
    tops, links, depth = _grown(nodes, most, fan, "runs")
    subroots = stage(_all(tops), "subroots")
    upper = subroots.select(
        F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("i"), F.lit(n_trees).cast("bigint").alias("n"),
        "id", "digest", "row",
    )
    last, above, more = _grown(upper, n_trees, fan, "upper-runs")
    # One node is left: the top of the upper tree.
    top = last[-1].select("id", _hex(F.col("digest")).alias("root"), "row").first()
    root_id = F.lit(None).cast(_NODE) if top is None else F.struct(
        F.lit(top["id"]["tree"]).cast("bigint").alias("tree"), F.lit(top["id"]["level"]).cast("int").alias("level"),
        F.lit(top["id"]["i"]).cast("bigint").alias("i"),
    )
    alone = last[-1].where(F.col("row").isNotNull()).select("id", "row", F.expr(f"cast(array() as {_SEGMENT})").alias("seg"))
    finished = [alone]
    columns = ["id", "anc", "seg", "row"]
    if links + above:
        inner = F.col("id.level") > 0
        jump = _all([f.select(columns) for f in links + above])
        below, inside = stage(jump.where(~inner), "leaf-links"), stage(jump.where(inner).drop("row"), "inner-links")
        distance = 1
        while True:
            arrived = F.col("anc") == root_id
            finished.append(below.where(arrived).select("id", "row", "seg"))
            if distance >= depth + more:
                break
            # Ancestors that far away, with what stands between them and theirs.
            over = inside.where((F.col("id.tree") < 0) | (F.col("id.level") >= distance)).select(
                F.col("id").alias("met"), F.col("anc").alias("next_anc"), F.col("seg").alias("next_seg")
            )
            if over.count() * distance * fan * 32 <= SENT_BYTES:
                over = F.broadcast(over)
            doubled = [
                side.where(~arrived).join(over, F.col("anc") == F.col("met"))
                .withColumn("anc", F.col("next_anc")).withColumn("seg", F.concat("seg", "next_seg")).drop("met", "next_anc", "next_seg")
                for side in (below, inside)
            ]
            distance *= 2
            if distance < depth + more:
                below = stage(doubled[0], "leaf-links")
                inside = stage(inside.where(arrived).unionByName(doubled[1]), "inner-links")
            else:
                below = doubled[0]
    done = _all(finished)
    named = subroots.select(F.col("tree").alias("own"), _hex(F.col("digest")).alias("subroot"))
    out = done.join(named, F.col("id.tree") == F.col("own"))
    return out.select("row", "subroot", F.col("seg").alias("segment")), top["root"]


def tampered_leaf(fields: Sequence[str], changed: Column, text: str = "text") -> Column:
    """The leaf of a row whose text is ASCII lower-cased where ``changed`` holds, else null."""
    lower = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(changed, leaf([lower if f == text else F.col(f) for f in fields]))


def manifest(docs: DataFrame, changed: Column, fan: int = 8) -> DataFrame:
    """Per document ``doc_id, leaf, subroot, root, proof_sha256``, and what a check of the
    document finds after its text was ASCII lower-cased where ``changed`` holds:
    ``folded_root`` (that leaf folded with the original siblings) and ``verified``."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.unhex(leaf([F.col(f) for f in FIELDS])).alias("leaf"), F.unhex(tampered_leaf(FIELDS, changed)).alias("other"),
    )
    found, root = proofs(rows, "lang", "doc_id", "leaf", fan)
    seen = _hex(F.coalesce("row.other", "row.leaf"))
    out = found.select(
        "row.doc_id", _hex(F.col("row.leaf")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        segment_digest(F.col("segment")).alias("proof_sha256"), fold(seen, F.col("segment")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
