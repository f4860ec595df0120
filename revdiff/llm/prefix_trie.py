"""The trie of conversations' common beginnings, its subtrees summed along an Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import MASK, followed, in_order, ranges_for, running
from .storage import staged

#: Segments of the tour up to which they are ranked in one step on the driver (40 bytes each); more are ranked in Spark.
SEGMENTS = 1 << 16
#: Ids in a piece of a node's list of conversations.
IDS = 4096
_LEVELS, _BITS = 4, 15


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, n_bytes``: each turn's place from 1, two hashes of its role and text, the bytes of its text.

    ``turns`` needs ``conv_id`` and ``turn`` (bigint), ``role`` and ``text``; other columns are ignored.
    Order is by ``turn``, a null one first; turns of equal number are ordered by their hashes. Null role
    and text are empty; a repeated row is one more turn. Rows with a null ``conv_id`` belong to no conversation and are left out.
    An empty table gives no rows. A conversation may hold any part of all rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("again"), text, role).alias("t2"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.lit(1).cast("bigint").alias("pos"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("t1").asc(), F.col("t2").asc()]
    return running(rows, "conv_id", order, ["pos"]).select("conv_id", "pos", "t1", "t2", "n_bytes")


def rebuilt_turns(ordered: DataFrame, *, span: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c after the first turns of another one: ``ordered_turns`` of all, and ``conv_id`` of those left without turns.

    The first h turns are those of conversation ``c - c % span`` (all if it has fewer, none if there is no such
    one), then c's own turns after its first h follow; h is crc32 of the decimal c modulo ``most``.
    """
    convs = ordered.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = staged(convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % span).alias("base")))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    known = staged(known.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")))
    own = ordered.join(known.select("conv_id", "h", "m"), "conv_id").filter("pos > h").withColumn("pos", F.col("m") + F.col("pos") - F.col("h"))
    first = ordered.filter((F.col("pos") < most) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(known.select("base", "conv_id", "m"), "base").filter("pos <= m")
    columns = ["conv_id", "pos", "t1", "t2", "n_bytes"]
    return own.select(*columns).unionByName(first.select(*columns)), known.filter("total = 0").select("conv_id")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs of one range, each with the head of the segment it lies in and what stands before it there.

    A segment is a run of the tour inside the range. All arcs double the way to their head
    at once, so a run of n arcs takes log2(n) steps.
    """
    found = pa.Table.from_batches([b for b in batches if b.num_rows]) if (batches := list(batches)) else None
    if found is None or not found.num_rows:
        return
    arc, succ = found["arc"].to_numpy(), found["succ"].to_numpy()
    weight = np.stack([np.ones(len(arc), np.int64), found["leaf"].to_numpy(), found["save"].to_numpy()])
    order = np.argsort(arc)
    at = order[np.minimum(np.searchsorted(arc[order], succ), len(arc) - 1)]
    inside = arc[at] == succ
    head = np.arange(len(arc))
    head[at[inside]] = np.flatnonzero(inside)
    before = np.zeros_like(weight)
    before[:, at[inside]] = weight[:, inside]
    while (further := head[head]) is not None and (further != head).any():
        before = before + before[:, head]
        head = further
    yield pa.RecordBatch.from_arrays(
        [pa.array(arc), pa.array(arc[head]), *(pa.array(x) for x in before), pa.array(succ, mask=inside), *(pa.array(x) for x in before + weight)],
        names=["arc", "seg", "b_arcs", "b_leaf", "b_save", "out", "t_arcs", "t_leaf", "t_save"],
    )


def _rank(segments: DataFrame, limit: int) -> DataFrame:
    """``seg, p_arcs, p_leaf, p_save``: what stands before each segment on the whole tour.

    ``segments``: ``seg, next`` (the arc after its end, -1 at the tour's end) and its sums.
    """
    spark, sums = segments.sparkSession, ("arcs", "leaf", "save")
    schema = "seg bigint, p_arcs bigint, p_leaf bigint, p_save bigint"
    if segments.count() <= limit:
        t = segments.toArrow()
        seg, nxt = t["seg"].to_numpy(), t["next"].to_numpy()
        order = np.argsort(seg)
        at = order[np.minimum(np.searchsorted(seg[order], nxt), len(seg) - 1)]
        inside = nxt >= 0
        weight = np.stack([t[c].to_numpy() for c in sums])
        head = np.arange(len(seg))
        head[at[inside]] = np.flatnonzero(inside)
        before = np.zeros_like(weight)
        before[:, at[inside]] = weight[:, inside]
        while (further := head[head]) is not None and (further != head).any():
            before = before + before[:, head]
            head = further
        return F.broadcast(spark.createDataFrame(pa.table([t["seg"], *(pa.array(x) for x in before)], names=["seg", "p_arcs", "p_leaf", "p_save"]), schema))
    # every segment doubles the way to the tour's end; what stands before it is the whole less that
    jump = staged(segments)
    while jump.filter("next >= 0").limit(1).count():
        a, b = jump.alias("a"), jump.alias("b")
        jump = staged(a.join(b, F.col("a.next") == F.col("b.seg"), "left").select("a.seg", F.coalesce("b.next", F.lit(-1)).alias("next"), *((F.col(f"a.{c}") + F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c) for c in sums)))
    whole = jump.filter("seg = 0").first()
    return jump.select("seg", *((F.lit(whole[c]) - F.col(c)).alias(f"p_{c}") for c in sums))


def _ids_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, in order, joined to pieces of at most ``IDS`` ids."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        depth, k1, k2, first, text = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, pa.int64()), pa.array(text)], names=["depth", "k1", "k2", "first", "ids"])

    node, ids, out = None, [], []
    for batch in batches:
        for depth, k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (depth, k1, k2) != node or len(ids) == IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (depth, k1, k2), []
            ids.append(conv)
        if len(out) >= 1000:
            yield made(out)
            out = []
    if ids:
        yield made([*out, (*node, ids[0], ",".join(map(str, ids)))])


def _hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, in order, comma-joined, fed piece by piece."""
    node, state, out = None, None, []

    def made() -> pa.RecordBatch:
        depth, k1, k2, text = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(text)], names=["depth", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for depth, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (depth, k1, k2) != node:
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 1000:
            yield made()
            out = []
    if state is not None:
        out.append((*node, state.hexdigest()))
        yield made()


def trie(rows: DataFrame, turnless: DataFrame | None = None, *, segments: int = SEGMENTS) -> DataFrame:
    """The trie of sequences of turns, one row per node, the root included.

    ``rows`` as of ``ordered_turns``; ``turnless``: ``conv_id`` of further conversations without turns.
    A node is a distinct sequence of the first ``depth`` turns of some conversation (its members). Returns
    ``conv_id`` (the smallest member; with ``depth`` it names the node), ``depth, parent_conv_id`` (null at the
    root), ``n_convs`` (members), ``n_children, n_nodes`` and ``n_leaves`` (of the subtree, its top included),
    ``saved_tokens`` (over the subtree, what its members after the first share: (n_convs - 1) times the bytes of a node's last
    text), ``ends_sha256`` (of the ids of members with ``depth`` turns, ascending, comma-joined). Without conversations: no rows.

    1. A prefix is named by its depth and two sums, modulo 2^62, of hashes of its turns with their places, which
       are running sums over ranges: neither a long conversation nor a common turn lies in one task.
    2. Siblings are ordered by ranges; from the first and last child and the next sibling follow the successors of
       each node's enter and exit arc.
    3. The arcs are dealt by ranges of the first turns' codes, so that a subtree mostly lies together; each
       range contracts what it has of the tour to segments. The segments are ranked: up to ``segments`` of them in one step, more of
       them by doubling in Spark. Subtree sums are differences of the sums before a node's two arcs.
    """
    bits, spot = (1 << _BITS) - 1, F.col("pos")
    name = lambda h: h.bitwiseAND(F.lit(MASK))
    rows = rows.select("conv_id", spot.cast("bigint").alias("pos"), "n_bytes", name(F.xxhash64(spot, "t1", "t2")).alias("e1"), name(F.xxhash64("t2", spot, "t1")).alias("e2"))
    code = F.lit(0).cast("bigint")
    for level in range(1, _LEVELS + 1):
        code = F.when(spot == level, F.shiftleft(F.col("e1").bitwiseAND(F.lit(bits)), _BITS * (_LEVELS - level))).otherwise(code)
    run = running(rows.select("conv_id", "pos", "n_bytes", "e1", "e2", F.col("e1").alias("k1"), F.col("e2").alias("k2"), code.alias("loc")), "conv_id", [spot.asc()], ["k1", "k2", "loc"])
    run = run.withColumnRenamed("pos", "depth")
    ends = run.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("e")).select("e.depth", "e.k1", "e.k2", "conv_id")
    if turnless is not None:
        zero = F.lit(0).cast("bigint")
        ends = ends.unionByName(turnless.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.col("conv_id").cast("bigint")))
    ends = staged(ends)
    top = ends.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    pieces = in_order(ends, [F.col(c).asc() for c in ("depth", "k1", "k2", "conv_id")]).drop("part")
    pieces = staged(pieces.mapInArrow(_ids_in_pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string"))
    hashed = pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first")
    hashed = staged(hashed.mapInArrow(_hashed_pieces, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"))

    up = lambda k, e: (F.first(k) - F.first(e)).bitwiseAND(F.lit(MASK))  # noqa: E731  all rows of a node have the same
    nodes = run.groupBy("depth", "k1", "k2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("n_bytes").alias("n_bytes"), F.first("loc").alias("loc"), up("k1", "e1").alias("up1"), up("k2", "e2").alias("up2"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id() + 1))
    nodes = staged(followed(nodes, ["depth", "up1", "up2"], ["loc", "node"], "node"))
    edge = F.struct("loc", "node")
    family = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"))
    family = family.agg(F.count("*").alias("n_children"), F.min(edge)["node"].alias("first"), F.max(edge).alias("last"))
    root = nodes.sparkSession.createDataFrame([(0, 0, 0, top["n"], top["least"], 0, 0, None, None, 0, None)] if top["n"] else [], nodes.schema)
    full = staged(nodes.unionByName(root).join(family, ["depth", "k1", "k2"], "left"))

    enter, leave = (lambda c: F.shiftleft(c, 1)), (lambda c: F.shiftleft(c, 1) + 1)
    node, none = F.col("node"), F.lit(0).cast("bigint")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    arcs = full.select(F.col("loc"), F.col("conv_id"), enter(node).alias("arc"), F.coalesce(enter(F.col("first")), leave(node)).alias("succ"), F.col("first").isNull().cast("bigint").alias("leaf"), saved.alias("save"))
    arcs = arcs.unionByName(full.filter("after IS NOT NULL OR node = 0").select("loc", "conv_id", leave(node).alias("arc"), F.coalesce(enter(F.col("after")), F.lit(-1)).alias("succ"), none.alias("leaf"), none.alias("save")))
    arcs = arcs.unionByName(full.filter("last IS NOT NULL").select("last.loc", "conv_id", leave(F.col("last.node")).alias("arc"), leave(node).alias("succ"), none.alias("leaf"), none.alias("save")))
    dealt = in_order(arcs, [F.col("loc").asc(), F.col("conv_id").asc(), F.col("arc").asc()], ranges_for(arcs, 2 * full.count()))
    local = staged(dealt.select("arc", "succ", "leaf", "save").mapInArrow(_contracted, "arc bigint, seg bigint, b_arcs bigint, b_leaf bigint, b_save bigint, out bigint, t_arcs bigint, t_leaf bigint, t_save bigint"))
    ranked = _rank(local.filter("out IS NOT NULL").select("seg", F.col("out").alias("next"), F.col("t_arcs").alias("arcs"), F.col("t_leaf").alias("leaf"), F.col("t_save").alias("save")), segments)
    sign = F.when(F.col("arc").bitwiseAND(1) == 1, 1).otherwise(-1)
    between = lambda c: F.sum(sign * (F.col(f"b_{c}") + F.col(f"p_{c}")))
    sums = local.join(ranked, "seg").groupBy(F.shiftright("arc", 1).alias("node")).agg(((between("arcs") + 1) / 2).cast("bigint").alias("n_nodes"), between("leaf").alias("n_leaves"), between("save").alias("saved_tokens"))

    parents = full.filter("depth > 0 AND n_children IS NOT NULL").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("above"))
    deep = full.filter("depth > 1").join(parents, ["depth", "up1", "up2"])
    flat = full.filter("depth <= 1").withColumn("above", F.when(F.col("depth") == 1, F.lit(top["least"]).cast("bigint")))
    found = deep.select(*full.columns, "above").unionByName(flat.select(*full.columns, "above")).join(sums, "node").join(hashed, ["depth", "k1", "k2"], "left")
    return found.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_nodes",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """``trie`` of the conversations of ``turns`` as they are, with ``role`` and ``text`` of each node's last turn (null at the root).

    Cases are those of ``ordered_turns``. Of each node, the turn of its smallest member is joined back; the texts of
    other members are never moved.
    """
    ordered = staged(ordered_turns(turns))
    nodes = trie(ordered)
    owners = nodes.join(ordered.select("conv_id", F.col("pos").alias("depth"), "t1", "t2"), ["conv_id", "depth"], "left")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), role.alias("role"), text.alias("text"))
    said = said.withColumn("t1", F.xxhash64("role", "text")).join(owners.select("conv_id", "t1").distinct(), ["conv_id", "t1"], "left_semi").dropDuplicates(["conv_id", "t1"])
    return owners.join(said, ["conv_id", "t1"], "left").drop("t1", "t2")
