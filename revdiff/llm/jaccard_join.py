"""Similarity join of word n-gram sets: prefixes as long as their candidates are dear, and as many matches asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .minhash import COUNT_BUCKETS, _counted
from .storage import lean_batches, staged
from .textbatch import Words, distinct_pairs, mix64, shingles, signed, slices, text_buffer

#: Shared prefix tokens that a pair may be asked for, at most.
MATCHES = 6
#: Numbers of 64 bits in the parities of a set.
PARITIES = 8
#: Pairs that get one copy of their common partner's text, about.
GROUP = 32


_ODD = [f"odd_{w}" for w in range(PARITIES)]
_OWN = ["last_n", "last_h", *_ODD]


def choose_matches(size: np.ndarray, need: np.ndarray, prefix_cost: np.ndarray) -> np.ndarray:
    """The number of matches to ask for, for each set, and so the length of its prefix.

    A set of ``size`` tokens that must share ``need`` shares ``m`` of its first ``size - need + m`` tokens with any
    such partner. ``prefix_cost[i, m - 1]`` estimates how many postings of other sets these
    tokens meet. Each posting costs one row; a partner met at least m times is verified, which moves
    about a quarter of a row per token, and there are at most postings / m such partners.
    """
    m = np.arange(1, prefix_cost.shape[1] + 1)
    cost = (size - need)[:, None] + m + prefix_cost + prefix_cost / m * (1 + size[:, None] / 4)
    cost[m > np.maximum(need, 1)[:, None]] = np.inf
    return cost.argmin(axis=1) + 1


def parities(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each set ``h[first[i]:first[i + 1]]``, the last one to the end and none empty: whether an even or odd number of its tokens fall on each of some bits.

    A token that only one of two sets has turns one bit, so the bits in which two sets differ are at most
    as many as the tokens in which they differ.
    """
    bit = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(64 * PARITIES)
    one = np.uint64(1) << (bit % np.uint64(64))
    words = [np.bitwise_xor.reduceat(np.where(bit // np.uint64(64) == w, one, np.uint64(0)), first) if len(first) else np.zeros(0, np.uint64) for w in range(PARITIES)]
    return np.stack(words, axis=1)


def _prepared(k: int, num: int, den: int, often):
    """Of each text: size and fingerprint of its set, its prefix in order of rarity, how often its last token occurs, and that token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = often.value
        usual = count.sum() / COUNT_BUCKETS  # what other tokens add to a counter
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                n = hi - lo
                row, h = distinct_pairs(*shingles(Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), k))
                size = np.bincount(row, minlength=n)
                prints = []
                for c in (1, 2):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, row, mix64(h ^ mix64(np.full(1, c, np.uint64))))
                    prints.append(pa.array(signed(total)))
                seen = count[(h % np.uint64(COUNT_BUCKETS)).astype(np.int64)]
                order = np.lexsort((h, seen, row))
                h, seen = h[order], seen[order]
                first = np.cumsum(size) - size
                need = -(-num * size // den)
                total = np.concatenate([[0.0], np.cumsum(np.maximum(seen - 1 - usual, 0))])
                ends = np.minimum(size[:, None], (size - need)[:, None] + np.arange(1, MATCHES + 1))
                m = choose_matches(size, need, total[first[:, None] + ends] - total[first][:, None])
                length = np.minimum(size, size - need + m)
                keep = np.arange(len(row)) - first[row] < length[row]
                some = size > 0
                last = (first + length - 1)[some]
                ends_at = []
                for x in (seen, signed(h ^ np.uint64(1 << 63))):  # in signed numbers the order of the unsigned ones
                    own = np.zeros(n, np.int64)
                    own[some] = x[last]
                    ends_at.append(pa.array(own))
                odd = np.zeros((n, PARITIES), np.uint64)
                odd[some] = parities(first[some], h)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(signed(h[keep])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(size.astype(np.int64)), *prints, *ends_at, *(pa.array(signed(np.ascontiguousarray(x))) for x in odd.T), lists],
                    names=["doc_id", "digest", "n_shingles", "f1", "f2", *_OWN, "prefix"],
                )

    return run


def _set_of(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return distinct_pairs(*shingles(Words(raw, np.array([0, len(raw)])), k))[1]


def _verified(k: int, num: int, den: int):
    """Of groups ``a, part`` of texts, the one of ``a`` first: the others similar enough to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, member, node, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not member:
                    group, own = (a, part), _set_of(text, k)
                elif group == (a, part):
                    other = _set_of(text, k)
                    both = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if both and den * both >= num * (len(own) + len(other) - both):
                        found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return run


def _overlap(n_x: Column, n_y: Column, num: int, den: int) -> Column:
    """How many tokens two sets of these sizes must share."""
    return F.ceil(num * (n_x + n_y) / (num + den))


def _apart() -> Column:
    """In how many tokens the sets x and y differ at least."""
    return sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in _ODD[1:]), F.bit_count(F.col(f"x.{_ODD[0]}").bitwiseXOR(F.col(f"y.{_ODD[0]}"))))


def _first_to_end(c: str) -> Column:
    """``c`` of that set of the two, x and y, whose prefix ends with the rarer token.

    What they share outside both prefixes lies behind this prefix: a token of it that the other
    has, the other has in its longer-reaching prefix.
    """
    x_ends = (F.col("x.last_n") < F.col("y.last_n")) | ((F.col("x.last_n") == F.col("y.last_n")) & (F.col("x.last_h") <= F.col("y.last_h")))
    return F.when(x_ends, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))


def similar_sets(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents whose sets of word n-grams have a Jaccard similarity of at least ``num / den``, found exactly.

    ``docs`` needs ``doc_id`` (bigint) and ``text``; other columns are ignored. Text is lower-cased (A-Z) and split
    into words at space and ``\\t\\n\\v\\f\\r``; the set holds the distinct runs of ``shingle`` words, or the whole sequence
    if it is shorter. Returns one row per row of ``docs``: ``doc_id, n_shingles, component_id`` (the smallest id
    reachable by links, its own included).

    1. Tokens are ordered by how often they occur. A set asks for m shared prefix tokens, m chosen for each set by
       ``choose_matches``; the more it asks for, the longer its prefix is. Equal sets are one class from here on.
    2. In the list of each prefix token all classes are paired with the one that has the fewest prefix tokens of its own,
       which is the least edited one of a group of copies. Pairs met often enough are verified on full sets. So a group of n copies costs
       n pairs, and the classes of a list mostly lie in few components after it.
    3. Then all pairs of classes of different components are made that share a token. Two sets share no more than
       what they met in their prefixes and what stands behind that prefix that ends first; so the m that its set asked for and what
       the sizes of the two ask for beyond it must have been met. Parities of the whole sets say in how many
       tokens two sets differ at least, which leaves few pairs that aren't similar. The pairs left are verified. Lists that lie in one
       component are left out, since they can't join anything new. No link that joins two components is left out.

    A text is verified in groups of about ``GROUP`` pairs that share one partner, whose text comes once a
    group. Null or empty text: no set, linked with nothing. A null ``doc_id``: the row stays, with a
    null ``component_id``. Rows that share an id are judged each by its own text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    counts = docs.select("text").mapInArrow(_counted(shingle), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNT_BUCKETS, np.int64)
    often[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    often = spark.sparkContext.broadcast(often)
    made = staged(docs.mapInArrow(_prepared(shingle, num, den, often), "doc_id bigint, digest bigint, n_shingles bigint, f1 bigint, f2 bigint, " + ", ".join(f"{c} bigint" for c in _OWN) + ", prefix array<bigint>"))
    group = ["n_shingles", "f1", "f2"]
    classes = made.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*group).agg(F.min(F.struct("doc_id", "digest")).alias("of"), *(F.first(c).alias(c) for c in [*_OWN, "prefix"]))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("node"), *group, F.col("of.doc_id").alias("rep"), F.col("of.digest").alias("digest"), *_OWN, "prefix"))
    sizes = classes.select("node", F.col("n_shingles").alias("n"), F.size("prefix").alias("p"), *_OWN)

    postings = classes.select("node", F.explode("prefix").alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("many")).filter("many > 1").select("token")
    members = staged(postings.join(lists, "token"))
    # the set with the fewest tokens of its own, and of these the largest, is the centre of what it shares
    rank = sizes.join(members.groupBy("node").agg(F.count("*").alias("shared")), "node").select("node", F.struct((F.col("p") - F.col("shared")).alias("alone"), (-F.col("n")).alias("less"), "node").alias("rank"))
    leaders = staged(members.join(rank, "node").groupBy("token").agg(F.min("rank")["node"].alias("leader")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The rows ``a, b`` of ``pairs`` (distinct) that are links."""
        pairs = staged(pairs)
        degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        pairs = staged(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part")))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "digest")
        texts = staged(docs.filter("text IS NOT NULL").dropDuplicates(["doc_id", "digest"]).join(wanted, ["doc_id", "digest"]).select("node", "text"))
        firsts = pairs.select("a", "part").distinct().join(texts, F.col("a") == F.col("node")).select("a", "part", F.lit(0).alias("member"), "node", "text")
        others = pairs.join(texts, F.col("b") == F.col("node")).select("a", "part", F.lit(1).alias("member"), "node", "text")
        dealt = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "member", "node")
        return staged(dealt.mapInArrow(_verified(shingle, num, den), "a bigint, b bigint"))

    must = _overlap(F.col("x.n"), F.col("y.n"), num, den)
    alike = (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")) & (_apart() <= F.col("x.n") + F.col("y.n") - 2 * must)
    met = members.join(leaders, "token").filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("met"))
    met = met.join(sizes.alias("x"), F.col("a") == F.col("x.node")).join(sizes.alias("y"), F.col("b") == F.col("y.node"))
    found = staged(connected_components(verified(met.filter(alike & (F.col("met") + _first_to_end("n") - _first_to_end("p") >= must)).select("a", "b")).toDF("u", "v")))

    placed = staged(members.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    mixed = staged(placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token"))
    placed = staged(placed.join(mixed, "token", "left_semi"))
    # what a set can share at most: its tokens that another component has, too, and what stands behind its prefix
    useful = placed.groupBy("node").agg(F.count("*").alias("useful")).join(sizes, "node").withColumn("most", F.col("useful") + F.col("n") - F.col("p")).drop("useful")
    placed = staged(placed.join(useful, "node"))
    x, y = placed.alias("x"), placed.alias("y")
    close = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & alike & (_first_to_end("most") >= must)
    asked = (must - _first_to_end("n") + _first_to_end("p")).alias("asked")
    rest = x.join(y, close).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), asked).agg(F.count("*").alias("met"))
    links = verified(rest.filter("met >= asked").select("a", "b"))
    comps = classes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    comps = staged(comps)
    joined = links.join(comps.toDF("a", "u"), "a").join(comps.toDF("b", "v"), "b").select("u", "v")
    final = staged(connected_components(joined)).toDF("comp", "joined")
    label = classes.select("node", *group, "rep").join(comps, "node").join(final, "comp", "left").select(*group, "rep", F.coalesce("joined", "comp").alias("label"))
    label = staged(label)
    least = label.groupBy("label").agg(F.min("rep").alias("component"))
    named = staged(label.join(least, "label").select(*group, "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return made.select("doc_id", *group).join(named, group, "left").select("doc_id", "n_shingles", component.alias("component_id"))
