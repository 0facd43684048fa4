"""Jaccard join of word shingles with a token-group matrix, exact at its threshold.

Equal sets become one node. A global order puts tokens that many sets share (hot ones) last; two sets above
the threshold share `share` tokens among the first n - ceil(t * n) + share of each. Sets are partitioned into groups around
pivots that they are verified to be linked with; the matrix keeps, for each token, the groups (by size) whose union has
it. A pair of groups is opened only if their unions share enough tokens and their sizes leave room for the threshold:
for hot tokens every pair of members is a candidate then, for others those that share such tokens. Every link is verified
on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import bitmap_of, slices
from assayline.llm.components import components
from assayline.llm.words import Words, mix, runs
from assayline.runtime import discard, materialise

SLICE = 1 << 19
#: Hot tokens that are broadcast, eight bytes each; beyond it the most frequent are hot. The order of tokens never affects the result.
MOST_HOT = 2_000_000


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of k words; of fewer words, the whole sequence; none without words."""
    w = Words(column, lower=True)
    h, every = w.hashes[0], runs(w.hashes[0], k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            t = np.sort(every[a : b - k + 1])
            out.append(t[np.append(True, t[1:] != t[:-1])])
        elif b > a:
            out.append(mix(runs(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever its order."""
    size = np.array([s.size for s in sets], dtype=np.int64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    at = np.cumsum(size) - size
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.append(np.uint64(0), np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64))
        out.append(mix(total[at + size] - total[at] + size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _int(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64())


def hot_tokens(rows: DataFrame, k: int, least: int, share: int = 16, task_tokens: int = 1_000_000) -> np.ndarray:
    """Tokens of at least `least` sets (sorted; at most MOST_HOT), by two counts: of those that a task sees twice among
    task_tokens, and of all tokens in one of `share` sets, chosen by the set's signature, of which a task sends every one. A
    token that stands far apart in very many sets is hot by the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import ngram_join as here

        seen, held, chosen, size = set(), [], [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            s, m = np.unique(np.concatenate([*chosen, np.zeros(0, np.uint64)]), return_counts=True)
            t, n, each = t[n > 1], n[n > 1], np.zeros(s.size, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [_int(np.concatenate([t, s])), pa.array(np.concatenate([n, each]), pa.int64()), pa.array(np.concatenate([np.zeros(t.size, np.int64), m]), pa.int64())], ["token", "n", "m"]
            )

        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                sets = here.shingle_sets(part.column("__text"), k)
                for s, sig in zip(sets, here.signatures(sets)[0].tolist()):
                    if sig not in seen:
                        seen.add(sig)
                        held.append(s)
                        if sig % share == 0:
                            chosen.append(s)
                        size += s.size
                if len(seen) > 200_000:
                    seen.clear()
                if size > task_tokens:
                    yield flush()
                    held, chosen, size = [], [], 0
        if held:
            yield flush()

    found = rows.select("__text").mapInArrow(run, "token bigint, n bigint, m bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    found = found.select("token", F.greatest("n", F.when(F.col("m") >= 8, F.col("m") * share).otherwise(0)).alias("n")).filter(F.col("n") >= least)
    found = found.orderBy(F.desc("n"), "token").limit(MOST_HOT)
    got = np.fromiter((r["token"] for r in found.select("token").toLocalIterator()), dtype=np.int64)
    return np.sort(got.view(np.uint64))


class Order:
    """Tells hot tokens: a table of their low bits answers for most others."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(hot & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def is_hot(self, t: np.ndarray) -> np.ndarray:
        out = self.bits[(t & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if at.size:
            p = np.minimum(np.searchsorted(self.hot, t[at]), self.hot.size - 1)
            out[at] = self.hot[p] == t[at]
        return out


def set_table(rows: DataFrame, k: int, percent: int, share: int, hot: np.ndarray) -> DataFrame:
    """(__id, n, rare, s1, s2, prefix): each document's set size, its tokens that aren't hot, signature and prefix."""
    sent = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import ngram_join as here

        order = here.Order(sent.value)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                sets = here.shingle_sets(part.column("__text"), k)
                s1, s2 = here.signatures(sets)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                is_hot, at, rare, prefix = order.is_hot(flat), 0, [], []
                for s in sets:
                    warm = is_hot[at : at + s.size]
                    at += s.size
                    rare.append(s.size - int(warm.sum()))
                    need = -(-percent * s.size // 100)
                    length = s.size - need + min(share, need)
                    prefix.append((s[~warm][:length] if rare[-1] >= length else np.concatenate([s[~warm], s[warm][: length - rare[-1]]])).view(np.int64))
                size = [p.size for p in prefix]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)]), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), pa.array([s.size for s in sets], pa.int32()), pa.array(rare, pa.int32()), _int(s1), _int(s2), lists], ["__id", "n", "rare", "s1", "s2", "prefix"]
                )

    return rows.mapInArrow(run, "__id bigint, n int, rare int, s1 bigint, s2 bigint, prefix array<bigint>")


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """(h): prefix tokens of at least two nodes; tasks send each token once, with its smallest and largest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            t = lists.flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((node, t))
            t, node = t[order], node[order]
            new = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if t.size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([_int(t[new]), _int(node[new]), _int(node[np.append(new[1:], t.size) - 1] if t.size else node)], ["h", "lo", "hi"])

    found = nodes.select("node", "prefix").mapInArrow(run, "h bigint, lo bigint, hi bigint")
    return found.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("h")


def postings(nodes: DataFrame, shared: DataFrame, hot: np.ndarray, max_bits: int = 1 << 28) -> DataFrame:
    """(token, hot, node, n, rare, room) for prefix tokens that may be shared; room: hot tokens in the node's prefix."""
    sc = nodes.sparkSession.sparkContext
    bits, sent = sc.broadcast(bitmap_of(shared, "h", shared.count(), 16, max_bits)), sc.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import ngram_join as here

        order = here.Order(sent.value)
        for batch in batches:
            lists = batch.column("prefix")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            t = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), size)
            rare = batch.column("rare").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(bits.value.has(t))
            take = pa.array(row[keep])
            room = np.maximum(0, size - rare).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_int(t[keep]), pa.array(order.is_hot(t[keep].view(np.uint64))), *[batch.column(c).take(take) for c in ("node", "n", "rare")], pa.array(room[row[keep]])],
                ["token", "hot", "node", "n", "rare", "room"],
            )

    return nodes.select("node", "n", "rare", "prefix").mapInArrow(run, "token bigint, hot boolean, node bigint, n int, rare int, room int")


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of node ids whose whole sets reach the threshold. Only texts of nodes in pairs are shingled."""
    pairs = materialise(pairs.select("a", "b").distinct(), "tgm-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = materialise(ends, "tgm-ends")
    hashed = ends.select(F.xxhash64("node").alias("h"))
    bits = rows.sparkSession.sparkContext.broadcast(bitmap_of(hashed, "h", ends.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import ngram_join as here

        for batch in batches:
            batch = batch.filter(pa.array(bits.value.has(batch.column("__h").to_numpy(zero_copy_only=False))))
            for part in slices(batch, "__text", SLICE):
                sets = here.shingle_sets(part.column("__text"), k)
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    sets = rows.select("__id", F.xxhash64("__id").alias("__h"), "__text").mapInArrow(run, "node bigint, tokens binary")
    sets = materialise(sets.join(ends, "node", "left_semi"), "tgm-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = x.size + y.size - np.union1d(x, y).size
                ok.append(100 * both >= percent * (x.size + y.size - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    found = materialise(both.mapInArrow(test, "a bigint, b bigint").distinct(), "tgm-links")
    discard(pairs, ends, sets)
    return found


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b))


def _need(n: Column, percent: int, share: int) -> Column:
    """Tokens that prefixes of two linked sets share at least, the smaller of n tokens."""
    return F.least(F.lit(share), F.ceil(F.lit(percent) * n / 100))


def _pairs_of(opened: DataFrame, inside: DataFrame, keep: Column | None = None) -> DataFrame:
    """(a, b): the members of opened pairs of groups (la, na, lb, nb); keep: a condition on their rows a and b of inside."""
    side = lambda s: inside.select(*[F.col(c).alias(f"{s}_{c}") for c in inside.columns])
    both = opened.join(side("a"), (F.col("la") == F.col("a_label")) & (F.col("na") == F.col("a_n"))).join(side("b"), (F.col("lb") == F.col("b_label")) & (F.col("nb") == F.col("b_n")))
    return (both if keep is None else both.filter(keep)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _stars(post: DataFrame, percent: int, share: int) -> DataFrame:
    """(a, b): sets and the pivots that they may gather around. Sets that are mostly hot tokens try the set with the fewest
    other tokens at each of their first two hot tokens. All sets try one more: at each token that is not hot the set with
    the fewest such tokens is the pivot, and the pivot with the most tokens in common counts. A row a posting, no pairs."""
    fewest = F.struct("rare", "node")

    def pivots(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token").agg(F.min_by("node", fewest).alias("pivot"), F.min_by("n", fewest).alias("pivot_n"))

    fits = (F.col("node") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("pivot_n"), percent)
    dense = _dense(post, percent)
    spots = dense.groupBy("node").agg(F.min("n").alias("n"), F.slice(F.sort_array(F.collect_set("token")), 1, 2).alias("tokens")).select("node", "n", F.explode("tokens").alias("token"))
    hot = spots.join(pivots(dense), "token").filter(fits).select("node", "pivot")
    cold = post.filter(~F.col("hot"))
    met = cold.join(pivots(cold), "token").filter(fits).groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("shared"), F.max("room").alias("room"), F.max(F.least("n", "pivot_n")).alias("n"))
    met = met.filter(F.col("shared") + F.col("room") >= _need(F.col("n"), percent, share)).groupBy("node").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("pivot"))
    return hot.unionByName(met).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _dense(post: DataFrame, percent: int) -> DataFrame:
    return post.filter("hot").filter(F.lit(100) * (F.col("n") - F.col("rare")) >= F.lit(percent) * F.col("n"))


def _opened_hot(dense: DataFrame, percent: int, share: int) -> DataFrame:
    """(a, b) of members of groups that share hot tokens enough: sets that share none but hot tokens overlap in at most the
    smaller number of theirs."""
    matrix = dense.groupBy("token", "label", "n").agg(F.max("hot_n").alias("hot_n"))
    a, b = matrix.alias("a"), matrix.alias("b")
    possible = lambda x, y, n, m: F.lit(100) * F.least(x, y) >= F.lit(percent) * (n + m - F.least(x, y))
    fits = _sizes_fit(F.col("a.n"), F.col("b.n"), percent) & possible(F.col("a.hot_n"), F.col("b.hot_n"), F.col("a.n"), F.col("b.n"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.label") < F.col("b.label")) & fits)
    met = met.groupBy(F.col("a.label").alias("la"), F.col("a.n").alias("na"), F.col("b.label").alias("lb"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("shared"))
    opened = met.filter(F.col("shared") >= _need(F.least("na", "nb"), percent, share)).drop("shared")
    return _pairs_of(opened, dense.select("node", "n", "hot_n", "label").distinct(), possible(F.col("a_hot_n"), F.col("b_hot_n"), F.col("na"), F.col("nb")))


def _opened_cold(cold: DataFrame, percent: int, share: int) -> DataFrame:
    """(a, b) of members of groups that share other tokens enough. Two groups of one set each are the pair; of larger groups
    only members that share such tokens themselves are."""
    groups = cold.groupBy("token", "label", "n").agg(F.max("room").alias("room"))
    a, b = groups.alias("a"), groups.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.label") < F.col("b.label")) & _sizes_fit(F.col("a.n"), F.col("b.n"), percent))
    met = met.select("a.token", F.col("a.label").alias("la"), F.col("a.n").alias("na"), F.col("b.label").alias("lb"), F.col("b.n").alias("nb"), F.least("a.room", "b.room").alias("room"))
    pairs = met.groupBy("la", "na", "lb", "nb").agg(F.count(F.lit(1)).alias("shared"), F.max("room").alias("room"))
    enough = F.col("shared") + F.col("room") >= _need(F.least("na", "nb"), percent, share)
    opened = pairs.filter(enough).drop("shared", "room")
    size = cold.groupBy("label", "n").agg(F.count_distinct("node").alias("c"), F.min("node").alias("node"))
    side = lambda s: size.select(F.col("label").alias(f"l{s}"), F.col("n").alias(f"n{s}"), F.col("c").alias(f"c{s}"), F.col("node").alias(s))
    opened = materialise(opened.join(side("a"), ["la", "na"]).join(side("b"), ["lb", "nb"]), "tgm-opened")
    alone = (F.col("ca") == 1) & (F.col("cb") == 1)
    # Members meet at the tokens that their groups share: a group's other tokens must not be dealt to each group it is opened with.
    at = met.drop("room").join(opened.filter(~alone).select("la", "na", "lb", "nb"), ["la", "na", "lb", "nb"], "left_semi")
    x = cold.select("token", F.col("label").alias("la"), F.col("n").alias("na"), F.col("node").alias("x"), F.col("room").alias("rx"))
    y = cold.select("token", F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("node").alias("y"), F.col("room").alias("ry"))
    members = at.join(x, ["token", "la", "na"]).join(y, ["token", "lb", "nb"]).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max(F.least("rx", "ry")).alias("room"), F.max(F.least("na", "nb")).alias("n")
    )
    members = members.filter(F.col("shared") + F.col("room") >= _need(F.col("n"), percent, share))
    return opened.filter(alone).select("a", "b").unionByName(members.select("a", "b"))


def links(docs: DataFrame, k: int = 4, percent: int = 85, share: int = 4, hot_sets: int = 32, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, edges): (__id, n, node) of every row, and the verified links (a, b) that join nodes.

    node is the smallest id with an equal set. Edges connect exactly the nodes that links connect; inside a
    group around a pivot not every pair is listed. Sets of no tokens have no node's links.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    hot = hot_tokens(rows, k, hot_sets)
    table = materialise(set_table(rows, k, percent, share, hot), "tgm-documents")
    nodes = table.filter("n > 0").groupBy("s1", "s2").agg(F.min("__id").alias("node"))
    nodes = materialise(nodes, "tgm-nodes")
    # Hot keys here are exact copies: narrow rows, and a plain equi-join that adaptive execution splits.
    members = materialise(table.select("__id", "n", "s1", "s2").join(nodes, ["s1", "s2"], "left").select("__id", "n", F.coalesce("node", "__id").alias("node")), "tgm-members")
    held = table.filter("n > 0").join(nodes.select(F.col("node").alias("__id"), F.col("s1"), F.col("s2")), ["__id", "s1", "s2"], "left_semi").select(F.col("__id").alias("node"), "n", "rare", "prefix")
    held = materialise(held, "tgm-prefixes")
    discard(table, nodes)
    shared = materialise(shared_tokens(held), "tgm-shared")
    post = materialise(postings(held, shared, hot), "tgm-postings")
    discard(held, shared)
    star = verified(_stars(post, percent, share), rows, k, percent)
    label = components(star, "tgm-groups")
    # The matrix: for each token, the groups (a label's sets of one size) whose union holds it; a set without a pivot is a group.
    grouped = post.join(label, "node", "left").withColumns({"label": F.coalesce("component", "node"), "hot_n": F.col("n") - F.col("rare")}).drop("component")
    grouped = materialise(grouped, "tgm-matrix")
    discard(post)
    pairs = _opened_hot(_dense(grouped, percent), percent, share).unionByName(_opened_cold(grouped.filter(~F.col("hot")), percent, share))
    more = verified(pairs, rows, k, percent)
    discard(grouped)
    return members, star.unionByName(more)


def join_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: its set's size, the smallest id that links reach.

    Rows without words are linked with nothing; equal texts are. Rows with a null id have no component (null). Rows that share an id are
    one document with several texts: what one of them links to counts for all.
    """
    members, edges = links(docs, k, percent, id_col=id_col, text_col=text_col)
    # Rows of one id with different sets are linked through the id.
    same = members.filter("n > 0 and node != __id").select(F.col("__id").alias("a"), F.col("node").alias("b"))
    many = members.groupBy("__id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("__id")
    found = components(edges.unionByName(same.join(many, same.a == many["__id"], "left_semi")), "tgm-components")
    out = members.join(found, "node", "left").select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    lost = docs.filter(F.col(id_col).isNull())
    if lost.isEmpty():
        return out
    none = lost.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.lit(0).cast("long").alias("__id"))
    none = set_table(none, k, percent, 1, np.zeros(0, np.uint64))
    return out.unionByName(none.select(F.lit(None).cast("long").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id. Rows with a null id or no words stay."""
    found = join_components(docs, k, percent, id_col, text_col)
    drop = found.filter((F.col("component_id") != F.col(id_col)) & (F.col("n_shingles") > 0)).select(F.col(id_col).alias("__drop")).distinct()
    drop = materialise(drop, "tgm-dropped")
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
