"""Nearest neighbours by the largest inner product: NN-descent builds a graph, a greedy search reads it.

Equal vectors are one node with its smallest ids. A node's vector gets one more component that gives all
nodes the length of the longest, so that the largest inner product and the smallest distance agree, and
is sent about in one byte a component; only the last step compares the original vectors.

1. Start: ``TREES`` times all nodes are sorted by the sides of random planes they lie on and cut into
   blocks of ``BLOCK``; inside a block everyone gets its nearest ``PER_BLOCK``.
2. Rounds: a node introduces its neighbours, new to new and new to old, as neighbours of a neighbour are
   likely neighbours. These are joins of the graph with itself by way of the node: the neighbours and
   those it is a neighbour of come to it with their vectors, and go out as better candidates. It takes
   part with ``SAMPLE`` new and old neighbours, and twice as many that have it as a neighbour, chosen by
   hash; a node that very many have as a neighbour thus gets no more rows than others. Rounds
   end when at most ``STOP`` of the graph is new.
3. Search: a query starts at its own node, if it has one, and at the nearest of ``PIVOTS`` nodes. In each
   round it visits the ``BEAM`` best nodes it has not visited among its ``WIDTH`` best, by a join with the
   graph, and takes over better ones, until all of its best are visited.
4. The exact inner products of its ``WIDTH`` best in double precision give the answer.

The rows of a node and of a query have a bound, and nodes that occur very often are joined by
``join_groups``. Nothing but the pivots and counts comes to the driver.

Rows with a null id or a null or zero vector, or null or not finite components, take no part; a shorter
vector is filled up with zeros. Of equal scores the smaller id comes first. Ids may repeat: each row is a
candidate of its own. Other columns are not read; an empty table gives an empty result. With up to
``BLOCK`` nodes everyone is everyone's neighbour.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicvote.llm.common import column, join_groups, sorted_groups
from topicvote.session import materialise, ship_package

NEIGHBOURS = 48
SAMPLE = 10
TREES = 24
BLOCK = 1024
PER_BLOCK = 12
ROUNDS = 8
STOP = 0.1
PIVOTS = 256
STARTS = 4
WIDTH = 48
BEAM = 16
SEARCH_ROUNDS = 12
SEED = 42
GRAPH = "node bigint, nbrs array<bigint>, scores array<float>, fresh array<boolean>"
FOUND = "node bigint, nbrs array<bigint>, scores array<float>"


def valid(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = column(rows, vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    real = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return rows.filter(column(rows, id_column).isNotNull() & real).select(
        column(rows, id_column).alias("id"), v.alias("v")
    )


def nodes(rows: DataFrame, members: int) -> DataFrame:
    """node, v, ids of ``rows`` (id, v): the distinct vectors, each with its ``members`` smallest ids; written."""
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= members)
    distinct = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return materialise(distinct.select(F.monotonically_increasing_id().alias("node"), "v", "ids"), "nodes")


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros."""
    out = np.zeros((len(vectors), size))
    lengths = vectors.value_lengths().to_numpy()
    out[np.arange(size) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def coded(distinct: DataFrame) -> tuple[DataFrame, int, int]:
    """(node, code, scale), the length of a code and the number of nodes. Codes are the components, and the
    one that evens the length out, in steps of ``scale``; written."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, size, longest = distinct.agg(F.count("*"), F.max(F.size("v")), F.max(length)).first()
    size, longest = size or 0, longest or 0.0

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))
            x = np.column_stack([x, rest])
            scale = np.abs(x).max(axis=1, initial=0) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            columns = [batch.column("node"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "code", "scale"])

    codes = distinct.select("node", "v").mapInArrow(run, "node bigint, code binary, scale float")
    return materialise(codes, "codes"), size + 1, count


def _vectors(rows) -> np.ndarray:
    codes = rows.column("code").to_pylist()
    raw = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)
    return raw * rows.column("scale").to_numpy()[:, None].astype(np.float32)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray, most: int):
    """The ``most`` best of each owner, each id once (an old one if there is); sorted."""
    order = np.lexsort((fresh, ids, owner))
    owner, ids, scores, fresh = owner[order], ids[order], scores[order], fresh[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, scores, fresh = owner[first], ids[first], scores[first], fresh[first]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, fresh = owner[order], ids[order], scores[order], fresh[order]
    heads = np.flatnonzero(np.diff(owner, prepend=-1) != 0)
    place = np.arange(len(owner)) - np.repeat(heads, np.diff(heads, append=len(owner)))
    kept = place < most
    return owner[kept], ids[kept], scores[kept], fresh[kept]


def _found(node: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> pa.RecordBatch:
    """FOUND rows of the best pairs."""
    names, owner = np.unique(node, return_inverse=True)
    owner, ids, scores, _ = best(owner, other, score, np.zeros(len(owner), bool), most)
    sizes = np.bincount(owner, minlength=len(names))
    columns = [pa.array(names), _lists(sizes, pa.array(ids)), _lists(sizes, pa.array(scores.astype(np.float32)))]
    return pa.RecordBatch.from_arrays(columns, ["node", "nbrs", "scores"])


def first_neighbours(codes: DataFrame, size: int, count: int, most: int = NEIGHBOURS) -> DataFrame:
    """FOUND rows: the nearest inside blocks of nodes on the same sides of random planes."""
    block = BLOCK
    planes = max(1, (-(-count // block)).bit_length())
    per_block = most if count <= block else min(PER_BLOCK, most)
    trees = 1 if count <= block else TREES
    rng = np.random.default_rng(SEED)
    normals = rng.standard_normal((size, trees * (planes + 1))).astype(np.float32)

    def place(batches):
        for batch in batches:
            n = batch.num_rows
            side = (_vectors(batch) @ normals).reshape(n, trees, planes + 1)
            bits = (side[..., :planes] > 0).astype(np.int64)
            for k in range(1, planes):  # Gray code: cells in a row differ in one plane
                bits[..., k] ^= bits[..., k - 1]
            cell = bits @ (1 << np.arange(planes)[::-1])
            for tree in range(trees):
                columns = [pa.array(np.full(n, tree, np.int32)), pa.array(cell[:, tree]), pa.array(side[:, tree, planes])]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns], ["tree", "cell", "along", *batch.schema.names])

    def compare(batches):
        for table, tree, part in sorted_groups(batches, "tree", block):
            first = (np.diff(tree, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)
            edges = np.append(np.flatnonzero(first), len(tree))
            names = table.column("node").to_numpy()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = _vectors(table.slice(a, b - a))
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                wide = min(per_block, b - a - 1)
                if wide:
                    top = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
                    owner = np.repeat(names[a:b], wide)
                    yield _found(owner, names[a:b][top].ravel(), np.take_along_axis(near, top, 1).ravel(), wide)

    kind = "tree int, cell bigint, along float, node bigint, code binary, scale float"
    placed = codes.select("node", "code", "scale").mapInArrow(place, kind)
    in_order = placed.repartitionByRange("tree", "cell", "along").sortWithinPartitions("tree", "cell", "along")
    return in_order.mapInArrow(compare, FOUND)


def _chosen(node: np.ndarray, nbrs: np.ndarray, owner: np.ndarray, fresh: np.ndarray, number: int, sample: int) -> np.ndarray:
    """The ``sample`` neighbours of each kind a node takes part with in a round, by hash."""
    with np.errstate(over="ignore"):
        mixed = (nbrs * 0x9E3779B1 + node * 0x85EBCA77 + number) * 0x27D4EB2F165667C5
    order = np.lexsort((mixed, fresh, owner))
    change = (np.diff(owner[order], prepend=-1) != 0) | (np.diff(fresh[order].astype(int), prepend=2) != 0)
    heads = np.flatnonzero(change)
    place = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
    out = np.zeros(len(nbrs), bool)
    out[order] = place < sample
    return out


def _entries(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner (row), node, neighbour, score, fresh of graph rows."""
    sizes = rows.column("nbrs").value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = [rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nbrs", "scores", "fresh")]
    return owner, rows.column("node").to_numpy()[owner], *flat


def _merged(most: int, number: int, sample: int):
    """Graph rows and FOUND rows (null fresh) sorted by node: the graph of the next round."""

    def run(batches):
        for table, codes, _ in sorted_groups(batches, "node"):
            rows = table.combine_chunks().to_batches()[0]
            heads = np.flatnonzero(np.diff(codes, prepend=-1))
            known = rows.column("fresh").is_valid().to_numpy(zero_copy_only=False)
            old, new = rows.filter(pa.array(known)), rows.filter(pa.array(~known))
            owner, node, ids, scores, fresh = _entries(old)
            fresh = fresh.astype(bool) & ~_chosen(node, ids, owner, fresh.astype(bool), number, sample)
            sizes = new.column("nbrs").value_lengths().to_numpy()
            names = rows.column("node").to_numpy()[heads]
            group = np.concatenate([codes[known][owner], np.repeat(codes[~known], sizes)])
            group, ids, scores, fresh = best(
                group,
                np.concatenate([ids, new.column("nbrs").flatten().to_numpy()]),
                np.concatenate([scores, new.column("scores").flatten().to_numpy()]),
                np.concatenate([fresh, np.ones(int(sizes.sum()), bool)]),
                most,
            )
            sizes = np.bincount(group, minlength=len(names))
            lists = [_lists(sizes, pa.array(x)) for x in (ids, scores.astype(np.float32), fresh)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *lists], ["node", "nbrs", "scores", "fresh"])

    return run


def _take_over(graph: DataFrame | None, found: DataFrame, most: int, number: int, sample: int) -> DataFrame:
    rows = found.withColumn("fresh", F.lit(None).cast("array<boolean>"))
    rows = rows if graph is None else graph.unionByName(rows)
    dealt = rows.repartition("node").sortWithinPartitions("node")
    return materialise(dealt.mapInArrow(_merged(most, number, sample), GRAPH), "graph")


def _introduced(most: int):
    """Rows (pivot, member, is_new, code, scale, least) sorted by pivot: what members find in each other."""

    def run(batches):
        held, size = [], 0
        for table, codes, _ in sorted_groups(batches, "pivot"):
            heads = np.concatenate([np.flatnonzero(np.diff(codes, prepend=-1)), [len(codes)]])
            names, is_new = table.column("member").to_numpy(), table.column("is_new").to_numpy()
            least, x = table.column("least").to_numpy(), _vectors(table)
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                new = a + np.flatnonzero(is_new[a:b])
                if not len(new):
                    continue
                near = x[new] @ x[a:b].T
                i, j = np.nonzero((near > least[a:b]) | (near > least[new][:, None]))
                one, two, score = new[i], a + j, near[i, j]
                other = names[one] != names[two]
                for here, there in ((one, two), (two, one)):
                    better = other & (score > least[here])
                    held.append((names[here[better]], names[there[better]], score[better]))
                    size += int(better.sum())
            if size > 1 << 20:
                yield _found(*(np.concatenate(c) for c in zip(*held, strict=True)), most)
                held, size = [], 0
        if size:
            yield _found(*(np.concatenate(c) for c in zip(*held, strict=True)), most)

    return run


def introductions(graph: DataFrame, codes: DataFrame, number: int, most: int, sample: int) -> DataFrame:
    """FOUND rows of a round: neighbours of neighbours that are better than what a node has."""

    def pairs(batches):
        for batch in batches:
            owner, node, nbrs, _, fresh = _entries(batch)
            fresh = fresh.astype(bool)
            taken = _chosen(node, nbrs, owner, fresh, number, sample)
            columns = (node[taken], nbrs[taken], fresh[taken])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pivot", "member", "is_new"])

    taken = materialise(graph.mapInArrow(pairs, "pivot bigint, member bigint, is_new boolean"), "taken")
    mixed = F.xxhash64("pivot", "member", F.lit(number))
    others = taken.select(F.col("member").alias("pivot"), F.col("pivot").alias("member"), "is_new", mixed.alias("mixed"))
    others = others.groupBy("pivot", "is_new", F.pmod("mixed", F.lit(2 * sample)).alias("slot")).agg(
        F.min_by("member", "mixed").alias("member")
    )
    met = taken.unionByName(others.select("pivot", "member", "is_new")).groupBy("pivot", "member").agg(
        F.max("is_new").alias("is_new")
    )
    full = F.size("nbrs") >= most
    least = graph.select("node", F.when(full, F.array_min("scores")).otherwise(float("-inf")).cast("float").alias("least"))
    known = codes.join(least, "node").withColumnRenamed("node", "member")
    rows = join_groups(materialise(met, "met"), known, "member")
    rows = rows.select("pivot", "member", "is_new", "code", "scale", "least")
    dealt = rows.repartition("pivot").sortWithinPartitions("pivot")
    return dealt.mapInArrow(_introduced(most), FOUND)


def neighbour_graph(
    codes: DataFrame, size: int, count: int, most: int = NEIGHBOURS, sample: int = SAMPLE, rounds: int = ROUNDS
) -> DataFrame:
    """GRAPH: the nearest neighbours of every node, best first; all of them where there are few nodes.
    Written."""
    ship_package(codes.sparkSession)
    if count <= BLOCK:
        most = max(most, count - 1)
    graph = _take_over(None, first_neighbours(codes, size, count, most), most, -1, sample)
    for number in range(rounds if count > BLOCK else 0):
        graph = _take_over(graph, introductions(graph, codes, number, most, sample), most, number, sample)
        new = F.sum(F.size(F.filter("fresh", lambda x: x)))
        if (graph.agg(new / F.sum(F.size("fresh"))).first()[0] or 0) <= STOP:
            break
    return graph


STATE = "query bigint, v binary, ids array<bigint>, scores array<float>, visited array<boolean>"


def _started(pivots: np.ndarray, names: np.ndarray, size: int):
    """query, v, own (a node or null): states with the own node and the nearest pivots."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), size).astype(np.float32)
            near = x @ pivots.T
            own = batch.column("own").to_pylist()
            ids, scores = [], []
            for k in range(len(x)):
                top = np.argsort(-near[k])[:STARTS]
                at = [int(i) for i in names[top] if i != own[k]]
                ids.append(([] if own[k] is None else [own[k]]) + at)
                kept = [float(s) for i, s in zip(names[top], near[k][top], strict=True) if i != own[k]]
                scores.append(([] if own[k] is None else [float(x[k] @ x[k])]) + kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query"),
                    pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array(ids, pa.list_(pa.int64())),
                    pa.array(scores, pa.list_(pa.float32())),
                    pa.array([[False] * len(i) for i in ids], pa.list_(pa.bool_())),
                ],
                ["query", "v", "ids", "scores", "visited"],
            )

    return run


def _visited(width: int, beam: int):
    """States and candidates (query, cand, code, scale) sorted by query: the states after a round."""

    def run(batches):
        for table, codes, _ in sorted_groups(batches, "query"):
            rows = table.combine_chunks().to_batches()[0]
            known = rows.column("ids").is_valid().to_numpy(zero_copy_only=False)
            states, others = rows.filter(pa.array(known)), rows.filter(pa.array(~known))
            of = codes[known]
            x = np.frombuffer(b"".join(states.column("v").to_pylist()), np.float32).reshape(len(of), -1)
            at = np.empty(int(codes.max()) + 1, np.int64)
            at[of] = np.arange(len(of))
            owner = at[codes[~known]]
            scores = np.empty(0, np.float32)
            if len(owner):
                scores = np.einsum("ij,ij->i", _vectors(others)[:, : x.shape[1]], x[owner])
            sizes = states.column("ids").value_lengths().to_numpy()
            mine = np.repeat(np.arange(len(of)), sizes)
            ids, old, seen = (states.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores", "visited"))
            seen = seen.astype(bool) | _next(mine, seen.astype(bool), beam)
            group, ids, scores, fresh = best(
                np.concatenate([mine, owner]),
                np.concatenate([ids, others.column("cand").to_numpy()]),
                np.concatenate([old, scores]),
                np.concatenate([~seen, np.ones(len(owner), bool)]),
                width,
            )
            sizes = np.bincount(group, minlength=len(of))
            lists = [_lists(sizes, pa.array(c)) for c in (ids, scores.astype(np.float32), ~fresh)]
            yield pa.RecordBatch.from_arrays([states.column("query"), states.column("v"), *lists], ["query", "v", "ids", "scores", "visited"])

    return run


def _next(owner: np.ndarray, seen: np.ndarray, beam: int) -> np.ndarray:
    """The first ``beam`` entries of each owner that are not seen."""
    before = np.cumsum(~seen)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    base = np.repeat(before[heads] - ~seen[heads], np.diff(heads, append=len(owner))) if len(owner) else before
    return ~seen & (before - base <= beam)


def search(
    queries: DataFrame,
    graph: DataFrame,
    codes: DataFrame,
    size: int,
    width: int = WIDTH,
    beam: int = BEAM,
    rounds: int = SEARCH_ROUNDS,
) -> DataFrame:
    """query, node: the ``width`` best nodes of every query by the codes. ``queries``: query, v, own (its node
    or null), a row for each query."""
    ship_package(graph.sparkSession)
    some = codes.orderBy(F.xxhash64("node")).limit(PIVOTS).toArrow()
    names = some.column("node").to_numpy()
    pivots = _vectors(some)[:, : size - 1] if len(names) else np.empty((0, size - 1), np.float32)
    state = materialise(queries.select("query", "v", "own").mapInArrow(_started(pivots, names, size - 1), STATE), "state")
    links = graph.select("node", "nbrs")
    for _ in range(rounds):
        open_ = F.filter(F.arrays_zip("ids", "visited"), lambda z: ~z["visited"])
        visits = state.select("query", F.explode(F.slice(open_, 1, beam)).alias("z")).select("query", F.col("z.ids").alias("node"))
        visits = materialise(visits, "visits")
        if visits.isEmpty():
            break
        seen = join_groups(visits, links, "node").select("query", F.explode("nbrs").alias("cand")).distinct()
        met = join_groups(materialise(seen, "candidates"), codes.withColumnRenamed("node", "cand"), "cand")
        rows = state.unionByName(met.select("query", "cand", "code", "scale"), allowMissingColumns=True)
        dealt = rows.repartition("query").sortWithinPartitions("query")
        state = materialise(dealt.mapInArrow(_visited(width, beam), STATE), "state")
    return state.select("query", F.explode("ids").alias("node"))


def _exact(size: int, top: int):
    """Rows (query, q, node, v, ids) sorted by query: the ``top`` best members (vec_id, score) of each."""

    def run(batches):
        for table, codes, _ in sorted_groups(batches, "query", rows=1 << 13):
            rows = table.combine_chunks().to_batches()[0]
            heads = np.flatnonzero(np.diff(codes, prepend=-1))
            scores = (_matrix(rows.column("q"), size) * _matrix(rows.column("v"), size)).sum(axis=1)
            sizes = rows.column("ids").value_lengths().to_numpy()
            ids = rows.column("ids").flatten().to_numpy()
            owner, scores = np.repeat(codes, sizes), np.repeat(scores, sizes)
            order = np.lexsort((ids, -scores, owner))
            owner, ids, scores = owner[order], ids[order], scores[order]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            kept = np.arange(len(owner)) - np.repeat(first, np.diff(first, append=len(owner))) < top
            owner, ids, scores = owner[kept], ids[kept], scores[kept]
            counts = np.bincount(owner, minlength=len(heads))
            found = pa.StructArray.from_arrays([pa.array(ids), pa.array(scores)], ["vec_id", "score"])
            yield pa.RecordBatch.from_arrays([rows.column("query").take(pa.array(heads)), _lists(counts, found)], ["query", "found"])

    return run


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of every row of ``queries``, rows of the same
    table, other than itself."""
    ship_package(rows.sparkSession)
    distinct = nodes(valid(rows, id_column, vector_column), k + 1)
    codes, size, count = coded(distinct)
    graph = neighbour_graph(codes, size, count)
    asked = materialise(valid(queries, id_column, vector_column).withColumnRenamed("id", "query_id"), "asked")
    asked = materialise(join_groups(asked, distinct.select("v", "node"), "v").select("query_id", "node"), "queries")
    searched = distinct.join(asked.select("node").distinct(), "node").select(F.col("node").alias("query"), "v", F.col("node").alias("own"))
    found = materialise(search(searched, graph, codes, size), "found")
    pairs = materialise(join_groups(found, distinct, "node"), "pairs")
    mine = distinct.select(F.col("node").alias("query"), F.col("v").alias("q"))
    dealt = pairs.join(mine, "query").select("query", "q", "v", "ids").repartition("query").sortWithinPartitions("query")
    answers = dealt.mapInArrow(_exact(size - 1, k + 1), "query bigint, found array<struct<vec_id:bigint,score:double>>")
    answers = materialise(answers.withColumnRenamed("query", "node"), "answers")
    each = join_groups(asked, answers, "node")
    own = F.array_position(F.transform("found", lambda x: x["vec_id"]), F.col("query_id"))
    others = F.slice(
        F.when(own > 0, F.concat(F.slice("found", F.lit(1), (own - 1).cast("int")), F.slice("found", (own + 1).cast("int"), F.lit(k)))).otherwise(
            F.col("found")
        ),
        1,
        k,
    )
    return each.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"
    )
