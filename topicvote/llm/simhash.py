"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits. To link fingerprints that differ in at most ``bits`` (4) places, it is
cut into blocks of 22, 21 and 21 bits, and every fingerprint is copied to cells:

* one cell for the value of each block, which finds links that leave a block unchanged;
* anchors. If no block is unchanged, each has at least one difference, so at most one block has
  two, and the first or the second block has exactly one. The anchors are the words of the binary
  Golay code: every 23-bit value lies within its covering radius 3 of exactly one of them (blocks
  are padded with zeros). Two values one bit apart have different parity. The even one goes to the
  anchor within radius 3, the odd one to every anchor within radius 3 + 1, and so they meet. At
  most three differences lie in the other two blocks, so of four parts of these one is unchanged
  and narrows the cell.

That makes about 28 copies of a distinct fingerprint, each of 16 bytes. Fingerprints are compared
inside a cell; a cell of more than ``CELL_ROWS`` is dealt out again as pairs of slices, so that no
task holds more than two slices. Equal fingerprints are one row throughout.

So links of at most two differing bits, and those of more that leave a block unchanged, are found by
the value of a block, and all others by anchors: of pairs of three bits about a quarter, of pairs of
four about half. A third method would be exact only up to four differences, so ``bits`` may be 0 to 4.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.llm.common import column, join_groups, map_rows
from topicvote.llm.components import connected
from topicvote.session import materialise, ship_package

SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))
CELL_ROWS = 20_000
SHORT_RUN = 16
HASH_BLOCK = 1 << 16


def _folded(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by single spaces, A-Z in lower case, and where each word begins and ends."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]
    joined = np.where(space, 32, raw)[keep].astype(np.uint8)
    if len(joined) and joined[-1] == 32:
        joined = joined[:-1]
    gaps = np.flatnonzero(joined == 32)
    begins = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    return joined.tobytes(), begins, ends


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned SimHash of all shingles of ``words`` words, repeats included."""
    joined, begins, ends = _folded(text or "")
    if not joined:
        return 0
    width = min(words, len(begins))
    count = len(begins) - width + 1
    begins, ends = begins[:count], ends[width - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, count, HASH_BLOCK):
        spans = zip(begins[at : at + HASH_BLOCK].tolist(), ends[at : at + HASH_BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    ship_package(docs.sparkSession)

    def run(batch):
        values = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(column(docs, id_column).alias("doc_id"), column(docs, text_column).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the nearest error (weight 3 at most), and the five errors
    of weight 4, which exist where the nearest has weight 3 (else repeats of the nearest)."""
    generator = 0b101011100011

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= generator << (bit - 11)
        return word

    single = [syndrome(1 << b) for b in range(23)]
    nearest, fourth = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    places = range(23)
    for a in places:
        nearest[single[a]] = 1 << a
        for b in range(a):
            nearest[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                nearest[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
                for d in range(c):
                    fourth[single[a] ^ single[b] ^ single[c] ^ single[d]].append(1 << a | 1 << b | 1 << c | 1 << d)
    far = np.array([errors or [nearest[s]] * 5 for s, errors in enumerate(fourth)], np.int64)
    return nearest, far


def _syndromes(values: np.ndarray) -> np.ndarray:
    words = values.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, 0b101011100011 << (bit - 11), 0)
    return words


def anchors(values: np.ndarray, wide: bool) -> np.ndarray:
    """The anchors of 23-bit values, a column each: the one within radius 3, and if ``wide`` those
    within radius 4 as well (a value without such repeats its first)."""
    nearest, far = _golay()
    s = _syndromes(values)
    home = values ^ nearest[s]
    return np.column_stack([home, values[:, None] ^ far[s]]) if wide else home[:, None]


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cell, index of the fingerprint: all cells of all fingerprints."""
    bits = fps.view(np.uint64)
    blocks = [(bits >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in BLOCKS]
    every = np.arange(len(fps))
    cells, owners = [], []
    for i, block in enumerate(blocks):
        cells.append(np.int64(i) << 58 | block)
        owners.append(every)
    for i in (0, 1):
        rest = [(blocks[k], BLOCKS[k][1]) for k in range(3) if k != i]
        parts = [part for v, size in rest for part in (v & 1023, v >> 10)]
        odd = np.bitwise_count(blocks[i]) % 2 == 1
        for rows, wide in ((every[~odd], False), (every[odd], True)):
            places = anchors(blocks[i][rows], wide)
            first = np.ones(places.shape, bool)
            first[:, 1:] = places[:, 1:] != places[:, :1]
            for p, part in enumerate(parts):
                where = np.int64(3 + i) << 58 | np.int64(p) << 50 | places << 16 | part[rows][:, None]
                cells.append(where[first])
                owners.append(np.broadcast_to(rows[:, None], places.shape)[first])
    return np.concatenate(cells), np.concatenate(owners)


def _distance(left: np.ndarray, right) -> np.ndarray:
    """Differing bits; numpy would count those of the absolute value of a signed number."""
    return np.bitwise_count((left ^ right).view(np.uint64))


def _absorb(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``fps``: every fingerprint is compared with
    those not reached yet, so a dense group costs one comparison for each member."""
    links, open_, frontier = [], fps, []
    while len(open_):
        if not frontier:
            frontier, open_ = [open_[0]], open_[1:]
        here = frontier.pop()
        near = _distance(open_, here) <= bits
        found = open_[near]
        links += [(int(here), int(x)) for x in found]
        frontier += list(found)
        open_ = open_[~near]
    return links


def _links(cells: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Pairs within ``bits`` of rows sorted by cell, enough to connect all that is linked."""
    edge = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
    sizes = np.diff(edge)
    found = [np.empty((0, 2), np.int64)]
    short = np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes)
    c, f = cells[short], fps[short]
    for lag in range(1, SHORT_RUN):
        same = c[lag:] == c[:-lag]
        if not same.any():
            break
        a, b = f[:-lag][same], f[lag:][same]
        near = _distance(a, b) <= bits
        found.append(np.column_stack([a[near], b[near]]))
    for k in np.flatnonzero(sizes > SHORT_RUN):
        pairs = _absorb(fps[edge[k] : edge[k + 1]], bits)
        if pairs:
            found.append(np.array(pairs, np.int64))
    return np.concatenate(found)


def _compare(bits: int, most: int | None):
    """Compares rows sorted by cell, batch by batch. A cell with more than ``most`` rows is not
    compared but given out again in slices of that size, with the slice's number."""

    def out(pairs, cell=None, slices=None):
        n = len(pairs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(pairs[:, 0]),
                pa.array(pairs[:, 1]),
                pa.array([None] * n if cell is None else np.full(n, cell), pa.int64()),
                pa.array([None] * n if slices is None else slices, pa.int64()),
            ],
            ["a", "b", "cell", "slice"],
        )

    def run(batches):
        cells, fps, given, heavy = np.empty(0, np.int64), np.empty(0, np.int64), 0, None

        def flush():
            pairs = np.column_stack([fps, fps])
            return out(pairs, int(cells[0]), (given + np.arange(len(fps))) // most)

        for batch in batches:
            cells = np.concatenate([cells, batch.column("cell").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if heavy is not None:
                n = int(np.searchsorted(cells, heavy, "right"))
                rest = cells[n:], fps[n:]
                cells, fps = cells[:n], fps[:n]
                if n:
                    yield flush()
                    given += n
                cells, fps = rest
                if not len(cells):
                    continue
                heavy, given = None, 0
            last = int(np.searchsorted(cells, cells[-1], "left"))
            if last:
                pairs = _links(cells[:last], fps[:last], bits)
                if len(pairs):
                    yield out(np.unique(np.sort(pairs, axis=1), axis=0))
                cells, fps = cells[last:], fps[last:]
            if most is not None and len(cells) > most:
                yield flush()
                heavy, given = int(cells[0]), len(cells)
                cells, fps = cells[:0], fps[:0]
        if len(cells):
            pairs = _links(cells, fps, bits)
            if len(pairs):
                yield out(np.unique(np.sort(pairs, axis=1), axis=0))

    return run


def near_links(fps: DataFrame, bits: int = 4, most: int = CELL_ROWS) -> DataFrame:
    """a, b: links among the distinct fingerprints ``fps`` (fp), at most ``bits`` apart and enough
    of them to connect everything that is linked."""
    if not 0 <= bits <= 4:
        raise ValueError("the anchors cover up to four differing bits")
    ship_package(fps.sparkSession)
    compared = "a bigint, b bigint, cell bigint, slice bigint"

    def place(batch):
        values = batch.column("fp").to_numpy()
        cells, owners = _cells(values)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values[owners])], ["cell", "fp"])

    placed = map_rows(fps.select("fp"), place, "cell bigint, fp bigint")
    first = materialise(
        placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(bits, most), compared), "links"
    )
    heavy = first.filter("cell IS NOT NULL")
    links = first.filter("cell IS NULL").select("a", "b")
    if not heavy.isEmpty():
        slices = heavy.groupBy("cell").agg(F.max("slice").alias("last"))
        tiles = heavy.join(slices, "cell").select(
            F.col("a").alias("fp"),
            F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"),
            F.xxhash64("cell", F.least("slice", "other"), F.greatest("slice", "other")).alias("cell"),
        )
        again = tiles.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(bits, None), compared)
        links = links.union(again.select("a", "b"))
    return links


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, bits: int = 4
) -> DataFrame:
    """doc_id, fp, component_id for every row: component_id is the smallest id that links reach.

    Texts without a word share fingerprint 0 and are linked like any other; ids may repeat or be
    null (a group of null ids only has a null component_id)."""
    hashed = materialise(fingerprints(docs, id_column, text_column, words), "fingerprints")
    distinct = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = materialise(connected(near_links(distinct, bits)).toDF("fp", "root"), "roots")
    linked = materialise(roots.join(distinct, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = join_groups(linked, least, "root").select("fp", "component_id")
    classes = distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id")
    )
    return join_groups(hashed, classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, bits: int = 4
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one with the smallest id
    (null last), of equal ids the one that was read first. Rows are told apart by a number they get
    in a first write, so ids may repeat."""
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    name = column(rows, id_column)
    order = F.struct(name.isNull().alias("none"), name.alias("id"), F.col(number).alias("row"))
    texts = rows.select(order.alias("doc_id"), column(rows, text_column).alias("text"))
    groups = near_groups(texts, words=words, bits=bits)
    lost = groups.filter("doc_id.row != component_id.row").select(F.col("doc_id.row").alias(number))
    return rows.join(materialise(lost, "lost"), number, "left_anti").select(*[column(rows, c) for c in docs.columns])
