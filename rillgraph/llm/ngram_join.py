"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike, exactly.

The space is the metric d(x, y) = 1 - |x & y| / |x | y| over sets of shingles; linked sets are
within r = 1 - similarity. Almost all texts of a corpus lie at distance 1 from each other, where
no pivot tells them apart. So the space is first cut into candidate regions that no link leaves:

 1. Two linked sets share at least (1 - r) |x| of x's shingles. Whatever the order of shingles,
    the first of them that they share is among the first |x| - ceil((1 - r) |x|) + 1 of either:
    each set enters the cells of those shingles, and every linked pair meets in a cell. The order puts
    shingles that many texts hold last. A cell of at most 128 sets gives the pairs that sizes and
    counts of shared cells still admit; a larger one joins all its sets. Regions are the components.
 2. A region that fits a task is compared there, with whole sets.
 3. A larger one is parted by pivots, documents of its own: each document is at home with the
    nearest. If d(x, y) <= r and x is at home with p, then d(y, p) <= d(x, p) + r <= d(x, q) + r <=
    d(y, q) + 2r for y's own nearest pivot q: so y is replicated into p's region if it is within that
    window. Documents within r of a pivot are linked by that; in its region they are
    compared only with those that are not, as far as the distances to the pivot differ by at
    most r. The regions are joined in the same way, until they fit.
 4. A region whose windows hold nearly all of it (equidistant sets) is compared block by block;
    each block gives only the edges of its components.

Sets that are equal are one class and compared once. Compared means with the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, bitmap, bounded_batches, components, freed, lean, partitions, sorted_groups, stable, table, written

WORDS, PERCENT = 5, 80
PIVOTS = 8  # of a region at each level
EPS = 1e-9
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20240521)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text its set of shingles, as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs of other bytes than 0x20 and 0x09-0x0D. A text of
    fewer words than `words` has its whole sequence as its one shingle, one without words none.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    white = _WHITE[joined]
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    stops = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[_LOWER[joined]] * _power(_P, len(joined)))))
    word = _mix((sums[stops] - sums[starts]) * _power(_P_INVERSE, len(joined))[starts] + (stops - starts).astype(np.uint64) * _Q)
    q = _power(_Q, words)
    spread = word[: max(0, len(word) - words + 1)].copy()
    for k in range(1, words):
        spread += word[k : k + len(spread)] * q[k]
    spread = _mix(spread)
    first = np.searchsorted(starts, np.concatenate(([0], ends[:-1])))
    last = np.searchsorted(starts, ends)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            s = np.sort(spread[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(_mix((word[a:b] * q[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray], list[int], pa.RecordBatch]]:
    """(ids, sets, class of each set, the rows) of about a megabyte of text at a time; class 0: empty."""
    import xxhash

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        at = 0
        while at < len(ids):
            some, size = [], 0
            while at + len(some) < len(ids) and (size < 1 << 20 or not some):
                some.append(texts[at + len(some)].as_py() or b"")
                size += len(some[-1])
            sets = shingle_sets(some, words)
            classes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0 for s in sets]
            yield ids[at : at + len(some)], sets, classes, batch.slice(at, len(some))
            at += len(some)


class Common:
    """Shingles that many sets hold, sorted, with their counts in the sample; they come last in the order, by count."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of s are common, the counts of those)."""
        if not len(self.shingles):
            return np.zeros(len(s), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        hot = self.shingles[at] == s
        return hot, self.counts[at[hot]]


def _prefix(s: np.ndarray, common: Common, percent: int) -> tuple[np.ndarray, int]:
    """x's window: its first cells by (common, count, hash), and how many of those are common ones."""
    n = len(s)
    size = n - (percent * n + 99) // 100 + 1
    hot, counts = common.find(s)
    cold = s[~hot]
    if len(cold) >= size:
        return cold[:size], 0
    last = s[hot][np.argsort(counts, kind="stable")]
    return np.concatenate((cold, last[: size - len(cold)])), size - len(cold)


def _members(texts: DataFrame, words: int, buckets: int, sample: int) -> DataFrame:
    """Rows (doc_id, c, n, h) of every document: its class, set size and text's hash; and rows (b, blob): the shingles of one
    in `sample` of the classes, by hash, packed by bucket."""

    def read(batches):
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        size = 0
        names = ["doc_id", "c", "n", "h", "b", "blob"]

        def packed():
            s = np.concatenate(parts)
            where = (s % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            keys = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            none = pa.nulls(len(keys), pa.int64())
            return pa.record_batch([none, none, none, none, pa.array(keys, pa.int64()), pa.array([s[order[cuts[b] : cuts[b + 1]]].tobytes() for b in keys], pa.binary())], names=names)

        for ids, sets, classes, rest in _sets(batches, words):
            none = pa.nulls(len(ids), pa.int64())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), rest.column(2), none, pa.nulls(len(ids), pa.binary())], names=names)
            for s, c in zip(sets, classes, strict=True):
                if c and c % sample == 0 and c not in seen:
                    seen.add(c)
                    parts.append(s)
                    size += len(s)
            if size > 1 << 20:
                yield packed()
                parts, size = [], 0
        if parts:
            yield packed()

    return texts.mapInArrow(lean(read), "doc_id long, c long, n long, h long, b long, blob binary")


def _common(packed: DataFrame, buckets: int, least: int, most: int) -> Common:
    """The commonest shingles of the sample, `most` at most, of those that `least` of its sets hold.
    Only the order of cells depends on them; copies of a class in other partitions count too."""

    def counted(batches):
        for group in sorted_groups(batches):
            values, n = np.unique(np.frombuffer(b"".join(group.column(1).to_pylist()), np.uint64), return_counts=True)
            keep = n >= least
            yield pa.record_batch([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["s", "k"])

    rows = packed.repartition(buckets, "b").sortWithinPartitions("b").mapInArrow(lean(counted), "s long, k long")
    rows = rows.orderBy(F.desc("k"), "s").limit(most).toArrow()
    return Common(rows["s"].to_numpy().view(np.uint64), rows["k"].to_numpy())


def _entries(texts: DataFrame, common: Common, words: int, percent: int, buckets: int) -> DataFrame:
    """(b, blob): the entries (cell, class, size and number of common cells) of all classes for the cells
    of their windows, packed by bucket. A common cell is spread over 64 buckets."""
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def entered(batches):
        common = sent.value
        seen: set[int] = set()
        cells: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0

        def packed():
            cell, row = np.concatenate(cells), np.concatenate(rows)
            salt = np.where(common.find(cell)[0], row[:, 0] & 63, 0).view(np.uint64)
            where = (_mix(cell + salt * _P) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            keys = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            blobs = [np.rec.fromarrays([cell[o], row[o, 0], row[o, 1]], names="s,c,m").tobytes() for b in keys for o in [order[cuts[b] : cuts[b + 1]]]]
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["b", "blob"])

        for _, sets, classes, _ in _sets(batches, words):
            for s, c in zip(sets, classes, strict=True):
                if c and c not in seen:
                    seen.add(c)
                    window, hot = _prefix(s, common, percent)
                    cells.append(window)
                    rows.append(np.tile(np.array([[c, len(s) << 32 | hot]], np.int64), (len(window), 1)))
                    held += len(window)
            if held > 1 << 20:
                yield packed()
                cells, rows, held = [], [], 0
        if held:
            yield packed()

    return texts.mapInArrow(lean(entered), "b long, blob binary")


def _cells(entries: DataFrame, common: Common, percent: int, most: int = 128) -> DataFrame:
    """(a, z, ma, mz, k). Of a cell of at most `most` classes: the pairs whose sizes admit a link, with
    the number of cells that they share here. Of a larger one, with k = 0: each class beside
    the cell's smallest, or, if the cell is spread, beside the smallest here, and that one beside the cell itself."""
    sent = entries.sparkSession.sparkContext.broadcast(common)
    kind = np.dtype([("s", np.uint64), ("c", np.int64), ("m", np.int64)])

    def met(batches):
        common = sent.value
        for group in sorted_groups(batches):
            e = np.frombuffer(b"".join(group.column(1).to_pylist()), kind)
            e = e[np.lexsort((e["c"], e["s"]))]
            e = e[np.concatenate(([True], (e["s"][1:] != e["s"][:-1]) | (e["c"][1:] != e["c"][:-1])))]
            new = np.concatenate(([True], e["s"][1:] != e["s"][:-1]))
            cut = np.flatnonzero(np.concatenate((new, [True])))
            sizes = np.diff(cut)
            spread = common.find(e["s"][cut[:-1]])[0]
            large = spread | (sizes > most)
            if large.any():
                cell = np.cumsum(new) - 1
                pivot = e["c"][cut[:-1]]  # the smallest of the cell
                own = large[cell]
                stars = np.stack((e["c"][own], pivot[cell[own]]))
                stars = np.concatenate((stars, np.stack((pivot[spread], e["s"][cut[:-1]][spread].view(np.int64)))), axis=1)
                yield from _told([np.concatenate((stars, np.zeros_like(stars)))], stars=True)
            found: list[np.ndarray] = []
            held = 0
            n = e["m"] >> 32
            for m in np.unique(sizes[~large & (sizes > 1)]).tolist():
                at = cut[:-1][~large & (sizes == m)]
                for k in range(1, m):  # the pairs (j, j + k) of all cells of m entries at once
                    for j in range(m - k):
                        x, y = at + j, at + j + k
                        ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                        found.append(np.stack((e["c"][x[ok]], e["c"][y[ok]], e["m"][x[ok]], e["m"][y[ok]])))
                        held += int(ok.sum())
                    if held > 1 << 19:
                        yield from _told(found)
                        found, held = [], 0
            yield from _told(found)

    return entries.mapInArrow(lean(met), "a long, z long, ma long, mz long, k long")


def _told(found: list[np.ndarray], stars: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs (a, z, ma, mz), each once with its count; of stars the count is 0."""
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    if not rows.shape[1]:
        return
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    new = np.flatnonzero(np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))))
    counts = np.zeros(len(new), np.int64) if stars else np.diff(np.concatenate((new, [rows.shape[1]])))
    rows = rows[:, new]
    for i in range(0, len(new), 1 << 16):
        columns = [*rows[:, i : i + (1 << 16)], counts[i : i + (1 << 16)]]
        yield pa.record_batch([pa.array(x) for x in columns], names=["a", "z", "ma", "mz", "k"])


def _held(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(c, text) of the classes in wanted(c) and a few others: one text of each."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "c"))

    def chosen(batches):
        seen: set[int] = set()
        for _, _, classes, rows in _sets(batches, words):
            c = np.array(classes, np.int64)
            keep = []
            for i in np.flatnonzero(among(bits.value, c) & (c != 0)).tolist():
                if classes[i] not in seen:
                    seen.add(classes[i])
                    keep.append(i)
            if keep:
                yield pa.record_batch([pa.array(c[keep]), rows.column(1).take(pa.array(keep))], names=["c", "text"])

    return texts.mapInArrow(lean(chosen), "c long, text string").groupBy("c").agg(F.first("text").alias("text"))


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    inter = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return inter / (len(x) + len(y) - inter)


def _voronoi(large: DataFrame, held: DataFrame, depth: int, words: int, percent: int) -> DataFrame:
    """(g, c, n, p, d, own, linked): the pivots p of region g that document c is at home with or in whose
    window it lies, at distance d. large has g, c and the number of parts that a region is dealt to."""
    r = 1 - percent / 100
    least = [F.min(F.struct(F.xxhash64("c", F.lit(depth * PIVOTS + i)).alias("h"), "c")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = large.groupBy("g").agg(*least, F.max("parts").alias("parts"))
    pivots = pivots.select("g", "parts", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.c") for i in range(PIVOTS)]))).alias("c")).join(held, "c")
    task = lambda salt: F.xxhash64("g", salt).alias("task")
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(task("salt"), F.lit(True).alias("pivot"), "g", "c", "text")
    rows = large.join(held, "c").select(task(F.pmod(F.xxhash64("c"), "parts").cast("int")), F.lit(False).alias("pivot"), "g", "c", "text")

    def distances(batches):
        task, names, pivots = None, [], []
        for batch in batches:
            tasks, kinds, regions, classes = (c.to_pylist() for c in batch.columns[:4])
            sets = shingle_sets([t.as_py() for t in batch.column(4).cast(pa.binary())], words)
            out: list[tuple] = []
            for t, pivot, g, c, s in zip(tasks, kinds, regions, classes, sets, strict=True):
                if t != task:
                    task, names, pivots = t, [], []
                if pivot:
                    names.append(c)
                    pivots.append(s)
                    continue
                d = np.array([1 - _likeness(s, p) for p in pivots])
                home = int(np.argmin(d))
                out += [(g, c, len(s), names[i], float(d[i]), i == home, d[i] <= r + EPS) for i in np.flatnonzero(d <= d[home] + 2 * r + EPS).tolist()]
            if out:
                types = [pa.int64()] * 4 + [pa.float64(), pa.bool_(), pa.bool_()]
                yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*out, strict=True), types, strict=True)], names=["g", "c", "n", "p", "d", "own", "linked"])

    rows = pivots.unionByName(rows).repartition("task").sortWithinPartitions("task", F.desc("pivot"))
    return rows.mapInArrow(lean(distances), "g long, c long, n long, p long, d double, own boolean, linked boolean")


def _linked_blocks(work: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, z): edges of the components of links between the left and the right documents of each task."""

    def compared(batches):
        edges: list[tuple[int, int]] = []

        def told():
            out = pa.record_batch([pa.array([x for x, _ in edges], pa.int64()), pa.array([x for _, x in edges], pa.int64())], names=["a", "z"])
            edges.clear()
            return out

        for group in sorted_groups(batches):
            if group.num_rows > 1:
                sets = shingle_sets([t.as_py() for t in group.column("text").cast(pa.binary())], words)
                edges += _block_links(group.column("c").to_numpy(), sets, *(group.column(x).to_numpy(zero_copy_only=False) for x in ("left", "right")), percent)
            if len(edges) > 1 << 14:
                yield told()
        yield told()

    rows = work.join(held, "c").select("task", "c", "left", "right", "text").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(lean(compared), "a long, z long")


def _block_links(c: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges (a, z) of the components of links between the left and the right members, by whole sets.

    Memory is the product of the left and the right ones, 4 bytes each, and 2,048 columns of either."""
    n = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = count >= 2
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    at_row, at_column = np.full(len(sets), -1), np.full(len(sets), -1)
    at_row[rows], at_column[columns] = np.arange(len(rows)), np.arange(len(columns))
    inter = np.zeros((len(rows), len(columns)), np.float32)  # counts under 2**24 are exact
    total = int(shared.sum())
    wide = min(2048, max(1, total))
    for lo in range(0, total, wide):
        a, b = np.searchsorted(column, (lo, lo + wide))
        x, y = np.zeros((len(rows), wide), np.float32), np.zeros((len(columns), wide), np.float32)
        r, q = at_row[owner[a:b]], at_column[owner[a:b]]
        x[r[r >= 0], column[a:b][r >= 0] - lo] = 1
        y[q[q >= 0], column[a:b][q >= 0] - lo] = 1
        inter += x @ y.T
    ok = np.zeros(inter.shape, bool)
    for i, row in enumerate(rows.tolist()):
        ok[i] = 100 * inter[i].astype(np.int64) >= percent * (n[row] + n[columns] - inter[i].astype(np.int64))
    edges, free = [], np.ones(len(sets), bool)
    for first in rows.tolist():
        if not free[first]:
            continue
        free[first], front = False, np.array([first])
        while len(front):
            near = np.zeros(len(sets), bool)
            r, q = at_row[front], at_column[front]
            near[columns] |= ok[r[r >= 0]].any(0)
            near[rows] |= ok[:, q[q >= 0]].any(1)
            front = np.flatnonzero(near & free)
            free[front] = False
            edges += [(int(x), int(c[first])) for x in c[front]]
    return edges


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, sample: int = 8, common_at: int = 3, common_most: int = 1 << 19, most: int = 2048, block: int = 1 << 19) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, class_first, group_id, text_hash.

    component_id is the smallest doc_id that links of similarity >= percent/100 reach. Null
    and empty texts and those without words have no shingles, link with nothing and are
    their own component (class_id and group_id null). class_id names equal sets and group_id
    components, whatever their ids; class_first is the smallest doc_id with an equal set (its own without words); text_hash is xxhash64 of the text. Rows that repeat a doc_id each get a row; a null
    doc_id links as any other and a component of such rows alone has a null id. Other
    columns are not read. `sample`, `common_at` and `common_most` set which cells are put last, `most`
    and `block` how many documents and shingles of a region are compared in one task; none changes the result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    r = 1 - percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    buckets = partitions(spark)
    read, drop_read = written(_members(texts, words, 8 * buckets, sample))
    common = _common(read.where("b is not null").select("b", "blob"), buckets, common_at, common_most)
    members, _ = written(read.where("c is not null").select("doc_id", "c", "n", "h"))
    drop_read()
    kinds = members.where("c <> 0").groupBy("c").agg(F.max("n").alias("n"), F.min("doc_id").alias("first"))
    kinds, drop_kinds = written(kinds)

    # Candidate regions: what cells join.
    entries = _entries(texts, common, words, percent, 8 * buckets).repartition(buckets, "b").sortWithinPartitions("b")
    cells, drop_cells = written(_cells(entries, common, percent))
    size = lambda m: F.shiftright(m, 32)
    # Shared shingles are at most those counted, the common ones and those past either window.
    past = lambda m: F.ceil(size(m) * percent / 100) - 1 + m.bitwiseAND(F.lit(0xFFFFFFFF))
    need = F.ceil(percent * (size(F.col("ma")) + size(F.col("mz"))) / (100 + percent) - 1e-6)
    rare = cells.where("k > 0").groupBy("a", "z", "ma", "mz").agg(F.sum("k").alias("k")).where(F.col("k") + F.greatest(past(F.col("ma")), past(F.col("mz"))) >= need)
    regions, drop_regions = written(components(rare.select("a", "z").unionByName(cells.where("k = 0").select("a", "z").distinct()), "a", "z"))
    drop_cells()
    freed(spark)

    todo = regions.join(kinds, F.col("node") == F.col("c")).select(F.col("root").alias("g"), "c", "n")
    sized = lambda some: some.join(some.groupBy("g").agg(F.count("*").alias("docs"), F.ceil(F.greatest(F.count("*") / most, F.sum("n") / block)).cast("int").alias("parts")).where("docs > 1"), "g")
    todo, drop_todo = written(sized(todo))
    drops = [drop_kinds, drop_todo]
    drop_regions()
    held, drop_held = written(_held(texts, todo.select("c"), words))
    freed(spark)
    work, links = [], []
    depth = 0
    while True:
        work.append(todo.where("parts = 1").select(F.col("g").alias("task"), "c", F.lit(True).alias("left"), F.lit(True).alias("right")))
        large = todo.where("parts > 1")
        if large.isEmpty():
            break
        seen, drop_seen = written(_voronoi(large, held, depth, words, percent))
        drops.append(drop_seen)
        links.append(seen.where("linked and c <> p").select(F.col("c").alias("a"), F.col("p").alias("z")))
        # Two documents linked with the pivot need no comparison; one linked with it and one that is not are no nearer than their distances to it differ.
        far = seen.groupBy("g", "p").agg(F.max("own").alias("home"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("far")).where("home and far is not null").select("g", "p", "far")
        inner = seen.join(far, ["g", "p"]).where(~F.col("linked") | (F.col("d") >= F.col("far") - r - EPS))
        inner, drop_inner = written(inner.select("g", "p", "c", "n"))
        # A region whose windows hold nearly all of it is equidistant, more pivots would not part it: blocks.
        whole = large.groupBy("g").agg(F.max("docs").alias("docs"))
        parted = inner.groupBy("g", "p").agg(F.count("*").alias("k")).groupBy("g").agg(F.max("k").alias("top"), F.sum("k").alias("sum"))
        flat = whole.join(parted, "g").where("top > 0.7 * docs or sum > 2 * docs").select("g")
        own = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
        blocks = large.join(flat, "g").select("g", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        work.append(blocks.select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "c", (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right")))
        deeper = inner.join(flat, "g", "left_anti").select(F.xxhash64("g", "p", F.lit(depth)).alias("g"), "c", "n")
        todo, drop_todo = written(sized(deeper))
        drops += [drop_inner, drop_todo]
        depth += 1
    links.append(_linked_blocks(reduce(DataFrame.unionByName, work), held, words, percent))
    roots = components(reduce(DataFrame.unionByName, links), "a", "z")
    classes = kinds.join(roots, F.col("c") == F.col("node"), "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stable(classes.join(smallest, "root").select(F.col("c").alias("class_id"), F.col("first").alias("class_first"), "component_id", F.col("root").alias("group_id")))
    for drop in [*drops, drop_held]:
        drop()
    freed(spark)
    component = F.coalesce("component_id", F.when(F.col("class_id").isNull(), F.col("doc_id")))
    return members.join(classes, members.c == classes.class_id, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "class_id", F.coalesce("class_first", F.when(F.col("class_id").isNull(), F.col("doc_id"))).alias("class_first"), "group_id", F.col("h").alias("text_hash"))


def one_of_each(docs: DataFrame, most: int = 1 << 20, **how) -> DataFrame:
    """The rows of docs, one of each component of similarity_components: the smallest doc_id, of
    rows that share it the one with the smallest text hash, of equal ones any.

    A row without an id stays only where its component has none with one. Rows without words
    all stay. Rows to drop are told by (doc_id, text hash); up to `most` of them are broadcast, at 16 bytes each.
    """
    found = similarity_components(docs, **how).where("group_id is not null").select("doc_id", "text_hash", "group_id")
    found, drop = written(found)
    first = found.groupBy("group_id").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")).where("rows > 1")
    marks = found.join(first, "group_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("_stays")).distinct()
    marks, _ = written(marks)
    drop()
    freed(docs.sparkSession)
    mark = F.broadcast(marks) if marks.count() <= most else marks
    rows = docs.join(mark, docs["doc_id"].cast("long").eqNullSafe(mark["_id"]) & (F.xxhash64(docs["text"].cast("string")) == mark["_hash"]), "left")
    return rows.where("_stays is null").select(*docs.columns).unionByName(rows.where("_stays").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_id here is the smallest doc_id with an equal set."""
    found = similarity_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("class_first").alias("class_id"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w),
k AS (SELECT sh, min(doc_id) AS class_id FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT class_id, len(sh) AS n, unnest(sh) AS x FROM k),
l AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c(class_id, root) AS (SELECT class_id, class_id FROM k UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.class_id),
m AS (SELECT class_id, min(root) AS component_id FROM c GROUP BY class_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(k.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN k ON k.sh = s.sh LEFT JOIN m ON m.class_id = k.class_id
"""
