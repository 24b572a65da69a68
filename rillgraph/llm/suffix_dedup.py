"""Suffix-array dedup: bytes covered by long strings that occur elsewhere too.

A position repeats if its longest previous factor (the longest match with a suffix that starts
earlier) or its longest next one reaches `length` bytes. A suffix array of a whole corpus would have to be
in one memory; so suffixes are ordered among those that can match at all: in each string of
`length` bytes the smallest fingerprint of its k-byte substrings (the leftmost, if equal) is
its anchor, and equal strings have equal anchors at the same place.

 1. Every anchor gives a row with the fingerprint of its whole context, the bytes that
    strings with that anchor can reach. A context that occurs twice repeats wholly; an
    anchor whose contexts all differ in one row alone repeats nowhere.
 2. Where an anchor has several contexts, one of each kind that shares the bytes on either side with
    another is compared, by bytes: for each distance before the anchor the suffixes that start there are put in
    order, and the longest factor of each is its match with the previous or the next one.
 3. Contexts of one anchor that are too many for a task are parted by halves of the distances and the
    bytes that all strings of a half hold, until they fit. Contexts that are equal as far as a part reaches
    all repeat there, and one of them goes on; so a long common passage is parted only near its ends.

Equal texts share their rows (a text is named by a 64-bit hash), so copies are compared once.

A passage of many words may well be shorter than `length` bytes. The words of passages that another document
holds too are counted apart, by the same anchors over words instead of bytes: an anchor's context that two texts
hold is shared wholly, and of the others each window of `words` words goes by its fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, bitmap, bounded_batches, freed, lean, sorted_groups, table, written
from .ngram_join import _P, _P_INVERSE, _TABLE, _mix, _power

LENGTH, K = 400, 100
MOST = 2048  # contexts that are compared in one task, about 1.4 MB and 40 MB of lengths
WORDS, WORDS_K = 51, 12  # the shortest passage, of over 50 words, and the words of an anchor; they differ by less than 63
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _sums(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * _power(_P, len(raw)))))


def _prints(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Fingerprints of raw[start:stop], which depend on those bytes and their number alone."""
    n = len(sums)
    return _mix((sums[stops] - sums[starts]) * _power(_P_INVERSE, n)[starts] + (stops - starts).astype(np.uint64))


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, fingerprint, context's fingerprint, sides) of the anchors of all strings of `length` bytes.

    Each such string reaches either half its spare bytes before the anchor or half of them
    behind it; sides holds 32 bits for the bytes of the first kind and 32 for the second, 0
    where the text ends before.

    The texts together are shorter than 2**24 bytes, or one text is taken in pieces.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return _anchors(_sums(raw), np.cumsum([len(t) for t in texts], dtype=np.int64), length, k)


def _word_sums(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, stops): as those of the texts' bytes, of their words' fingerprints. Words are runs of other bytes than 0x20 and 0x09-0x0D."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False))
    words = _prints(_sums(raw), edges[::2], edges[1::2])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _power(_P, len(words)))))
    return sums, np.searchsorted(edges[::2], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))


def word_anchors(texts: list[bytes], words: int = WORDS, k: int = WORDS_K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As anchors, of all passages of `words` words; positions count words."""
    return _anchors(*_word_sums(texts), words, k)


def _places(sums: np.ndarray, stops: np.ndarray, length: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, within, place), some at a time: which strings of `length` symbols from `first` on lie within one text, and where each of these has its anchor."""
    n = len(sums) - 1
    if n < length:
        return
    prints = _mix((sums[k:] - sums[:-k]) * _power(_P_INVERSE, n)[: n - k + 1] + np.uint64(k))
    bound = np.repeat(stops, np.diff(stops, prepend=0))
    wide, step = length - k + 1, (1 << 24) - length
    for first in range(0, n - length + 1, step):
        some = prints[first : first + step + wide - 1]
        # The smallest of every `wide`, the leftmost if equal in their upper bits: by doubling.
        low = (some & ~np.uint64((1 << 24) - 1)) | np.arange(len(some), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[span:], low[:-span])
            span *= 2
        if wide > span:
            low = np.minimum(low[wide - span :], low[: -(wide - span)])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64) + first
        within = np.arange(first + length, first + length + len(place)) <= bound[first : first + len(place)]
        yield first, within, place[within]


def _anchors(sums: np.ndarray, stops: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(sums) - 1
    found = [np.zeros(0, np.int64)]
    for _, _, place in _places(sums, stops, length, k):
        found.append(place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place)
    found = np.unique(np.concatenate(found))
    text = np.searchsorted(stops, found, "right")
    begin, end = np.concatenate(([0], stops))[text], stops[text]
    lo, hi = np.maximum(found - (length - k), begin), np.minimum(found + length, end)
    context = _mix(_prints(sums, lo, hi) ^ (found - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    half = (length - k) // 2
    left, right = found - half >= begin, found + length - half <= end
    before = np.where(left, _prints(sums, np.maximum(found - half, 0), found + k) >> np.uint64(32) | np.uint64(1), np.uint64(0))
    behind = np.where(right, _prints(sums, found, np.minimum(found + length - half, n)) >> np.uint64(32) | np.uint64(1), np.uint64(0))
    return text, found - begin, _prints(sums, found, found + k), context, before << np.uint64(32) | behind


def _context(raw: bytes, at: int, length: int, k: int) -> tuple[int, bytes]:
    """Bytes that strings with this anchor can reach, and how many of them lie before it."""
    lo = max(0, at - (length - k))
    return at - lo, raw[lo : at + length]


def _common_prefixes(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows in the order of their bytes inside each group, and how many bytes each has in
    common with the next one; -1 where a group ends. Rows are padded with zeros to equal width."""
    order = np.lexsort((sizes, rows.view(f"S{rows.shape[1]}").ravel(), groups))
    x, n, g = rows[order], sizes[order], groups[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common = np.minimum(common, np.minimum(n[1:], n[:-1]))
    return order, np.where(g[1:] == g[:-1], common, -1)


def longest_factors(groups: np.ndarray, befores: np.ndarray, pieces: list[bytes], length: int = LENGTH, k: int = K) -> np.ndarray:
    """For each l from 0 to length - k and each context: the longest match of the suffix that starts l bytes before
    the anchor with a suffix l bytes before the anchor of another context of its group; 0 where the context has none there.

    Contexts of a group are aligned at the anchor. Their suffix order at distance l is that of the l bytes before
    the anchor and then of the rest, so the longest match is with the previous or the next one that has
    the same l bytes, and its length l and the least common prefix of all those between.
    """
    m, reach = len(pieces), length - k
    right, left = np.zeros((m, length), np.uint8), np.zeros((m, reach), np.uint8)
    sizes = np.array([len(p) for p in pieces]) - befores
    for i, (piece, before) in enumerate(zip(pieces, befores.tolist(), strict=True)):
        raw = np.frombuffer(piece, np.uint8)
        right[i, : len(raw) - before] = raw[before:]
        left[i, :before] = raw[:before][::-1]
    order, common = _common_prefixes(right, sizes, groups)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    # least[j][p]: the least of common[p : p + 2**j]
    least = [common]
    while 2 << (len(least) - 1) <= len(common):
        step = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-step], least[-1][step:]))
    order, common = _common_prefixes(left, befores, groups)
    depths = np.arange(reach + 1)
    kind = np.zeros((reach + 1, m), np.int64)
    kind[:, order[1:]] = np.cumsum(common[None] < depths[:, None], axis=1)  # equal: the same l bytes before the anchor
    by = np.argsort(kind * m + place, axis=1)
    kinds = np.take_along_axis(kind, by, 1)
    at = place[by]
    a, z = at[:, :-1], at[:, 1:]
    there = befores[by] >= depths[:, None]
    same = (kinds[:, 1:] == kinds[:, :-1]) & there[:, 1:] & there[:, :-1]
    match = np.zeros(a.shape, np.int64)
    level = np.frexp(np.maximum(z - a, 1))[1] - 1
    for j in np.unique(level[same]).tolist():
        here = same & (level == j)
        match[here] = np.minimum(least[j][a[here]], least[j][z[here] - (1 << j)])
    match = np.where(same, match + depths[:, None], 0)
    out = np.zeros((reach + 1, m), np.int64)
    edge = np.zeros((reach + 1, 1), np.int64)
    np.put_along_axis(out, by, np.maximum(np.concatenate((edge, match), 1), np.concatenate((match, edge), 1)), 1)
    return out


def repeated_around(groups: np.ndarray, befores: np.ndarray, pieces: list[bytes], lows: np.ndarray, highs: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last): runs of distances l before the anchor, lows <= l < highs of the context, at which
    a string of `length` bytes starts that recurs in another context of the group."""
    hit = longest_factors(groups, befores, pieces, length, k).T >= length
    l = np.arange(hit.shape[1])
    hit &= (l >= lows[:, None]) & (l < highs[:, None])
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    context, first = np.nonzero(edges == 1)
    _, past = np.nonzero(edges == -1)
    return context, first, past - 1


def _union(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open spans; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _named(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("row"), text.alias("text"), *more)


def _among(rows: DataFrame, column: str, name: str):
    """Splits rows by a filter of the 64-bit hashes in rows' column: (those whose `name` may be among them, those whose is not)."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(rows, column))

    def having(wanted: bool):
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(among(bits.value, batch.column(name).to_numpy()) == wanted))

        def split(df: DataFrame) -> DataFrame:
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            return df.mapInArrow(lean(some), fields)

        return split

    return having(True), having(False)


def _anchored(texts: DataFrame, find: Callable[[list[bytes]], tuple], copies: int) -> DataFrame:
    """(row, at, mark, context, sides): the anchors that `find` tells of the texts (row, text); of copies in a task the first ones' alone."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            rows, some, size = [], [], 0

            def told():
                text, at, marks, contexts, sides = find(some)
                columns = (np.array(rows, np.int64)[text], at.astype(np.int32), marks.view(np.int64), contexts.view(np.int64), sides.view(np.int64))
                return pa.record_batch([pa.array(c) for c in columns], names=["row", "at", "mark", "context", "sides"])

            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                seen[row] = seen.get(row, 0) + 1
                if seen[row] > copies:
                    continue
                rows.append(row)
                some.append(text.as_py() or b"")
                size += len(some[-1])
                if size > 1 << 17:
                    yield told()
                    rows, some, size = [], [], 0
            if rows:
                yield told()

    return texts.mapInArrow(lean(anchored), "row long, at int, mark long, context long, sides long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST) -> DataFrame:
    """(row, spans) of each text that holds bytes of repeated strings; docs has row, a name for the text, and text.

    spans are [start, stop) pairs of byte positions, in no order; they may overlap.
    """
    spark = docs.sparkSession
    texts = docs.select("row", "text")

    found, drop = written(_anchored(texts, lambda some: anchors(some, length, k), 2))  # two copies say as much as more
    # Most anchors occur once: they leave before anything else is dealt out.
    several = found.groupBy("mark").agg(F.count("*").alias("all"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("all > 1").select("mark", (F.col("lo") < F.col("hi")).alias("mixed"))
    several, drop_several = written(several)
    freed(spark)
    again, drop_again = written(_among(several, "mark", "mark")[0](found))
    drop()
    kinds = again.groupBy("mark", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "sides")).alias("one"))
    # state 1: the whole context repeats. 2: to be compared. 3: as 1, and compared for the others.
    kinds = kinds.join(several, "mark").select("mark", "context", "one", F.when((F.col("n") == 1) & F.col("mixed"), 2).when(F.col("mixed"), 3).otherwise(1).alias("state"))
    kinds, drop_kinds = written(kinds)
    here = again.join(kinds.where("state <> 2").select("mark", "context"), ["mark", "context"]).select("row", "at", F.lit(1).alias("state"), F.lit(None).cast("long").alias("mark"))
    # A string that two contexts share has all bytes of one side or of the other in common.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("one.sides", 32).alias("print")), F.struct(F.lit(1).alias("side"), F.col("one.sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("print")))
    reach = kinds.where("state <> 1").select("one.row", "one.at", "mark", F.explode(sides).alias("s")).where("s.print <> 0").select("row", "at", "mark", "s.side", "s.print")
    shared = reach.groupBy("mark", "side", "print").agg(F.count("*").alias("n")).where("n > 1").select("mark", "side", "print")
    compared = reach.join(shared, ["mark", "side", "print"]).select("row", "at", F.lit(2).alias("state"), "mark").distinct()
    work, drop_work = written(here.unionByName(compared).groupBy("row").agg(F.collect_set(F.struct("at", "state", "mark")).alias("work")))
    for gone in (drop_several, drop_again, drop_kinds):
        gone()
    freed(spark)
    need = work.select("row", F.filter("work", lambda w: w.state == 2).alias("work")).where(F.size("work") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row, text, work in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw = text.as_py()
                for w in work.as_py():
                    before, piece = _context(raw, w["at"], length, k)
                    out.append((w["mark"], row, w["at"], before, piece))
                    size += len(piece)
                    if size > 1 << 20:
                        yield _cut_rows(out)
                        out, size = [], 0
            if out:
                yield _cut_rows(out)

    may, _ = _among(need, "row", "row")
    held = may(texts).groupBy("row").agg(F.first("text").alias("text"))
    contexts = held.join(need, "row").select("row", "text", "work").mapInArrow(lean(cut), "mark long, row long, at long, before int, piece binary")
    # What is in groups of equal anchors: all distances before it, from 0 to length - k.
    todo, drop_todo = written(contexts.select(F.col("mark").alias("key"), "row", "at", "before", "piece", F.lit(0).alias("lo"), F.lit(length - k + 1).alias("hi")))
    sizes, drop_sizes = written(todo.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    placed = todo.join(sizes, "key")
    spans, drops = [], [drop_todo, drop_sizes]
    freed(spark)
    while True:
        near = placed.where(F.col("n") <= most).drop("n")
        spans.append(near.repartition("key").sortWithinPartitions("key").mapInArrow(lean(lambda b: _compared(b, length, k)), "row long, a long, b long"))
        if sizes.where(F.col("n") > most).isEmpty():
            break
        # Too many contexts for a task: they are parted by ranges of distances and the bytes that all strings of a range hold.
        large = placed.where(F.col("n") > most).drop("n")
        todo, drop_todo = written(large.mapInArrow(lean(lambda b: _halved(b, length)), "key long, row long, at long, before int, piece binary, lo int, hi int, whole long"))
        # Where a part's strings reach the same bytes, all of them repeat, and one context stands for its equals from there on.
        classes, drop_classes = written(todo.groupBy("key", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("row", "at")).alias("one")))
        a = F.col("at") - F.least(F.col("hi") - 1, F.col("before"))
        b = F.col("at") + F.least(F.lit(length) - F.col("lo"), F.length("piece") - F.col("before"))
        reached = todo.select("key", "whole", "row", a.cast("long").alias("a"), b.cast("long").alias("b"))
        spans.append(reached.join(classes.where("copies > 1").select("key", "whole"), ["key", "whole"]).select("row", "a", "b"))
        sizes, drop_sizes = written(classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        ones = classes.join(sizes, "key").select("key", "one.row", "one.at", "n")
        placed = todo.drop("whole").join(ones, ["key", "row", "at"]).select("key", "row", "at", "before", "piece", "lo", "hi", "n")
        drops += [drop_todo, drop_classes, drop_sizes]
    whole = work.select("row", F.explode(F.filter("work", lambda w: w.state == 1)).alias("w")).select("row", F.col("w.at").alias("at"))
    whole = whole.select("row", F.greatest(F.col("at") - (length - k), F.lit(0)).cast("long").alias("a"), (F.col("at") + length).cast("long").alias("b"))
    out, _ = written(reduce(DataFrame.unionByName, [whole, *spans]).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    for gone in [drop_work, *drops]:
        gone()
    freed(spark)
    return out


def shared_passages(docs: DataFrame, words: int = WORDS, k: int = WORDS_K) -> DataFrame:
    """(row, passages) of each text that shares a passage of `words` words with another one or has copies; docs has row, a name for the text, and text.

    passages are (at, starts): bit l of starts tells that the passage that starts l words before word `at` is
    shared, if the text has one there. at -1 says that the whole text has copies.
    """
    spark = docs.sparkSession
    texts = docs.select("row", "text")
    copied = texts.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row", F.lit(-1).alias("at"), F.lit(-1).cast("long").alias("starts"))
    found, drop = written(_anchored(texts, lambda some: word_anchors(some, words, k), 1))
    several = found.groupBy("mark").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("first < last").select("mark", (F.col("lo") < F.col("hi")).alias("mixed"))
    several, drop_several = written(several)
    freed(spark)
    again, drop_again = written(_among(several, "mark", "mark")[0](found))
    drop()
    # A context tells its anchor. One that two texts hold is shared wholly.
    kinds = again.groupBy("mark", "context").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.min(F.struct("row", "at", "sides")).alias("one"))
    kinds, drop_kinds = written(kinds.join(several, "mark"))
    whole = kinds.where("first < last").select("context", F.lit(-1).cast("long").alias("starts"))
    # A passage that two contexts share has all words of one side or of the other in common.
    sides = F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("one.sides", 32).alias("print")), F.struct(F.lit(1).alias("side"), F.col("one.sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("print")))
    reach = kinds.where("mixed").select("mark", "context", "first", "last", "one.row", "one.at", F.explode(sides).alias("s")).where("s.print <> 0").select("mark", "context", "first", "last", "row", "at", "s.side", "s.print")
    met = reach.groupBy("mark", "side", "print").agg(F.count("*").alias("n"), F.min("first").alias("lo"), F.max("last").alias("hi")).where("n > 1 and lo < hi").select("mark", "side", "print")
    need = reach.join(met, ["mark", "side", "print"]).groupBy("row").agg(F.collect_set(F.struct("at", "context", "first", "last")).alias("work"))
    need, drop_need = written(need)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, work in zip(batch.column("text").cast(pa.binary()), batch.column("work"), strict=True):
                at, context, low, high = (work.values.field(c).to_numpy() for c in ("at", "context", "first", "last"))
                order = np.argsort(at)
                sums, stops = _word_sums([text.as_py()])
                each = list(_places(sums, stops, words, k))
                if not each:
                    continue
                start = np.concatenate([first + np.flatnonzero(within) for first, within, _ in each])
                place = np.concatenate([place for _, _, place in each])
                one = order[np.minimum(np.searchsorted(at, place, sorter=order), len(at) - 1)]
                here = at[one] == place
                start, place, one = start[here], place[here], one[here]
                columns = context[one], np.int64(1) << (place - start), _prints(sums, start, start + words).view(np.int64), low[one], high[one]
                yield pa.record_batch([pa.array(c) for c in columns], names=["context", "start", "passage", "first", "last"])

    may, _ = _among(need, "row", "row")
    held = may(texts).groupBy("row").agg(F.first("text").alias("text"))
    passages, drop_passages = written(held.join(need, "row").select("text", "work").mapInArrow(lean(cut), "context long, start long, passage long, first long, last long"))
    common, drop_common = written(passages.groupBy("passage").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo < hi").select("passage"))
    freed(spark)
    hits = _among(common, "passage", "passage")[0](passages).join(common, "passage").select("context", F.col("start").alias("starts"))
    hits, drop_hits = written(whole.unionByName(hits).groupBy("context").agg(F.bit_or("starts").alias("starts")))
    places = again.select("row", "at", "context").join(hits, "context").select("row", "at", "starts").unionByName(copied)
    out, _ = written(places.groupBy("row").agg(F.collect_set(F.struct("at", "starts")).alias("passages")))
    for gone in (drop_several, drop_again, drop_kinds, drop_need, drop_passages, drop_common, drop_hits):
        gone()
    freed(spark)
    return out


def _n_shared(raw: bytes, at: np.ndarray, starts: np.ndarray, words: int, k: int) -> int:
    """How many words of the text lie in its shared passages."""
    n = len(raw.split())
    if n < words:
        return 0
    if (at < 0).any():
        return n
    l = np.arange(words - k + 1)
    start = (at[:, None] - l)[(starts[:, None] >> l) & 1 == 1]
    start = np.unique(start[(start >= 0) & (start <= n - words)])
    return int(np.minimum(np.diff(start), words).sum()) + words if len(start) else 0


def _compared(batches: Iterator[pa.RecordBatch], length: int, k: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """(row, a, b): spans of repeated strings, of whole groups (key, row, at, before, piece, lo, hi), some at a time."""

    def told(tables: list[pa.Table]) -> pa.RecordBatch:
        key, row, at, before, lo, hi = (np.concatenate([t.column(c).to_numpy() for t in tables]).astype(np.int64) for c in ("key", "row", "at", "before", "lo", "hi"))
        pieces = [x.as_py() for t in tables for x in t.column("piece")]
        c, first, last = repeated_around(key, before, pieces, lo, hi, length, k)
        return pa.record_batch([pa.array(x) for x in (row[c], at[c] - last, at[c] - first + length)], names=["row", "a", "b"])

    held: list[pa.Table] = []
    for group in sorted_groups(batches):
        if held and sum(t.num_rows for t in held) + group.num_rows > rows:
            yield told(held)
            held = []
        held.append(group)
    if held:
        yield told(held)


def _halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each context once for either half of its distances lo <= l < hi, with a key of the bytes that the strings at all
    of those have in common, and a fingerprint of those that they reach together."""
    import xxhash

    for batch in batches:
        out = []
        for key, row, at, before, piece, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle, hi)):
                core = before - a, before + length - b + 1
                if a < b and core[0] >= 0 and core[1] <= len(piece):
                    name = xxhash.xxh3_64_intdigest(piece[core[0] : core[1]], seed=xxhash.xxh3_64_intdigest(f"{key} {a}".encode())) - (1 << 63)
                    reach = max(0, before - b + 1), before + length - a
                    whole = xxhash.xxh3_64_intdigest(piece[reach[0] : reach[1]], seed=before - reach[0]) - (1 << 63)
                    out.append((name, row, at, before, piece, a, b, whole))
        if out:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "row", "at", "before", "piece", "lo", "hi", "whole"])


def _cut_rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["mark", "row", "lo", "before", "piece"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST, words: int = WORDS, words_k: int = WORDS_K) -> DataFrame:
    """Every document without its repeated bytes: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256, text (kept as text),
    n_shared_words.

    Null texts are empty; texts under `length` bytes lose nothing. Repeated rows are copies
    as any others. n_shared_words are the words of the document in passages of at least `words` words that another
    document holds too, whatever white space parts them; they stay, if no string of `length` bytes covers them. In `text` a character that a cut parts is U+FFFD. Rows may share or lack a doc_id. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = _named(docs, F.col("doc_id").cast("long").alias("doc_id"))
    spans = repeated_spans(own, length, k, most)
    shared = shared_passages(own, words, words_k)
    may, clean = _among(spans.select("row").union(shared.select("row")), "row", "row")
    # A text without repeats passes by; only the others meet their spans.
    told = may(own).join(spans, "row", "left").join(shared, "row", "left").select("doc_id", "text", "spans", "passages")
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((spans, "spans"), (shared, "passages"))]
    told = told.unionByName(clean(own.select("row", "text", "doc_id")).select("doc_id", "text", *none))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            rows = []
            for doc_id, text, spans, passages in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                raw = text.as_py()
                n = len(raw)
                runs: list[tuple[int, int]] = []
                if spans.is_valid:
                    each = spans.values
                    a, b = each.field("a").to_numpy(), each.field("b").to_numpy()
                    runs = _union(a, np.minimum(b, n))
                parts, at = [], 0
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                rest = b"".join([*parts, raw[at:]])
                n_shared = _n_shared(raw, *(passages.values.field(c).to_numpy() for c in ("at", "starts")), words, words_k) if passages.is_valid else 0
                rows.append((doc_id, n, n - len(rest), len(runs), rest, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"), n_shared))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.binary(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "text", "n_shared_words"])

    return told.mapInArrow(lean(kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, text string, n_shared_words long")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
