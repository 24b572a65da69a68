"""Packing: documents' tokens into sequences of a fixed window with hardly any padding.

A document is cut into whole windows, one piece of a multiple of window/64 and one tail
shorter than that. The histogram of the pieces' lengths, which is bounded, is all that the
plan needs: every combination of up to three multiples that fills the window exactly is a
column, non-negative least squares gives how often to use each, the counts are rounded
down to what there is, and the rest, tails included, is packed greedily, longest first,
each pattern as often as the histogram allows. Pieces find their places by their rank
among those of the same length. Input whose order means something (the pipeline's schedule)
is packed in ranges of consecutive pieces instead, and sequences are numbered in its order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, stable, table, tokenizer_path
from .ngram_join import _LOWER, _P, _P_INVERSE, _Q, _TABLE, _WHITE, _mix, _power

WINDOW, END, SHARES = 4096, 2, 64
#: What is encoded with its whole text: white space of several bytes, controls that are none, special tokens.
_ODD = re.compile("<[|]|[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MEMO = 4_000_000  # words, about 32 bytes each
REACH = 256  # windows of a range that is packed by itself: about one period of the example schedule


class Words:
    """Ids of words met before, by a 64-bit hash of the word: sorted hashes, and where their ids lie."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word). A mark after an ASCII letter is parted from it by the tokenizer too."""
        stems = [w[:-1] if len(w) > 1 and w[-1] in b".," and chr(w[-2]).isascii() and chr(w[-2]).isalpha() else w for w in words]
        own, back = {}, []
        for s in stems:
            back.append(own.setdefault(s, len(own)))
        found = self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in own] + [".", ","], add_special_tokens=False)
        found = [e.ids for e in found]
        marks = {46: found[-2], 44: found[-1]}
        each = [found[k] if len(s) == len(w) else found[k] + marks[w[-1]] for k, s, w in zip(back, stems, words, strict=True)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def texts(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        joined = _LOWER[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
        white = _WHITE[joined]
        starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
        stops = np.flatnonzero(white & np.concatenate(([False], ~white[:-1])))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(raws), np.int64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[joined] * _power(_P, len(joined)))))
        word = _mix((sums[stops] - sums[starts]) * _power(_P_INVERSE, len(joined))[starts] + (stops - starts).astype(np.uint64) * _Q)
        unique, where, back = np.unique(word, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        first, size = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        first[known], size[known] = self.first[at[known]], self.size[at[known]]
        ids = self.ids
        if not known.all():
            flat = joined.tobytes()
            new = np.flatnonzero(~known)
            more, many = self._encode([flat[a:b] for a, b in zip(starts[where[new]].tolist(), stops[where[new]].tolist(), strict=True)])
            size[new] = many
            first[new] = len(ids) + np.cumsum(many) - many
            ids = np.concatenate((ids, more))
            if len(self.hashes) + len(new) <= _MEMO:
                self.hashes = np.insert(self.hashes, at[new], unique[new])
                self.first = np.insert(self.first, at[new], first[new])
                self.size = np.insert(self.size, at[new], many)
                self.ids = ids
        many = size[back]
        ends = np.cumsum(many)
        place = np.repeat(first[back] - ends + many, many) + np.arange(int(ends[-1]))
        last = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))
        total = np.concatenate(([0], ends))[last]
        return ids[place], np.diff(np.concatenate(([0], total)))


_loaded: dict[str, Words] = {}


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of whole texts as little-endian 32-bit numbers.

    The tokenizer drops white space, puts letters in lower case and joins nothing across
    white space, so each word is encoded on its own, once.
    """
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Words(path)
    words = _loaded[path]
    out: list[bytes] = []
    at = 0
    while at < len(texts):
        raws, size, odd = [], 0, {}
        while at + len(raws) < len(texts) and (size < 1 << 20 or not raws):
            t = texts[at + len(raws)]
            if t and _ODD.search(t):
                odd[len(raws)] = np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                t = None
            raws.append((t or "").encode("utf-8", "replace"))
            size += len(raws[-1])
        ids, many = words.texts(raws)
        ends = np.cumsum(many).tolist()
        flat = ids.astype("<u4", copy=False).tobytes()
        out += [odd.get(k) or flat[4 * (e - n) : 4 * e] for k, (e, n) in enumerate(zip(ends, many.tolist(), strict=True))]
        at += len(raws)
    return out


def cuts(tokens: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens."""
    share = window // SHARES
    out = [(s, window) for s in range(0, tokens - window + 1, window)]
    at = len(out) * window
    main = (tokens - at) // share * share
    return out + [(s, n) for s, n in ((at, main), (at + main, tokens - at - main)) if n]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, place: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece; a null or empty text has one token, `end`.

    With `place`, the columns _part (string) and _row (long) of docs too.
    """
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            rows = []
            names, texts, *own = (c.to_pylist() for c in batch.columns)
            for doc_id, ids, *at in zip(names, token_bytes(texts, path), *own, strict=True):
                ids += last
                n = len(ids) // 4
                rows += [(doc_id, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n, *at) for s, k in cuts(n, window)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (5 + len(own))
            kinds = [*[pa.int64()] * 5, *[pa.string(), pa.int64()][: len(own)]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_row"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *["_part", "_row"] * place)
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", _part string, _row long" * place)


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by coordinate descent."""
    gram, target, x = a.T @ a, a.T @ b, np.zeros(a.shape[1])
    for _ in range(sweeps):
        was = x.copy()
        for j in range(len(x)):
            x[j] = max(0.0, x[j] + (target[j] - gram[j] @ x) / gram[j, j])
        if np.abs(x - was).max(initial=0) < 1e-3:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[({length: pieces}, how many sequences)]: together they hold the histogram exactly."""
    left = {n: k for n, k in histogram.items() if k}
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left.get(n, 0) // k for n, k in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= times * k

    share = window // SHARES
    if window in left:
        take({window: 1}, left[window])
    # Columns: the combinations of up to three multiples that fill the window exactly.
    sets = [(a, SHARES - a) for a in range(1, SHARES // 2 + 1)]
    sets += [(a, b, SHARES - a - b) for a in range(1, SHARES) for b in range(a, SHARES) if SHARES - a - b >= b]
    sets = [s for s in sets if all(left.get(n * share, 0) for n in s)]
    if sets:
        a = np.zeros((SHARES + 1, len(sets)))
        for j, s in enumerate(sets):
            for n in s:
                a[n, j] += 1
        h = np.array([left.get(n * share, 0) for n in range(SHARES + 1)], float)
        x = nnls(a, h)
        for j in np.argsort(-x, kind="stable"):
            take({n * share: int(a[n, j]) for n in set(sets[j])}, int(x[j]))
    # The rest: longest first, then the longest that still fits; a pattern as often as there is of it.
    while any(left.values()):
        pattern, room = {}, window
        for n in sorted((n for n, k in left.items() if k), reverse=True):
            if k := min(left[n], room // n):
                pattern[n] = k
                room -= n * k
        take(pattern, max(left.values()))
    return out


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its tokens and `end`; a null or empty text is `end` alone. Rows that
    repeat, or share or lack a doc_id, are packed each. Columns other than doc_id and text
    are not read.
    """
    cut = stable(pieces(docs, path or tokenizer_path(), window, end))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, base, used = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, window):
        at = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rows.append((n, used[n], used[n] + times * k, base, k, at))
            used[n] += times * k
            at += n * k
        base += times
    # At most a few rows for each of the 2 * SHARES lengths, whatever the input.
    places = cut.sparkSession.createDataFrame(rows, "length long, lo long, hi long, base long, k long, at long")
    ranked = running(cut.withColumn("_one", F.lit(1)), ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "_one", "_rank")
    place = ranked.join(F.broadcast(places), "length").where("_rank >= lo and _rank < hi")
    nth = F.col("_rank") - F.col("lo")
    return place.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(nth / F.col("k"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("k")) * F.col("length")).cast("long").alias("offset"))


def placed(docs: DataFrame) -> DataFrame:
    """docs with (_part, _row), by which its rows have their order: files by name and rows in
    them where docs is read from Parquet, else partitions and rows in them."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        # Only a bare scan: rows of a plan over one may have been put in another order since.
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.row_index").alias("_row"))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    return numbered.withColumn("_part", F.lpad(F.shiftright("_row", 33).cast("string"), 10, "0"))


def sequences(length: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces in their order: the plan's sequences, each pattern spread
    over the whole order, equal lengths dealt in order, numbered by the mean place of their tokens."""
    sizes, counts = np.unique(length, return_counts=True)
    patterns = plan(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), window)
    dealt = [p for _, p in sorted(((i + 0.5) / times, p) for p, (_, times) in enumerate(patterns) for i in range(times))]
    found = np.empty(len(length), np.int64)
    for n in sizes.tolist():
        each = np.array([pattern.get(n, 0) for pattern, _ in patterns])[dealt]
        found[length == n] = np.repeat(np.arange(len(dealt)), each)
    middle = np.cumsum(length) - length / 2
    number = np.empty(len(dealt), np.int64)
    number[np.argsort(np.bincount(found, middle * length) / np.bincount(found, length), kind="stable")] = np.arange(len(dealt))
    found = number[found]
    by = np.argsort(found, kind="stable")
    own, sums = length[by], np.bincount(found, length).astype(np.int64)
    offset = np.empty(len(length), np.int64)
    offset[by] = np.cumsum(own) - own - (np.cumsum(sums) - sums)[found[by]]
    return found, offset


def pack_in_order(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, reach: int = REACH) -> DataFrame:
    """The columns of pack; sequences follow the order of the rows of docs.

    Every `reach` windows of consecutive tokens are a range, packed by itself, so any prefix of
    sequence_id holds a prefix of the input to within one range. A range costs at most
    the padding of its last sequences. No range, whatever the input, is more than reach * window rows.
    """
    cut = stable(pieces(placed(docs), path or tokenizer_path(), window, end, True)).withColumn("_slice", F.shiftright("_row", 16))
    # One row for each part and 65,536 of its rows.
    slices = cut.groupBy("_part", "_slice").agg(F.sum("length").alias("_n"))
    before = slices.withColumn("_before", F.sum("_n").over(Window.orderBy("_part", "_slice")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_part", "_slice").orderBy("_row", "start")
    at = cut.withColumn("_at", F.sum("length").over(inside) - F.col("length")).join(before, ["_part", "_slice"])
    at = at.withColumn("_at", F.col("_at") + F.col("_before")).withColumn("_range", F.floor(F.col("_at") / F.lit(reach * window)).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["_at"].to_numpy())))
        found = sequences(rows["length"].to_numpy(), window)
        return pa.table([*(rows[c] for c in [*columns, "_range"]), *(pa.array(x) for x in found)], names=[*columns, "_range", "_sequence", "offset"])

    packed = stable(at.select(*columns, "_at", "_range").groupBy("_range").applyInArrow(fill, ", ".join(f"{c} long" for c in [*columns, "_range", "_sequence", "offset"])))
    # One row for each range.
    many = packed.groupBy("_range").agg((F.max("_sequence") + 1).alias("_n"))
    base = many.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_base"))
    return packed.join(F.broadcast(base), "_range").select(*columns, (F.col("_base") + F.col("_sequence")).alias("sequence_id"), "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
