"""Suffix-array dedup: repeated strings of a minimum length, by threshold-bounded interval expansion on a BWT."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import collect_garbage, delete_path, join_counted, release_memory, shared_folder, shuffle_partitions, table, tidy, undone_by, written

#: Bytes of a string whose repeats are removed.
MINIMUM = 100
#: Bytes of the grams that are hashed; a window's anchor is its gram of least hash.
GRAM = 24
#: Segments are cut where a gram's hash has so many zero bits at its end, MINIMUM bytes or more apart.
CUT_BITS = 8
#: Bytes that are looked at in one step, of one text or of short ones that follow each other: its arrays stay in the cache.
BLOCK = 1 << 16
#: Bytes of context that one suffix array is meant to hold, and contexts of one anchor that go into one at most.
SHARD_BYTES, MOST_CONTEXTS = 1 << 20, 1 << 14
#: A window has so many bytes beside its anchor, on one side or the other, at least.
BESIDE = (MINIMUM - GRAM) // 2
#: Bits of an item's number within its document.
ORD_BITS = 24

MULT = 0x9E3779B97F4A7C15
FIRST_KEY_BITS = 62 - ORD_BITS


def gram_hashes(raw: bytes | np.ndarray, begin: int, end: int) -> np.ndarray:
    """64-bit hashes of the grams that begin at begin..end-1 (shorter at the end of the text: as many as there are)."""
    part = np.frombuffer(raw, np.uint8, min(end + GRAM - 1, len(raw)) - begin, begin)
    h, n, power = part.astype(np.uint64) + np.uint64(1), 1, MULT
    done, done_n = None, 0
    while True:  # hashes of 1, 2, 4, ... bytes, put together as the gram's length has its bits
        if GRAM & n:
            done, done_n = (h, n) if done is None else (done[: len(h) - done_n] * np.uint64(pow(MULT, n, 1 << 64)) + h[done_n : done_n + len(done)][: len(h) - done_n], done_n + n)
        if 2 * n > GRAM:
            break
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power % (1 << 64)
    done = done[: max(0, len(part) - GRAM + 1)]
    done = (done ^ (done >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return done ^ (done >> np.uint64(29))


class Items(NamedTuple):
    """Items of texts that lie one after the other: the text's number, the item's number within it, start and end."""

    text: np.ndarray
    nth: np.ndarray
    start: np.ndarray
    end: np.ndarray


def items_within(raw: np.ndarray, bounds: np.ndarray) -> Items:
    """The items of the texts raw[bounds[k] : bounds[k + 1]], in order: spans such that every window of MINIMUM bytes of a
    text lies inside one.

    They are the segments between content-defined cuts, and a bridge around each cut with the windows that cross it.
    """
    mask = np.uint64((1 << CUT_BITS) - 1)
    found = [np.flatnonzero(gram_hashes(raw, at, min(at + BLOCK, len(raw))) & mask == 0) + at for at in range(0, len(raw) - GRAM + 1, BLOCK)]
    places = np.concatenate([np.zeros(0, np.int64), *found])
    text = np.searchsorted(bounds, places, "right") - 1
    places = places[(places - bounds[text] >= MINIMUM) & (bounds[text + 1] - places >= MINIMUM)]
    cuts, last = [], -MINIMUM  # a text's first cut is MINIMUM bytes or more from the last one of the text before
    for c in places.tolist():
        if c - last >= MINIMUM:
            cuts.append(c)
            last = c
    long = np.flatnonzero(np.diff(bounds) >= MINIMUM)
    start = np.sort(np.concatenate((bounds[long], np.array(cuts, np.int64))))
    text = np.searchsorted(bounds, start, "right") - 1
    is_cut = start != bounds[text]
    end = np.append(start[1:], 0)
    lasts = np.append(text[1:] != text[:-1], True)[: len(text)]
    end[lasts] = bounds[text[lasts] + 1]
    at = np.cumsum(1 + is_cut) - 1  # a segment after a cut comes behind its bridge
    n = at[-1] + 1 if len(at) else 0
    out = Items(*(np.empty(n, np.int64) for _ in range(4)))
    out.text[at], out.start[at], out.end[at] = text, start, end
    bridge = at[is_cut] - 1
    out.text[bridge], out.start[bridge], out.end[bridge] = text[is_cut], start[is_cut] - MINIMUM + 1, start[is_cut] + MINIMUM - 1
    out.nth[:] = np.arange(n) - np.repeat(at[~is_cut], np.diff(np.append(at[~is_cut], n)))
    return out


def items(raw: bytes) -> list[tuple[int, int]]:
    """Spans (start, end) of one text's items."""
    found = items_within(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return list(zip(found.start.tolist(), found.end.tolist(), strict=True))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and the bounds between them."""
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, raw = column.buffers()
    return np.frombuffer(raw or b"", np.uint8), np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of a column of lists (null: empty): the row of each value, the values, and the bounds between rows."""
    rows = pc.list_parent_indices(column).to_numpy()
    return rows, column.flatten(), np.searchsorted(rows, np.arange(len(column) + 1))


def _steps(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about BLOCK bytes together, or are one longer text."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
        yield i, j
        i = j


def _item_digests(batches):
    for batch in batches:
        raw, bounds = _texts(batch.column(1))
        keys, packed, digests = batch.column(0).to_numpy(), [], []
        for i, j in _steps(bounds):
            part = raw[bounds[i] : bounds[j]]
            found, whole = items_within(part, bounds[i : j + 1] - bounds[i]), part.tobytes()
            within(0, int(found.nth.max(initial=0)))  # raises where there are too many
            packed.append(keys[i:j][found.text] << ORD_BITS | found.nth)
            digests += [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.concatenate([np.zeros(0, np.int64), *packed]))], names=["h1", "h2", "place"])
    release_memory()


def open_within(raw: np.ndarray, bounds: np.ndarray, texts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where windows begin that aren't known to be repeats: those in no item but items that are the first of their kind
    (item firsts[k] of text texts[k])."""
    is_open = np.zeros(max(0, len(raw) - MINIMUM + 1), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        is_open[a : max(a, b - MINIMUM + 1)] = True
    found = items_within(raw, bounds)
    is_first = np.zeros(len(found.text), bool)
    is_first[np.searchsorted(found.text, texts) + firsts] = True
    for a, b in zip(found.start[~is_first].tolist(), found.end[~is_first].tolist(), strict=True):
        is_open[a : b - MINIMUM + 1] = False
    return is_open


def open_windows(raw: bytes, firsts: list[int]) -> np.ndarray:
    """The same of one text, for each of its windows; firsts may hold items that it doesn't have."""
    n = len(items(raw))
    own = np.array([k for k in firsts if k < n], np.int64)
    return open_within(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.zeros(len(own), np.int64), own)


def runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def anchored(raw: bytes | np.ndarray, is_open: np.ndarray) -> np.ndarray:
    """Rows (hash of the anchor, first window, form), one for each stretch of open windows that share an anchor. The form tells
    how far from the first window the last one and the anchor are: 128 * one + the other.

    The anchor depends on the window's bytes alone: equal windows have anchors of equal hash.
    """
    out, reach, bits = [np.zeros((0, 3), np.int64)], MINIMUM - GRAM + 1, np.uint64((1 << 21) - 1)
    for at in range(0, len(is_open), BLOCK):
        stop = min(at + BLOCK, len(is_open))
        if not is_open[at:stop].any():
            continue
        h = gram_hashes(raw, at, stop + reach - 1)
        low, n = (h & ~bits) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * n <= reach:  # least hash, then leftmost, of 1, 2, 4, ... grams
            low, n = np.minimum(low[:-n], low[n:]), 2 * n
        low = np.minimum(low[: stop - at], low[reach - n : reach - n + stop - at])
        anchor = (low & bits).astype(np.int64)
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (is_open[at + 1 : stop] != is_open[at : stop - 1])))
        begins = np.flatnonzero(new)
        ends = np.concatenate((begins[1:], [stop - at])) - 1
        keep = is_open[at + begins]
        begins, ends = begins[keep], ends[keep]
        form = (ends - begins) * 128 + anchor[begins] - begins
        out.append(np.column_stack((h[anchor[begins]].view(np.int64), begins + at, form)))
    return np.concatenate(out)


def _anchors(batches):
    for batch in batches:
        raw, bounds = _texts(batch.column(1))
        rows, firsts, at = _listed(batch.column(2))
        keys, firsts, out = batch.column(0).to_numpy(), firsts.to_numpy(), [np.zeros((0, 4), np.int64)]
        for i, j in _steps(bounds):
            part, own = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            found = anchored(part, open_within(part, own, rows[at[i] : at[j]] - i, firsts[at[i] : at[j]]))
            text = np.searchsorted(own, found[:, 1], "right") - 1
            out.append(np.column_stack((found[:, 0], keys[i:j][text], found[:, 1] - own[text], found[:, 2])))
        a = np.concatenate(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32)), pa.array(a[:, 3].astype(np.int32))], names=["h", "key", "lo", "form"]
        )
    release_memory()


def _contexts(batches):
    for batch in batches:
        raw, bounds = _texts(batch.column(1))
        rows, found, at = _listed(batch.column(2))
        h, lo, form = (found.field(name) for name in ("h", "lo", "form"))
        starts = bounds[rows] + lo.to_numpy()
        stops, out = starts + (form.to_numpy() >> 7) + MINIMUM, []
        for i, j in _steps(bounds):
            whole, base = raw[bounds[i] : bounds[j]].tobytes(), bounds[i]
            out += [whole[a:b] for a, b in zip((starts[at[i] : at[j]] - base).tolist(), (stops[at[i] : at[j]] - base).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([h, batch.column(0).take(pa.array(rows)), lo, form, pa.array(out, pa.binary())], names=["h", "key", "lo", "form", "context"])
    release_memory()


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` symbols or more, by prefix tripling (doubling, if three ranks
    don't go into 64 bits). Symbols are below 512."""
    n, done = len(text), 7
    times = 3 if n < 1 << 21 else 2
    padded = np.concatenate([text.astype(np.uint16) + np.uint16(1), np.zeros(done, np.uint16)])
    key = np.zeros(n, np.uint64)
    for k in range(done):
        key = key << np.uint64(9) | padded[k : k + n]
    while True:
        order = np.argsort(key).astype(np.int32)  # a shard is far below 2^31 symbols: half the memory
        key = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])), dtype=np.uint32)
        if done >= length or rank[order[-1]] == n:
            return order
        key = rank.astype(np.uint64)
        for k in range(1, times):
            key <<= np.uint64(64 // times)
            key[: max(0, n - k * done)] |= rank[k * done :]
        done *= times


def long_prefix_rows(text: np.ndarray, order: np.ndarray, minimum: int) -> np.ndarray:
    """For each row of the suffix array: is the prefix it shares with the row before at least `minimum` long?

    Breadth-first backward extension: rows whose common prefix is of length l bound intervals of suffixes that agree
    in l symbols. Extended to the left by a symbol c, through the BWT's mapping from first to last column, two
    neighbouring rows that begin with c share 1 + the least of the prefixes between their tails. So rows get values
    by increasing l, each once, and the search ends at the minimum: what has no value then shares more.

    Within a run of the BWT the tails are neighbours too, and a row has 1 + the value of its tail's row: it is told with
    the next row on its way through the text whose tails aren't neighbours. Only those are looked at for each l.
    """
    n = len(order)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    first = text[order]
    agree = np.concatenate(([False], first[1:] == first[:-1]))
    tail = row[np.minimum(order + 1, n - 1)]
    ended = np.flatnonzero(order + 1 == n)[0]  # the last symbol has no tail: what would extend it shares one symbol
    short = np.zeros(n, bool)
    short[ended : ended + 2] = agree[ended : ended + 2]
    steps = np.concatenate(([0], np.diff(tail)))
    free = ~(agree & (steps == 1)) | short  # rows that have no value by another row's
    heads = np.flatnonzero(free[row])  # their places in the text
    before = np.diff(heads, prepend=-1)  # how many places each tells: itself, and those before it up to the last head
    value = np.full(n, minimum, np.uint16)

    def tell(heads: np.ndarray, counts: np.ndarray, length: int) -> None:
        counts = np.minimum(counts, minimum - length)
        away = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        value[row[np.repeat(heads, counts) - away]] = away + length

    own = row[heads]
    none = ~agree[own]
    tell(heads[none], before[none], 0)
    one = short[own]
    todo = ~none & ~one
    one_heads, one_before = heads[one], before[one]
    heads, before, own = heads[todo], before[todo], own[todo]
    here, above = tail[own], tail[own - 1]
    del first, agree, tail, short, steps, free  # as long as the text each
    for length in range(1, minimum):
        if not len(heads) and length > 1:
            break
        bounds = np.cumsum(value < length, dtype=np.int32)
        new = bounds[here] != bounds[above]
        tell(heads[new], before[new], length)
        if length == 1:
            tell(one_heads, one_before, 1)
        if new.any():
            heads, before, here, above = heads[~new], before[~new], here[~new], above[~new]
    return value == minimum


def repeated_places(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each context starts in their joint text, and which places of it begin a window that equals one of an earlier
    context, or an earlier one of its own."""
    lengths = np.array([len(c) for c in contexts])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16)
    text[starts + lengths] = 256
    order = suffix_array(text, MINIMUM)
    same = long_prefix_rows(text, order, MINIMUM)
    is_window = np.zeros(len(text), bool)
    for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        is_window[s : s + n - MINIMUM + 1] = True
    rows = np.flatnonzero(is_window[order])
    group = np.cumsum(~same, dtype=np.int32)[rows]  # suffixes with the same prefix of MINIMUM bytes
    places = order[rows]
    repeat = np.zeros(len(text), bool)
    if len(rows):
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(places, heads)
        repeat[places] = True
        repeat[least] = False
    return starts, repeat


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its windows equal one of an earlier context, or an earlier one of its own."""
    starts, repeat = repeated_places(contexts)
    return [repeat[s : s + len(c) - MINIMUM + 1] for s, c in zip(starts.tolist(), contexts, strict=True)]


def may_share(contexts: list[bytes], forms: list[int]) -> np.ndarray:
    """Which contexts can share a window with another one at all.

    Beside its anchor a window has BESIDE bytes on the left or on the right at least. So contexts that share one
    agree in their anchor with that many bytes on one side; those that agree with none need no suffix array. Two windows
    of one context never are equal: their anchor is in one place, and not as far from the one as from the other.
    """
    sides: list[list[int]] = [[], []]
    for k, (context, form) in enumerate(zip(contexts, forms, strict=True)):
        at = form & 127
        sides[0].append(hash(context[at - BESIDE : at + GRAM]) if at >= BESIDE else k)
        sides[1].append(hash(context[at : at + GRAM + BESIDE]) if len(context) >= at + GRAM + BESIDE else k)
    found = np.zeros(len(contexts), bool)
    for side in sides:
        _, group, count = np.unique(np.array(side, np.int64), return_inverse=True, return_counts=True)
        found |= count[group] > 1
    return found


def _shard_repeats(shard: pa.Table) -> pa.Table:
    key, lo, form = (shard.column(name).to_numpy() for name in ("key", "lo", "form"))
    order = np.lexsort((lo, key))
    key, lo, form = key[order], lo[order], form[order]
    coded = shard.column("context").combine_chunks().take(pa.array(order)).dictionary_encode()
    most = np.maximum.accumulate(coded.indices.to_numpy())
    is_first = np.diff(most, prepend=-1) > 0  # of equal contexts, all windows of all but the first are repeats
    out = [(key[~is_first], lo[~is_first], (lo + (form >> 7) + 1)[~is_first])]
    contexts = coded.dictionary.to_pylist()
    few = may_share(contexts, form[is_first].tolist())
    if few.any():
        starts, repeat = repeated_places([c for c, f in zip(contexts, few.tolist(), strict=True) if f])
        spans = runs(repeat)
        k = np.searchsorted(starts, spans[:, 0], "right") - 1
        at = np.flatnonzero(is_first)[few][k]
        out.append((key[at], lo[at] + spans[:, 0] - starts[k], lo[at] + spans[:, 1] - starts[k]))
        release_memory()  # the next shard's arrays are of other sizes
    return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "start", "stop"])


def _window_digests(batches):
    """Of contexts whose anchor is very frequent: every window by itself."""
    for batch in batches:
        keys, starts, digests = [], [], []
        for key, lo, context in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            for k in range(len(context) - MINIMUM + 1):
                keys.append(key)
                starts.append(lo + k)
                digests.append(hashlib.blake2b(context[k : k + MINIMUM], digest_size=16).digest())
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(keys, pa.int64()), pa.array(starts, pa.int32())], names=["h1", "h2", "key", "start"])
    release_memory()


def removed_spans(raw: np.ndarray, bounds: np.ndarray, firsts: tuple, repeats: tuple, hot: tuple, hot_firsts: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What repeated windows cover: text, start and stop of each run, in order. The marks are the texts' numbers, and items,
    starts and stops of windows, or starts of windows that are no repeats, within them."""
    repeated = np.zeros(len(raw), bool)
    is_open = open_within(raw, bounds, *firsts)
    repeated[: len(is_open)] = ~is_open
    for b in bounds[1:].tolist():  # no window begins there; a short text has none
        repeated[max(0, b - MINIMUM + 1) : b] = False
    for text, start, stop in (repeats, hot):
        for a, b in zip((bounds[text] + start).tolist(), (bounds[text] + stop).tolist(), strict=True):
            repeated[a:b] = True
    repeated[bounds[hot_firsts[0]] + hot_firsts[1]] = False
    spans = runs(repeated)
    starts, stops = spans[:, 0], spans[:, 1] + MINIMUM - 1
    text = np.searchsorted(bounds, starts, "right") - 1
    new = np.ones(len(starts) + 1, bool)
    new[1:-1] = (starts[1:] > stops[:-1]) | (text[1:] != text[:-1])
    return text[new[:-1]], (starts - bounds[text])[new[:-1]], (stops - bounds[text])[new[1:]]


def _removed(batches):
    for batch in batches:
        raw, bounds = _texts(batch.column(1))
        lists = [_listed(batch.column(k)) for k in range(2, 6)]
        fields = [[lists[0][1].to_numpy()], [lists[1][1].field(c).to_numpy() for c in ("start", "stop")], [lists[2][1].field(c).to_numpy() for c in ("lo", "form")], [lists[3][1].to_numpy()]]
        fields[2][1] = fields[2][0] + (fields[2][1] >> 7) + 1
        out, hashes = [np.zeros((0, 3), np.int64)], []
        for i, j in _steps(bounds):
            part, own = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            marks = ((rows[at[i] : at[j]] - i, *(f[at[i] : at[j]] for f in columns)) for (rows, _, at), columns in zip(lists, fields, strict=True))
            text, starts, stops = removed_spans(part, own, *marks)
            out.append(np.column_stack((text + i, starts, stops)))
            ends = [hashlib.sha256() for _ in range(i, j)]
            whole, done = part.tobytes(), own[:-1].tolist()
            for k, a, b in zip(text.tolist(), (own[text] + starts).tolist(), (own[text] + stops).tolist(), strict=True):
                ends[k].update(whole[done[k] : a])
                done[k] = b
            for k, b in enumerate(own[1:].tolist()):
                ends[k].update(whole[done[k] : b])
            hashes += [e.hexdigest() for e in ends]
        rows, starts, stops = np.concatenate(out).T
        gone = np.bincount(rows, stops - starts, len(bounds) - 1).astype(np.int64)
        spans = pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(len(bounds))).astype(np.int32), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (starts, stops)], ["start", "stop"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(gone), spans, pa.array(hashes, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])
    release_memory()


def within(key: int, k: int) -> int:
    """The place of a document's item k, in the order of documents and then of items."""
    if k >> ORD_BITS:
        raise ValueError(f"a document has more than {1 << ORD_BITS} items")
    return key << ORD_BITS | k


def numbered(docs: DataFrame, order: list) -> DataFrame:
    """`docs` with key, the rank of each row from 0 by `order`: within ranges of the order and by the ranges' sizes, so
    that no task has all rows."""
    ranged = written(docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("_before"))
    nth = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)  # monotonically_increasing_id: the partition above 33 bits
    return ranged.join(F.broadcast(before), "_part").withColumn("key", nth + F.col("_before")).drop("_part", "_row", "_before")


def keyed_documents(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text), bucketed by key: a number from 0 that orders documents by id.

    Ids that are null (first), repeated (by the text's hash) or far apart are numbered by rank.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, distinct, low, high = docs.select(F.count(F.lit(1)), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if n == distinct and (n == 0 or high - low < 1 << FIRST_KEY_BITS):
        keyed = docs.withColumn("key", F.col("doc_id") - F.lit(low or 0))
    else:
        keyed = numbered(docs, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]).select("doc_id", "text", "key")
    buckets, name = shuffle_partitions(spark), f"wordloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    keyed.repartition(buckets, "key").write.bucketBy(buckets, "key").format("parquet").option("path", path).saveAsTable(name)
    undone_by(lambda: (spark.sql(f"DROP TABLE IF EXISTS {name}"), delete_path(spark, path)))
    collect_garbage(spark)
    return spark.table(name)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, spans (start, stop of each removed run), kept_sha256.

    A byte goes if a string of MINIMUM bytes that covers it also starts earlier: in a document of a smaller id, or
    in the same one. Everything is judged on the input. Of rows that repeat an id, the text's hash orders them; null
    ids come first; a null text is empty, and texts shorter than MINIMUM bytes stay whole. Other columns are ignored.

    1. Long repeats: content-defined segments, and bridges over their cuts, are grouped by digest. In one that isn't
       the first of its kind every window is a repeat; a window's first place is never in one. Most removed bytes are
       found here, by digest and not by the suffix array.
    2. The windows left are keyed by an anchor that depends on their bytes alone; most anchors occur once. The others'
       contexts are dealt by anchor into shards of bounded size. Contexts that agree with no other for long enough
       beside their anchor go, and equal ones stand for each other; a suffix array and BWT tell the repeats of the rest.
    3. An anchor with too many contexts for one shard (MOST_CONTEXTS) has its windows grouped one by one, by digest: the
       same repeats, found without the suffix array.
    """
    spark = docs.sparkSession
    texts = keyed_documents(docs)
    mask = (1 << ORD_BITS) - 1
    digests = texts.select("key", "text").mapInArrow(_item_digests, "h1 bigint, h2 bigint, place bigint")
    firsts = digests.groupBy("h1", "h2").agg(F.min("place").alias("place")).select(
        F.shiftright("place", ORD_BITS).alias("key"), F.col("place").bitwiseAND(F.lit(mask)).cast("int").alias("item")
    )
    firsts = tidy(firsts.groupBy("key").agg(F.collect_list("item").alias("firsts")))

    anchors = tidy(texts.join(firsts, "key").select("key", "text", "firsts").mapInArrow(_anchors, "h bigint, key bigint, lo int, form int"))
    total = anchors.count()
    often = tidy(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hottest = often.agg(F.max("n")).first()[0] or 0
    again = tidy(join_counted(anchors, often, "h", "n", total, hottest))
    most, size = again.agg(F.max("n"), F.sum(F.shiftright("form", 7) + F.lit(MINIMUM + 1))).first()
    hot = F.col("n") > MOST_CONTEXTS
    per_key = F.collect_list(F.struct("h", "lo", "form")).alias("found")

    def contexts(own: DataFrame) -> DataFrame:
        some = texts.join(own.groupBy("key").agg(per_key), "key").select("key", "text", "found")
        return some.mapInArrow(_contexts, "h bigint, key bigint, lo int, form int, context binary")

    shards = max(1, math.ceil((size or 0) / SHARD_BYTES))
    dealt = contexts(again.filter(~hot)).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    repeats = dealt.repartition(max(shuffle_partitions(spark), min(shards, 1 << 15)), "shard").groupBy("shard").applyInArrow(_shard_repeats, "key bigint, start int, stop int")
    repeats = tidy(repeats.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("repeats")))

    marked = texts.join(firsts, "key", "left").join(repeats, "key", "left")
    if (most or 0) > MOST_CONTEXTS:
        windows = contexts(again.filter(hot)).mapInArrow(_window_digests, "h1 bigint, h2 bigint, key bigint, start int")
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("key", "start")).alias("f")).groupBy("f.key").agg(F.collect_list("f.start").alias("hot_firsts"))
        spans = again.filter(hot).groupBy("key").agg(F.collect_list(F.struct("lo", "form")).alias("hot"))
        marked = marked.join(tidy(spans), "key", "left").join(tidy(first), "key", "left")
    else:
        marked = marked.withColumns({"hot": F.expr("cast(null as array<struct<lo:int,form:int>>)"), "hot_firsts": F.expr("cast(null as array<int>)")})
    return marked.select("doc_id", "text", "firsts", "repeats", "hot", "hot_firsts").mapInArrow(
        _removed, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string"
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
