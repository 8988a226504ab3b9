"""Long exact spans shared between records (problem 8).

Units are hashed, their digests grouped globally, and what another record also has is marked with its original
offsets.  Lines are too coarse for runs that are exact to the character and may cross line ends, so the unit
is cut from the content: every window of ``span`` characters belongs to the smallest hash among its
``GRAM``-grams (its anchor), and the neighbouring windows of one anchor are a unit.  Equal windows always have
equal anchors at equal offsets, so all of a window's copies meet in one group, and grouping misses nothing.
Inside a group units are compared by digest; where a digest stands alone among others, its windows are
compared one by one.  No pairs of records are formed; a group's cost is linear in its size, and each slice of
texts sends equal units once, so a text that a third of all records repeat makes no hot group.  The number of
buckets grows with the table, and a task opens one at a time; should a bucket be too large for that (an anchor that
very many records have, each in another context), its windows go on as rows of digests, which Spark groups.
Digests have 64 bits and are compared within one group only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hot_keys, ragged, slices, spread_join, table_bytes

#: Least length of a shared span; characters of the gram whose hash anchors a window.
SPAN, GRAM = 200, 100

#: Characters of text in one piece and in one slice: a worker's memory is about 100 bytes a character of a slice.
PIECE, SLICE = 1_000_000, 3_000_000

#: Bytes of units that a task gathers before it packs them by bucket; bytes of contexts that are compared at once.
HELD, PORTION = 48_000_000, 4_000_000

#: Bytes of the table for which there is a bucket; most partitions of buckets; bytes of units that a task opens at once.
BUCKET_BYTES, MOST_PARTS, OPENED = 16_000_000, 20_000, 160_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of any stretches of an array of code points, by prefix sums modulo 2^64."""

    def __init__(self, codes: np.ndarray):
        power, self.inverse = _powers(len(codes) + 1)  # an empty stretch may begin at the end
        values = _mix(codes.astype(np.uint64) + np.uint64(0x51_7C_C1_B7))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return _mix((self.prefix[length:] - self.prefix[:-length]) * self.inverse[:n])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each window of ``width`` values, the leftmost of equal ones."""
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, len(v) - step), slice(step, len(v))
        later = v[right] < v[left]
        v, at = np.where(later, v[right], v[left]), np.where(later, at[right], at[left])
        have += step
    return at


#: Characters outside a text's own block that get a code below 32 in packed contexts (fixed values).
_COMMON = [0x0964, 0x0965, 0x200C, 0x200D, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2026, 0x00AB, 0x00BB, 0x00A0]
_CODES = np.array([*range(1, 9), *range(14, 21)], np.uint32)
_PLAIN = np.full(0x2100, 0, np.uint8)
_PLAIN[_COMMON] = _CODES
_PLAIN[[9, 10, 13]] = 9, 10, 13
_PLAIN[32:128] = np.arange(32, 128)
_UNPLAIN = np.zeros(128, np.uint32)
_UNPLAIN[_CODES], _UNPLAIN[[9, 10, 13]], _UNPLAIN[32:] = _COMMON, (9, 10, 13), np.arange(32, 128)


def pack(codes: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of two runs each as bytes: one byte a character where all come from ASCII, the common marks and
    one page of 128 code points (its number is given), else UTF-8 (page -1).  Without loss."""
    size = lens[::2] + lens[1::2]
    chars = codes[ragged(start, lens)]
    plain = _PLAIN[np.minimum(chars, 0x20FF)]
    page = np.where(plain > 0, 0, chars >> 7).astype(np.int32)
    bad = (chars < 128) & (plain == 0)  # control characters
    page[bad] = 1 << 20
    begin = np.cumsum(size) - size
    most = np.maximum.reduceat(page, begin)
    least = np.minimum.reduceat(np.where(plain > 0, 1 << 21, page), begin)
    own = ((most == 0) | (most == least)) & (most < 1 << 15)
    byte = np.where(plain > 0, plain, 128 | (chars & 127)).astype(np.uint8)
    count = size.copy()
    other = np.flatnonzero(~own)
    if not len(other):
        return most.astype(np.int16), np.concatenate(([0], np.cumsum(count))).astype(np.int32), byte
    texts = [chars[b : b + n].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for b, n in zip(begin[other].tolist(), size[other].tolist(), strict=True)]
    count[other] = [len(x) for x in texts]
    ends = np.cumsum(count)
    data = np.empty(int(ends[-1]), np.uint8)
    data[ragged((ends - count)[own], count[own])] = byte[ragged(begin[own], size[own])]
    data[ragged((ends - count)[other], count[other])] = np.frombuffer(b"".join(texts), np.uint8)
    return np.where(own, most, -1).astype(np.int16), np.concatenate(([0], ends)).astype(np.int32), data


def unpack(page: np.ndarray, context: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of packed contexts one after another, and each one's number of characters."""
    offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
    data = np.frombuffer(context.buffers()[2], np.uint8)
    count = np.diff(offsets)
    raw = data[offsets[0] : offsets[-1]]
    pages = np.repeat(page.astype(np.uint32), count)
    codes = np.where(raw < 128, _UNPLAIN[raw & 127], (pages << 7) | (raw & 127)).astype(np.uint32)
    other = np.flatnonzero(page < 0)
    if not len(other):
        return codes, count
    texts = [raw[a : a + n].tobytes().decode("utf-8", "surrogatepass") for a, n in zip((offsets[other] - offsets[0]).tolist(), count[other].tolist(), strict=True)]
    lens = count.copy()
    lens[other] = [len(x) for x in texts]
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]), np.uint32)
    own = page >= 0
    out[ragged((ends - lens)[own], lens[own])] = codes[ragged((offsets[:-1] - offsets[0])[own], count[own])]
    out[ragged((ends - lens)[other], lens[other])] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lens


def in_pieces(ids: list[int], texts: list[str], span: int, size: int = PIECE) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Ids, texts and offsets, with texts of more than ``size`` characters cut; each window lies in one piece."""
    if all(len(t) <= size + span for t in texts):
        return np.array(ids, np.int64), texts, np.zeros(len(texts), np.int64)
    cut = [(i, t[a : a + size + span - 1], a) for i, t in zip(ids, texts, strict=True) for a in range(0, max(1, len(t) - span + 1), size)]
    return np.array([i for i, _, _ in cut], np.int64), [t for _, t, _ in cut], np.array([a for _, _, a in cut], np.int64)


def units(ids: np.ndarray, texts: list[str], span: int, gram: int, bases: np.ndarray | None = None) -> pa.RecordBatch:
    """(doc_id, anchor, at, low, high, page, context, digest): one row per unit.  Its windows start at low..high, counted
    from the anchor gram, which starts at ``at``; context is the text around the gram that the windows cover, and
    digest stands for the whole unit."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    starts = ends - lens
    rolling = Rolling(codes)
    hashes = rolling.every(gram)
    window = ragged(starts, lens - span + 1)
    anchor = smallest(hashes, span - gram + 1)[window]
    doc = np.repeat(np.arange(len(texts)), lens - span + 1)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((first[1:], [len(window)])) - 1
    at, d = anchor[first], doc[first]
    left, right = window[first], window[last] + span
    page, offsets, data = pack(codes, np.stack((left, at + gram), 1).ravel(), np.stack((at - left, right - at - gram), 1).ravel())
    context = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    low = (left - at).astype(np.int64).view(np.uint64)
    digest = _mix(rolling.of(left, at) * np.uint64(3) + rolling.of(at + gram, right) + _mix(hashes[at]) + _mix(low) * np.uint64(5))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[d]), pa.array(hashes[at].view(np.int64)), pa.array((at - starts[d] + (0 if bases is None else bases[d])).astype(np.int32)), pa.array((left - at).astype(np.int16)), pa.array((window[last] - at).astype(np.int16)), pa.array(page), context, pa.array(digest.view(np.int64))],
        names=["doc_id", "anchor", "at", "low", "high", "page", "context", "digest"],
    )


#: What a unit row stands for: a unit of one record; a unit that several records of its slice have; a stretch
#: that is known to be shared (it has no context, and its windows are those of low..high).
LONE, COMMON, KNOWN = 0, 1, 2
_MANY = np.iinfo(np.int64).min  # stands for the other records of a common unit


def unit_hashes(anchor: np.ndarray, low: np.ndarray, page: np.ndarray, context: pa.Array) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Rolling hashes of the contexts, where each begins, and a digest of each unit."""
    codes, lens = unpack(page, context)
    begin = np.cumsum(lens) - lens
    rolling = Rolling(codes)
    return rolling, begin, _mix(rolling.of(begin, begin + lens) + _mix(anchor.view(np.uint64)) + _mix(low.astype(np.int64).view(np.uint64)) * np.uint64(3))


def several(keys: np.ndarray, docs: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows' keys more than one record has, or a common unit; and the first row of each key."""
    n = len(keys)
    if common is not None and common.any():
        keys, docs = np.concatenate((keys, keys[common])), np.concatenate((docs, np.full(int(common.sum()), _MANY)))
    order = np.argsort(keys, kind="stable")
    k, x = keys[order], docs[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.concatenate((new, [len(k)])))
    many = np.minimum.reduceat(x, new) != np.maximum.reduceat(x, new)
    out, first = np.empty(len(k), bool), np.zeros(len(k), bool)
    out[order] = np.repeat(many, size)
    first[order[new]] = True
    return out[:n], first[:n]


def thinned(made: pa.RecordBatch) -> pa.RecordBatch:
    """Units of one slice, pre-aggregated: of equal units of several records one goes on as common with its
    context, the others as known stretches.  However many copies a text has, each slice sends its units once."""
    doc, page, digest = (np.asarray(made.column(k)) for k in (0, 5, 7))
    shared, first = several(digest, doc)
    kind = np.where(~shared, LONE, np.where(first, COMMON, KNOWN)).astype(np.int8)
    known = kind == KNOWN
    context = pa.compute.if_else(pa.array(known), pa.scalar(b"", pa.binary()), made.column(6)) if known.any() else made.column(6)
    return pa.RecordBatch.from_arrays([*made.columns[:5], pa.array(np.where(known, np.int16(0), page)), context, pa.array(kind)], names=[*made.schema.names[:7], "kind"])


def compare(doc: np.ndarray, anchor: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, page: np.ndarray, kind: np.ndarray, context: pa.Array, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, end) of the stretches whose windows another record has too, of whole groups of units."""
    known = kind == KNOWN
    found = [(doc[known], (at + low)[known], (at + high)[known] + span)]
    rest = np.flatnonzero(~known)
    if len(rest) < len(doc):
        doc, anchor, at, low, high, page, kind = (x[rest] for x in (doc, anchor, at, low, high, page, kind))
        context = context.take(pa.array(rest))
    if not len(doc):
        return found[0]
    rolling, begin, unit = unit_hashes(anchor, low, page, context)
    common = kind == COMMON
    group = _mix(anchor.view(np.uint64))
    shared, first = several(unit, doc, common)
    # Left are units that stand alone, and one of each shared unit, in groups with other units.
    open_ = np.flatnonzero(several(group, doc, common)[0] & (~shared | first))
    found.append((doc[shared], (at + low)[shared], (at + high)[shared] + span))
    if len(open_):
        open_ = open_[several(group[open_], np.where(shared[open_], 0, 1))[0] | ~shared[open_]]
    if len(open_):
        open_ = open_[np.argsort(group[open_], kind="stable")]
        windows = (high - low + 1).astype(np.int64)[open_]
        new = np.flatnonzero(np.concatenate(([True], group[open_][1:] != group[open_][:-1])))
        wanted = np.flatnonzero(np.diff(np.cumsum(windows) // 4_000_000)) + 1
        cuts = {int(new[np.searchsorted(new, b, "right") - 1]) for b in wanted.tolist()} - {0}  # between groups only
        bounds = [0, *sorted(cuts), len(open_)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            rows, count = open_[a:b], windows[a:b]
            who = np.repeat(rows, count)
            offset = ragged(low[rows].astype(np.int64), count)
            start = begin[who] + offset - low[who]
            key = _mix(rolling.of(start, start + span - gram) + group[who] + _mix(offset.view(np.uint64)) * np.uint64(5))
            other = np.where(shared[who], -who - 1, doc[who])  # a shared unit differs from every lone one
            same = several(key, other)[0] & ~shared[who]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
            if len(edge):
                # runs of windows; one that goes on in the next unit is split there
                cut = np.unique(np.concatenate((edge[::2], np.flatnonzero(same & np.concatenate(([True], who[1:] != who[:-1]))))))
                stop = np.unique(np.concatenate((edge[1::2], np.flatnonzero(np.concatenate((same[:-1] & (who[1:] != who[:-1]), [False]))) + 1)))
                found.append((doc[who[cut]], at[who[cut]] + offset[cut], at[who[cut]] + offset[stop - 1] + span))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows(doc: np.ndarray, anchor: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, page: np.ndarray, kind: np.ndarray, context: pa.Array, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_MATCHED`` for units that cannot be compared here: stretches known to be shared, and a digest of every window."""
    settled = kind != LONE
    yield _matched(doc[settled], (at + low)[settled].astype(np.int64), (at + high)[settled].astype(np.int64) + span)
    rest = np.flatnonzero(kind != KNOWN)
    if len(rest):
        doc, anchor, at, low, high, page, kind = (x[rest] for x in (doc, anchor, at, low, high, page, kind))
        rolling, begin, _ = unit_hashes(anchor, low, page, context.take(pa.array(rest)))
        count = (high - low + 1).astype(np.int64)
        who = np.repeat(np.arange(len(doc)), count)
        offset = ragged(low.astype(np.int64), count)
        start = begin[who] + offset - low[who]
        key = _mix(rolling.of(start, start + span - gram) + _mix(offset.view(np.uint64)) * np.uint64(5))
        yield _matched(doc[who], at[who] + offset, at[who] + offset + span, anchor[who], key.view(np.int64), (kind == COMMON)[who])


#: Shared stretches (key null), and windows that are still to be grouped by (anchor, key); many: other records have it, too.
_MATCHED = "doc_id long, start int, end int, anchor long, key long, many boolean"


def _matched(doc: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray | None = None, key: np.ndarray | None = None, many: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    rest = [pa.nulls(n, t) if x is None else pa.array(x) for x, t in ((anchor, pa.int64()), (key, pa.int64()), (many, pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), *rest], names=["doc_id", "start", "end", "anchor", "key", "many"])


def _portions(part: pa.RecordBatch, span: int) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """The pieces of a slice; a slice of one very long text comes in several portions."""
    ids, texts, bases = in_pieces(part.column(0).to_pylist(), part.column(1).to_pylist(), span)
    ends = np.cumsum([len(t) for t in texts]) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield ids[a:b], texts[a:b], bases[a:b]


#: Columns of a unit row, as they are packed.
_COLUMNS = [("doc_id", np.int64), ("anchor", np.int64), ("at", np.int32), ("low", np.int16), ("high", np.int16), ("page", np.int16), ("kind", np.int8)]


def _shut(batch: pa.RecordBatch) -> bytes:
    """Units as compressed bytes, column after column: neighbouring units of a record share text, which a row's own
    compression can't see."""
    context = batch.column(6)
    offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1]
    data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(context) else np.zeros(0, np.uint8)
    columns = [np.ascontiguousarray(np.asarray(batch.column(name)), dtype=kind).tobytes() for name, kind in _COLUMNS]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(context).to_bytes(4, "little"), *columns, np.diff(offsets).astype(np.int32).tobytes(), data.tobytes()]))


def _open(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns, lengths of the contexts, their bytes) of packed units."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for _, kind in _COLUMNS:
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    lens = np.frombuffer(raw, np.int32, n, at)
    return columns, lens, np.frombuffer(raw, np.uint8, offset=at + 4 * n)


def _opened(blobs: list[bytes]) -> Iterator[tuple[list[np.ndarray], pa.Array]]:
    """The columns and contexts of packed units, in portions of whole groups of about PORTION bytes of context."""
    opened = [_open(b) for b in blobs]
    columns = [np.concatenate([c[k] for c, _, _ in opened]) for k in range(len(_COLUMNS))]
    lens = np.concatenate([x for _, x, _ in opened]).astype(np.int64)
    data = np.concatenate([x for _, _, x in opened])
    del opened
    begin = np.cumsum(lens) - lens
    portions = max(1, -(-len(data) // PORTION))
    where = (_mix(columns[1].view(np.uint64)) >> np.uint64(24)) % np.uint64(portions)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(portions + 1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        rows = order[a:b]
        if len(rows):
            offsets = np.concatenate(([0], np.cumsum(lens[rows]))).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(begin[rows], lens[rows])])])
            yield [c[rows] for c in columns], context


def _merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping and touching stretches of each record."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start, end
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    base = np.cumsum(new_doc) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.flatnonzero(np.concatenate(([True], start[1:] + base[1:] > reach[:-1])))
    last = np.concatenate((new[1:], [len(doc)])) - 1
    return doc[new], start[new], reach[last] - base[last]


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, opened: int = OPENED) -> DataFrame:
    """(doc_id, start_pos, end_pos): the maximal runs of characters that lie in ``span`` or more consecutive
    characters which the text of another id also has.

    Positions count code points from 0, end exclusive.  Null, empty and shorter texts share nothing.  Rows that
    repeat an id are one record: what only they have in common is not shared.
    """

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("_text"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table_bytes(texts, "_text") // BUCKET_BYTES))
    parts = min(buckets, MOST_PARTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per bucket of anchors, for as many slices as HELD allows: the bucket's units, packed."""
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            made = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            where = (_mix(np.asarray(made.column(1)).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            made, where = made.take(pa.array(order)), where[order]
            first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            last = np.concatenate((first[1:], [len(where)]))
            blobs = [_shut(made.slice(a, b - a)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(where[first]), pa.array(where[first] % parts), pa.array(blobs, pa.binary())], names=["bucket", "part", "units"])

        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                for ids, texts, bases in _portions(part, span):
                    held.append(thinned(units(ids, texts, span, gram, bases)))
                    if sum(x.nbytes for x in held) > HELD:
                        yield flush()
        if held:
            yield flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now, size, large = -1, 0, False

        def run() -> Iterator[pa.RecordBatch]:
            for columns, context in _opened(held) if held else ():
                if large:
                    yield from windows(*columns, context, span, gram)
                else:
                    yield _matched(*_merge(*compare(*columns, context, span, gram)))
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                bucket, blob = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if bucket != now:
                    yield from run()
                    now, size, large = bucket, 0, False
                held.append(blob)
                size += zstandard.frame_content_size(blob)
                if large or size > opened:
                    large = True
                    yield from run()
        yield from run()

    texts = texts.where(F.length("_text") >= span).where("doc_id is not null")
    rows = texts.select("doc_id", "_text").mapInArrow(cut, "bucket int, part int, units binary")
    # A bucket's partition goes by its own number: a digest of it would leave some tasks with twice the work.
    dealt = rows.repartitionById(parts, "part")
    matched = checkpoint(dealt.sortWithinPartitions("bucket").mapInArrow(match, _MATCHED))
    stretches = matched.where("key is null").select("doc_id", "start", "end")
    left = matched.where("key is not null")
    if not left.isEmpty():
        counts = checkpoint(left.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("many").alias("other")).where("other or a != b"))
        again = spread_join(left.select("anchor", "key", "doc_id", "start", "end"), counts.select("anchor", "key"), ["anchor", "key"], hot_keys(counts, ["anchor", "key"]))
        stretches = stretches.unionByName(again.select("doc_id", "start", "end"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = stretches.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start_pos"), F.max("end").alias("end_pos")).select(F.col("doc_id").alias(id_col), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


def shared_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part): how much of each record other records have too.

    One row per row of ``docs`` with an id; null and empty texts have 0 characters and a part of 0.
    """
    spans = shared_spans(docs, id_col, text_col, span).groupBy(id_col).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    base = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias(id_col), F.coalesce(F.length(docs[text_col]), F.lit(0)).cast("long").alias("n_chars"))
    shared = F.least(F.coalesce("shared_chars", F.lit(0)), F.col("n_chars"))
    return base.join(spans.hint("merge"), id_col, "left").select(id_col, "n_chars", shared.alias("shared_chars"), F.coalesce(shared / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)).alias("shared_part"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, start_pos, end_pos, kept_id, kept_pos): lines of at least ``span`` characters that repeat a line
    of an earlier place, to be removed, with their offsets in the original text and the place that is kept.

    Places rank by (id, position).  Lines are cut at ``\n``; null texts and rows without an id have none.  A text
    is read once, whatever its number of lines, and only digests of 128 bits and places are shuffled; the lines of a
    digest that very many records have are dealt to many tasks.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at = 0
                    for line in text.split("\n"):
                        if len(line) >= span:
                            d = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                            rows.append((i, at, len(line), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
                        at += len(line) + 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "start_pos", "n", "high", "low"])

    texts = docs.where((F.length(docs[text_col]) >= span) & docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    lines = checkpoint(texts.mapInArrow(digests, "doc_id long, start_pos long, n long, high long, low long"))
    place = F.struct("doc_id", "start_pos")
    first = checkpoint(lines.groupBy("high", "low").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    out = spread_join(lines, first.select("high", "low", "kept"), ["high", "low"], hot_keys(first, ["high", "low"])).where(place > F.col("kept"))
    return out.select(F.col("doc_id").alias(id_col), "start_pos", (F.col("start_pos") + F.col("n")).alias("end_pos"), F.col("kept.doc_id").alias("kept_id"), F.col("kept.start_pos").alias("kept_pos"))
