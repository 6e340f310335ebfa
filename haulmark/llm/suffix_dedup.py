"""Removal of byte strings that also start in a document with a smaller id, by hash-compared suffix sorting.

A byte goes when a ``SPAN``-byte string that covers it also starts in a document with a smaller id. Every string of
that length has one anchor, the k-gram with the least hash in it (the leftmost of equals), so equal strings have equal
anchors and only places that share an anchor with another document need to be compared.

1. Anchors of all texts are dealt out by hash, packed in runs of 32-bit hashes and 8-bit hashes of the ``SIDE`` bytes
   to the left and to the right. An equal string around an anchor has one of the two sides in full, so an anchor is a
   candidate if two documents have it with the same left or the same right side. Clashes of the short hashes only add
   candidates. What comes back is packed by part, a range of hashes of documents.
2. Texts with candidates are kept in the shared folder, bucketed by document, so that no later join moves a text. The
   stretch of strings around an anchor that all have it as theirs is compared as a whole by two 64-bit hashes; all but
   the smallest document lose an equal stretch.
3. What is left are anchors with several different stretches: their distinct contexts are sorted as suffixes. The sort
   is a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes. Runs of
   suffixes that agree over the whole length are confirmed byte by byte. Only the first place of a stretch in its
   smallest document is sorted; what is found there holds for all places of the stretch in that document.
4. Removed runs are merged per document.

Before both deals a run of texts settles what two of its documents share by themselves: such anchors are candidates at
once, and such stretches go from all but the smallest document. Only one or two documents of the run are dealt out for
them, so an anchor or a stretch that a third of all documents have reaches its task as a few entries of each run.

Nulls: a null text is empty. A null ``doc_id`` counts as larger than all others. Rows with the same id are one
document to this rule and never shorten each other. Repeated rows give repeated results; texts shorter than the
length stay whole; an empty table gives an empty result. Other columns are ignored unless carried. A very long text is
one run of its own and must fit a task; positions inside it have 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import (
    U64,
    below,
    free_shuffles,
    gram_hashes,
    inverse_powers,
    keep,
    keep_by_key,
    mix,
    partitions,
    prefix_hash,
    releasing,
    releasing_group,
    runs_of,
    span_hash,
    texts_of,
    utf8,
)
from haulmark.llm.packed import (
    Packer,
    as_batch,
    as_frame,
    cut_up,
    pack_by_bucket,
    packed_ddl,
    packed_schema,
    ranges,
    runs_of_equal,
    unpack,
)

SPAN, GRAM = 50, 24
SIDE = (SPAN - GRAM) // 2
_PLACE = 32  # bits of a position inside a run of texts, more than a string of Spark can have
_LAST = (1 << 63) - 1
BUCKET_BYTES = 32_000_000
BUCKETS = 256  # of anchors, if they are no larger than that


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple:
    """Anchor hash and place, first string and number of strings of each stretch; the text it lies in; prefix hashes.

    Places count over the whole run of texts.
    """
    prefix = prefix_hash(data)
    n = len(data) - gram + 1
    empty = np.empty(0, np.int64)
    if len(data) < span:
        return np.empty(0, np.uint64), empty, empty, empty, empty, prefix
    hashes = mix(gram_hashes(prefix, gram), 3)
    best, spare = np.arange(n, dtype=np.uint64), np.empty(n, np.uint64)
    best |= np.bitwise_and(hashes, ~U64((1 << _PLACE) - 1), out=spare)
    width, reach = span - gram + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        best, spare = np.minimum(best[:-step], best[step:], out=spare[: len(best) - step]), best
        reach += step
    inside = np.ones(len(best) + 1, bool)  # strings that end in their text
    inside[-1] = False
    ends = offsets[1:]
    for low, high in zip(np.maximum(offsets[:-1], ends - span + 1).tolist(), ends.tolist()):
        inside[low:high] = False
    other = best[1:] != best[:-1]
    start = np.flatnonzero(inside[:-1] & np.r_[True, other | ~inside[:-2]])
    count = np.flatnonzero(inside[:-1] & np.r_[other | ~inside[1:-1], True]) - start + 1
    place = (best[start] & U64((1 << _PLACE) - 1)).astype(np.int64)
    return hashes[place], place, start, count, np.searchsorted(ends, start, "right"), prefix


def _document_key(docs: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A hash of the document that ascends with its part."""
    return mix(docs.astype(np.uint64) ^ mix(prints.astype(np.uint64), 17), 18)


def part_of(docs: np.ndarray, prints: np.ndarray, parts: int) -> np.ndarray:
    """The part a document belongs to."""
    return below(_document_key(docs, prints), parts)


def _by_document(docs: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by part and document, and where each document begins in it (with the end of all)."""
    key = _document_key(docs, prints)
    order = np.argsort(key)
    for _ in range(2):
        d, p, k = docs[order], prints[order], key[order]
        other = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
        if not (other & (k[1:] == k[:-1])).any():
            break
        order = np.lexsort((prints, docs, key))  # two documents have the same key
    return order, np.r_[np.flatnonzero(np.r_[True, other][: len(d)]), len(d)]


def _pack_parts(docs: np.ndarray, prints: np.ndarray, parts: int, values: dict, lists: dict | None = None) -> dict:
    """One row per part with the values of its documents."""
    order, cut = _by_document(docs, prints)
    ids, names = docs[order[cut[:-1]]], prints[order[cut[:-1]]]
    n = np.diff(cut)
    part = np.repeat(part_of(ids, names, parts), n)
    values = {k: v[order] for k, v in values.items()}
    lists = {k: (v, first[order], many[order]) for k, (v, first, many) in (lists or {}).items()}
    return pack_by_bucket(part, np.repeat(np.arange(len(ids)), n), ids, names, values, lists)


def _sorted_keys(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys of so many bits, and the sorted keys. Which of equals comes first is open."""
    free = U64(64 - bits)
    if len(key) >> (64 - bits):
        order = np.argsort(key)
        return order, key[order]
    both = key << free | np.arange(len(key), dtype=np.uint64)
    both.sort()  # many times faster than to sort places by their key
    return (both & U64((1 << int(free)) - 1)).astype(np.int64), both >> free


def _two_documents(key: np.ndarray, docs: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, run and document of each sorted entry, and the smallest and largest document of each run."""
    order, key = _sorted_keys(key, bits)
    bounds, _ = runs_of_equal(key)
    docs = docs[order]
    if len(bounds) == 1:
        return order, order, docs, order, order
    run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return order, run, docs, np.minimum.reduceat(docs, bounds[:-1]), np.maximum.reduceat(docs, bounds[:-1])


def _shared_places(docs: np.ndarray, h: np.ndarray, sides: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose anchor two documents have with the same side; entries of a smallest or largest document."""
    shared, outer = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for side in sides:
        order, run, who, least, most = _two_documents(h.astype(np.uint64) << U64(8) | side, docs, 40)
        if len(order):
            shared[order] |= (least != most)[run]
            outer[order] |= (who == least[run]) | (who == most[run])
    return shared, outer


_DEALT = ("hashes", "left", "right")
HOT = 64  # an anchor with more places in a run of texts is a candidate whatever its sides are
_ANY = 255  # both sides: whatever they are. An anchor whose sides hash to this only adds candidates.


def _of_anchor(docs: np.ndarray, h: np.ndarray, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entries of anchors in two documents that have a marked entry, or are hot; those in the first and last document."""
    shared, outer = np.zeros(len(h), bool), np.zeros(len(h), bool)
    order, run, who, least, most = _two_documents(h.astype(np.uint64), docs, 32)
    if len(order):
        n = np.bincount(run) > HOT if marked is None else np.bincount(run, marked[order]) > 0
        shared[order] = (n & (least != most))[run]
        outer[order] = (who == least[run]) | (who == most[run])
    return shared, outer


def _deal(buckets: int) -> Callable:
    """Anchors by bucket; those that are candidates already, by part, with numbers from ``buckets`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, by_part = Packer(packed_schema(*_DEALT)), Packer(packed_schema(*_DEALT))
        for whole in batches:
            for s, e in runs_of(whole.column(2)):
                batch = whole.slice(s, e - s)
                ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                data, offsets = utf8(batch.column(2))
                h, place, _, _, doc, prefix = anchors(data, offsets)
                left = np.maximum(place - SIDE, offsets[doc])
                right = np.minimum(place + GRAM + SIDE, offsets[doc + 1])
                sides = [
                    (mix(span_hash(prefix, left, place), 11) >> U64(56)).astype("<u1"),
                    (mix(span_hash(prefix, place + GRAM, right), 12) >> U64(56)).astype("<u1"),
                ]
                short = h.astype("<u4")
                shared, outer = _shared_places(ids[doc], short, sides)
                hot, ends = _of_anchor(ids[doc], short)
                shared, outer = shared | hot, np.where(hot, ends, outer)
                sides = [np.where(hot, np.uint8(_ANY), side) for side in sides]
                dealt = np.flatnonzero(~shared | outer)
                bucket = below(mix(short[dealt].astype(np.uint64), 9), buckets)
                values = dict(zip(_DEALT, (short[dealt], sides[0][dealt], sides[1][dealt])))
                yield from by_bucket.add(bucket, doc[dealt], ids, prints, values)
                done = np.flatnonzero(shared)
                none = np.zeros(len(done), "<u1")
                values = dict(zip(_DEALT, (short[done], none, none)))
                part = buckets + part_of(ids, prints, buckets)[doc[done]]
                yield from by_part.add(part, doc[done], ids, prints, values)
        yield from by_bucket.rest()
        yield from by_part.rest()

    return run


def _shared(buckets: int) -> Callable:
    """Anchors that more than one document has, packed by part."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        docs, prints, h, *sides = unpack(frame, {"hashes": "<u4", "left": "<u1", "right": "<u1"})
        if frame["bucket"].iloc[0] < buckets:
            any_side = _of_anchor(docs, h, (sides[0] == _ANY) & (sides[1] == _ANY))[0]
            hit = np.flatnonzero(_shared_places(docs, h, sides)[0] | any_side)
            docs, prints, h = docs[hit], prints[hit], h[hit]
        return as_frame(_pack_parts(docs, prints, buckets, {"hashes": h}))

    return run


def _gather_anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """The candidate anchors of each document of a part."""
    docs, prints, h = unpack(frame, {"hashes": "<u4"})
    order, cut = _by_document(docs, prints)
    first = order[cut[:-1]]
    key = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(cut)) << U64(32) | h[order]
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    bounds = np.searchsorted(key >> U64(32), np.arange(len(first) + 1, dtype=np.uint64))
    return as_frame({"doc": docs[first], "print": prints[first], "hashes": cut_up(key.astype("<u4"), bounds)})


_STRETCH = ("anchor", "body", "start", "strings")


def _stretches(buckets: int) -> Callable:
    """Stretches of the candidate anchors: anchor hash, hash of the whole stretch, first string, number of strings.

    Those that a smaller document of the same run has go by part, with numbers from ``buckets`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(packed_schema(*_STRETCH))
        for whole in batches:
            for s, e in runs_of(whole.column(2)):
                batch = whole.slice(s, e - s)
                ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                data, offsets = utf8(batch.column(2))
                h, place, start, count, doc, prefix = anchors(data, offsets)
                wanted = [np.frombuffer(b, "<u4").astype(np.uint64) | U64(i << 32) for i, b in enumerate(batch.column(3).to_pylist())]
                key = doc.astype(np.uint64) << U64(32) | h.astype("<u4")
                wanted = np.concatenate(wanted)  # ascends, as the hashes of a document do
                use = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                h, place, start, count, doc = h[use], place[use], start[use], count[use], doc[use]
                body = mix(span_hash(prefix, start, start + count - 1 + SPAN), 6)
                body = mix(body ^ mix((place - start).astype(np.uint64) << U64(8) | count.astype(np.uint64), 7), 8)
                order, group, who, least, _ = _two_documents(body ^ mix(h, 19), ids[doc])
                later = np.zeros(len(h), bool)
                if len(order):
                    later[order] = who > least[group]
                bucket = np.where(later, buckets + part_of(ids, prints, buckets)[doc], below(mix(h, 9), buckets))
                values = dict(zip(_STRETCH, (h, body, (start - offsets[doc]).astype("<u4"), count.astype("<u1"))))
                yield from packer.add(bucket, doc, ids, prints, values)
        yield from packer.rest()

    return run


_SPANS = ("start", "strings")
_OPEN = ("anchor", "start", "strings", "further", "further_prints", "further_starts")
_FOUND = packed_ddl(*_OPEN)


def _found_parts(docs: np.ndarray, prints: np.ndarray, start: np.ndarray, strings: np.ndarray, parts: int) -> pd.DataFrame:
    return as_frame(_pack_parts(docs, prints, parts, {"start": start, "strings": strings}))


def _compare(buckets: int) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns = unpack(frame, {"anchor": "<u8", "body": "<u8", "start": "<u4", "strings": "<u1"})
        if frame["bucket"].iloc[0] >= buckets:
            docs, prints, _, _, start, strings = columns
            found = [_found_parts(docs, prints, start, strings, buckets)]
        else:
            found = _compared(*columns, buckets)
        names = [c.split()[0] for c in _FOUND.split(", ")]
        return pd.concat([f.reindex(columns=names).astype({"bucket": "int64"}) for f in found], ignore_index=True)

    return run


def _ranks(x: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones, for fewer than 2**32 values."""
    order = np.argsort(x)
    out = np.empty(len(x), np.uint64)
    out[order] = np.cumsum(np.r_[False, x[order][1:] != x[order][:-1]][: len(x)])
    return out


def _by_stretch(docs: np.ndarray, prints: np.ndarray, anchor: np.ndarray, body: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order by anchor, body, document, print and start: as ``lexsort`` gives, with faster sorts of single keys."""
    key = _ranks(_ranks(anchor) << U64(32) | _ranks(body)) << U64(32) | _ranks(docs)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    tied = order[again]
    order[again] = tied[np.lexsort((start[tied], prints[tied], key[again]))]
    return order


def _compared(docs, prints, anchor, body, start, strings, parts: int) -> list[pd.DataFrame]:
    """Sure: stretches of all but the smallest document. Open: one of each, where an anchor has several. Packed by part.

    ``further`` is how many other places of an open stretch its smallest document has, ``further_prints`` and
    ``further_starts`` are where they are. Sure stretches have no anchor.
    """
    order = _by_stretch(docs, prints, anchor, body, start)
    docs, prints, anchor, body, start, strings = (x[order] for x in (docs, prints, anchor, body, start, strings))
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
    new_body = new_anchor | np.r_[True, body[1:] != body[:-1]][: len(anchor)]
    head = np.flatnonzero(new_body)
    group = np.cumsum(new_body) - 1
    sure = docs > docs[head][group]
    which = np.cumsum(new_anchor) - 1
    bodies = np.bincount(which[head])[which]
    least = np.minimum.reduceat(docs, np.flatnonzero(new_anchor))[which]
    most = np.maximum.reduceat(docs, np.flatnonzero(new_anchor))[which]
    open_ = new_body & (bodies > 1) & (least != most)
    again = ~new_body & np.r_[False, (docs[1:] == docs[:-1]) & (prints[1:] == prints[:-1]) & (start[1:] == start[:-1])][: len(docs)]
    # The smallest document of an anchor loses nothing, so its further places need no answer.
    further = np.flatnonzero(~new_body & ~again & ~sure & (bodies > 1) & (docs > least))
    n_further = np.bincount(group[further], minlength=len(head))
    base = np.cumsum(n_further) - n_further
    use = np.flatnonzero(sure)
    packed = _found_parts(docs[use], prints[use], start[use], strings[use], parts)
    use = np.flatnonzero(open_)
    n, first = n_further[group[use]], base[group[use]]
    values = {"anchor": anchor[use], "start": start[use], "strings": strings[use], "further": n.astype("<u4")}
    lists = {"further_prints": (prints[further], first, n), "further_starts": (start[further], first, n)}
    return [packed, as_frame(_pack_parts(docs[use], prints[use], parts, values, lists))]


def _join(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _gather_open(frame: pd.DataFrame) -> pd.DataFrame:
    """The open stretches of each document of a part."""
    kinds = {"anchor": "<u8", "start": "<u4", "strings": "<u1", "further": "<u4"}
    docs, prints, *columns = unpack(frame, kinds)
    order, cut = _by_document(docs, prints)
    first = order[cut[:-1]]
    out = {"doc": docs[first], "print": prints[first]}
    out |= {c: cut_up(v[order], cut) for c, v in zip(kinds, columns)}
    n = columns[-1].astype(np.int64)
    place = ranges((np.cumsum(n) - n)[order], n[order])
    bounds = np.r_[0, np.cumsum(n[order])][cut]
    out["further_prints"] = cut_up(_join(frame["further_prints"], "<i8")[place], bounds)
    out["further_starts"] = cut_up(_join(frame["further_starts"], "<u4")[place], bounds)
    return as_frame(out)


_CONTEXT = ("anchor", "start", "strings", "further", "bytes", "further_prints", "further_starts")


def _contexts(buckets: int, size: int = 8_000_000) -> Callable:
    """The bytes of the open stretches by bucket. What belongs to about ``size`` of them is packed together."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        ids, prints, owner, h, start, strings, further, raw, other_prints, other_starts = (np.concatenate(c) for c in zip(*held))
        size, many = strings.astype(np.int64) - 1 + SPAN, further.astype(np.int64)
        values = {"anchor": h, "start": start, "strings": strings, "further": further}
        first = np.cumsum(many) - many
        lists = {
            "bytes": (raw, np.cumsum(size) - size, size),
            "further_prints": (other_prints, first, many),
            "further_starts": (other_starts, first, many),
        }
        return as_batch(pack_by_bucket(below(mix(h, 9), buckets), owner, ids, prints, values, lists), packed_schema(*_CONTEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, n_bytes = [], 0, 0
        for whole in batches:
            for s, e in runs_of(whole.column(2)):
                batch = whole.slice(s, e - s)
                data, offsets = utf8(batch.column(2))
                column = dict(zip(_OPEN, (batch.column(i).to_pylist() for i in range(3, 9))))
                anchors_, start, strings, further = (_join(column[c], k) for c, k in zip(_OPEN, ("<u8", "<u4", "<u1", "<u4")))
                owner = np.repeat(np.arange(len(batch)), [len(b) // 8 for b in column["anchor"]])
                raw = data[ranges(offsets[owner] + start, strings.astype(np.int64) - 1 + SPAN)]
                others = _join(column["further_prints"], "<i8"), _join(column["further_starts"], "<u4")
                ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                held.append((ids, prints, owner + docs, anchors_, start, strings, further, raw, *others))
                docs, n_bytes = docs + len(batch), n_bytes + len(raw) + 12 * len(others[0])
                if n_bytes >= size:
                    yield packed(held)
                    held, docs, n_bytes = [], 0, 0
        if held:
            yield packed(held)

    return run


class Suffixes:
    """Suffixes of one byte array, compared over their first ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int = SPAN):
        self.data, self.length = data, length
        self.prefix = prefix_hash(data)
        self.inverse = inverse_powers(len(self.prefix))
        self.bytes = np.r_[data, np.zeros(1, np.uint8)]

    def hashes(self, x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hash of the n bytes from each x."""
        return (self.prefix[x + n] - self.prefix[x]) * self.inverse[x]

    def extension(self, x: np.ndarray, y: np.ndarray, least: int = 0) -> np.ndarray:
        """How many leading bytes agree, up to the length, by binary search. So many are known to agree."""
        low, high = np.full(len(x), least), np.full(len(x), self.length)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = self.hashes(x, mid) == self.hashes(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)

    def twins(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Places in ``at`` whose hash over the whole length another suffix of the segment has too."""
        key = mix(self.hashes(at, self.length) ^ mix(segment.astype(np.uint64), 15), 16)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        return np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(at) > 1 else np.empty(0, np.int64)

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray, least: int) -> np.ndarray:
        """Whether x is smaller than y. Their first ``least`` bytes agree."""
        out = or_equal.copy()
        other = np.flatnonzero(self.hashes(x, self.length) != self.hashes(y, self.length))
        x, y = x[other], y[other]
        n = np.minimum(self.extension(x, y, least), self.length - 1)
        out[other] = self.bytes[x + n] < self.bytes[y + n]
        return out

    def heads(self, at: np.ndarray) -> tuple[np.ndarray, int]:
        """The first eight bytes, or as many as the length has, as a number that sorts as they do."""
        n = min(8, self.length)
        out = np.zeros(len(at), np.uint64)
        for i in range(n):
            out = out << U64(8) | self.data[at + i]
        return out, n

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes by segment (ascending already) and content. One of those with equal hashes is compared for all."""
        whole = self.hashes(at, self.length)
        order = np.lexsort((whole, segment))
        new = (segment[order][1:] != segment[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        bounds = np.r_[np.flatnonzero(np.r_[True, new][: len(at)]), len(at)]
        one = order[bounds[:-1]]
        by = self.sort_different(at[one], segment[one])
        return order[ranges(bounds[:-1][by], np.diff(bounds)[by])]

    def sort_different(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """``sort`` by the first bytes, then by a mergesort of all suffixes at once that agree in them."""
        head, least = self.heads(at)
        bounds, _ = runs_of_equal(segment)
        order = np.lexsort((head, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        alike = (segment[order][1:] == segment[order][:-1]) & (head[order][1:] == head[order][:-1])
        bounds = np.r_[np.flatnonzero(np.r_[True, ~alike][: len(at)]), len(at)]
        sizes = np.diff(bounds)
        base = np.repeat(bounds[:-1], sizes)
        end = np.repeat(bounds[1:], sizes)
        width = 1
        while width < sizes.max(initial=0):
            i = np.flatnonzero(end - base > width)  # runs of suffixes that still have parts to merge
            local = i - base[i]
            pair = base[i] + local // (2 * width) * 2 * width
            middle = np.minimum(pair + width, end[i])
            stop = np.minimum(pair + 2 * width, end[i])
            is_left = i < middle
            low = np.where(is_left, middle, pair)
            high = np.where(is_left, stop, middle)
            first = low.copy()
            mine = at[order[i]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                other = at[order[mid]]
                # A left element passes right ones that are smaller, a right element left ones that are not larger.
                passes = self.less(other, mine[open_], ~is_left[open_], least)
                low[open_] = np.where(passes, mid + 1, low[open_])
                high[open_] = np.where(passes, high[open_], mid)
            moved = order.copy()
            own = np.where(is_left, i - pair, i - middle)
            moved[pair + own + (low - first)] = order[i]
            order = moved
            width *= 2
        return order

    def runs(self, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted order, and the number of the run of equal strings each sorted suffix is in; runs agree in bytes."""
        order = self.sort(at, segment)
        x, seg = at[order], segment[order]
        alike = np.zeros(len(x), bool)
        whole = self.hashes(x, self.length)
        alike[1:] = (seg[1:] == seg[:-1]) & (whole[1:] == whole[:-1])
        for s in range(0, len(x) - 1, 50_000):  # collision check
            near = 1 + s + np.flatnonzero(alike[1 + s : 50_001 + s])
            span = np.arange(self.length)
            true = (self.data[x[near][:, None] + span] == self.data[x[near - 1][:, None] + span]).all(1)
            if not true.all():
                keys = [(int(g), self.data[p : p + self.length].tobytes()) for g, p in zip(seg, x)]
                names = {k: i for i, k in enumerate(dict.fromkeys(sorted(keys)))}
                run = np.array([names[k] for k in keys])
                again = np.argsort(run, kind="stable")
                return order[again], run[again]
        return order, np.cumsum(~alike) - 1


def _sort_contexts(parts: int) -> Callable:
    return lambda frame: _found_parts(*_sorted(frame), parts)


def _sorted(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of open stretches that a smaller document has too."""
    docs, prints, anchor, start, strings, further = unpack(frame, {"anchor": "<u8", "start": "<u4", "strings": "<u1", "further": "<u4"})
    n = strings.astype(np.int64)
    size = n - 1 + SPAN
    base = np.cumsum(size) - size
    row = np.argsort(anchor)
    row = np.repeat(row, n[row])
    n = n[row[np.r_[True, row[1:] != row[:-1]][: len(row)]]]
    shift = ranges(np.zeros(len(n), np.int64), n)
    segment = anchor[row]
    suffixes = Suffixes(_join(frame["bytes"], np.uint8))
    # A string whose hash is alone among those of its anchor has no equal, and need not be sorted.
    twin = suffixes.twins(base[row] + shift, segment)
    row, shift, segment = row[twin], shift[twin], segment[twin]
    who = docs[row]
    order, run = suffixes.runs(base[row] + shift, segment)
    bounds, _ = runs_of_equal(run)
    least = np.repeat(np.minimum.reduceat(who[order], bounds[:-1]), np.diff(bounds)) if len(run) else who
    hit = order[who[order] > least]
    row, shift = row[hit], shift[hit]
    n_further = further.astype(np.int64)
    n = n_further[row]
    other = ranges((np.cumsum(n_further) - n_further)[row], n)
    other_print = _join(frame["further_prints"], "<i8")[other]
    other_start = _join(frame["further_starts"], "<u4")[other] + np.repeat(shift, n)
    starts = np.r_[start[row] + shift, other_start].astype("<u4")
    return (
        np.r_[docs[row], np.repeat(docs[row], n)],
        np.r_[prints[row], other_print],
        starts,
        np.ones(len(starts), "<u1"),
    )


def _gather_spans(frame: pd.DataFrame) -> pd.DataFrame:
    """The removed runs of each document of a part."""
    docs, prints, start, strings = unpack(frame, {"start": "<u4", "strings": "<u1"})
    order, cut = _by_document(docs, prints)
    first = order[cut[:-1]]
    return as_frame({"doc": docs[first], "print": prints[first], "start": cut_up(start[order], cut), "strings": cut_up(strings[order], cut)})


def cut_out(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, start: np.ndarray, strings: np.ndarray) -> tuple:
    """What is left of each text, how many bytes were removed, and in how many runs. ``owner`` is the text of a stretch."""
    first = offsets[owner] + start
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + strings.astype(np.int64) - 1 + SPAN, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    begins = gone & ~np.r_[False, gone[:-1]][: len(gone)]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = gone[heads]
    removed = np.r_[0, np.cumsum(gone)][offsets]
    runs = np.bincount(np.searchsorted(offsets, np.flatnonzero(begins), "right") - 1, minlength=len(offsets) - 1)
    return cut_up(data[~gone], offsets - removed), np.diff(removed), runs


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first three columns are the text, and first string and number of strings of its runs; the others stay."""
    for whole in batches:
        for s, e in runs_of(whole.column(0)):
            batch = whole.slice(s, e - s)
            start, strings = ([b or b"" for b in batch.column(i).to_pylist()] for i in (1, 2))
            owner = np.repeat(np.arange(len(batch)), [len(b) for b in strings])
            kept, removed, runs = cut_out(*utf8(batch.column(0)), owner, _join(start, "<u4"), _join(strings, "<u1"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], kept, pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                names=[*batch.schema.names[3:], "kept", "n_removed", "n_spans"],
            )


def _types(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def remove_repeats(docs: DataFrame, *carry: str, whole: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 of every row, and the columns in ``carry`` as
    ``_name``. Without ``whole``, ``kept`` is null for texts that nothing is compared in, and only their digest is given.
    """
    given = texts_of(docs, *[F.col(c).alias(f"_{c}") for c in carry])
    extra = [f"_{c}" for c in carry]
    keyed = given.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("print"), "text", "doc_id", *extra
    )
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    by_size = -(-total // BUCKET_BYTES)
    buckets = max(partitions(docs), by_size)
    # A document is named once in every bucket that it has an anchor in, so no more of them than there is use for.
    dealt = max(min(partitions(docs), BUCKETS), by_size)
    # Kept, so that the files of the anchors' shuffles are gone before those of the texts and of the stretches are written.
    places = keep(
        keyed.select("doc", "print", "text")
        .mapInArrow(releasing(_deal(dealt)), packed_ddl(*_DEALT))
        .groupBy("bucket")
        .applyInPandas(releasing_group(_shared(dealt)), packed_ddl("hashes"))
        .groupBy("bucket")
        .applyInPandas(releasing_group(_gather_anchors), "doc long, print long, hashes binary"),
        "repeat-places",
    )
    free_shuffles(docs.sparkSession)
    rest = F.col("hashes").isNull() & F.lit(not whole)
    texts = keep_by_key(
        keyed.repartition(buckets, "doc", "print")
        .join(places.repartition(buckets, "doc", "print"), ["doc", "print"], "left")
        .select(
            "doc",
            "print",
            F.when(~rest, F.col("text")).alias("text"),
            "hashes",
            "doc_id",
            *extra,
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(rest, F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        ),
        "repeat-texts",
        buckets,
        "doc",
        "print",
    )
    free_shuffles(docs.sparkSession)
    touched = texts.where("hashes is not null")
    found = keep(
        touched.select("doc", "print", "text", "hashes")
        .mapInArrow(releasing(_stretches(dealt)), packed_ddl(*_STRETCH))
        .groupBy("bucket")
        .applyInPandas(releasing_group(_compare(dealt)), _FOUND),
        "repeat-stretches",
    )
    free_shuffles(docs.sparkSession)
    open_ = (
        found.where("anchor is not null")
        .groupBy("bucket")
        .applyInPandas(releasing_group(_gather_open), "doc long, print long, " + ", ".join(f"{c} binary" for c in _OPEN))
    )
    contexts = (
        touched.select("doc", "print", "text")
        .dropDuplicates(["doc", "print"])
        .join(open_, ["doc", "print"])
        .select("doc", "print", "text", *_OPEN)
        .mapInArrow(releasing(_contexts(dealt)), packed_ddl(*_CONTEXT))
    )
    hits = contexts.groupBy("bucket").applyInPandas(releasing_group(_sort_contexts(dealt)), packed_ddl(*_SPANS))
    spans = (
        found.where("anchor is null")
        .select(*hits.columns)
        .union(hits)
        .groupBy("bucket")
        .applyInPandas(releasing_group(_gather_spans), "doc long, print long, start binary, strings binary")
    )
    cut = touched.join(spans, ["doc", "print"], "left").select("text", "start", "strings", "doc_id", "n_bytes", *extra)
    schema = f"{_types(cut, 'text', 'start', 'strings')}, kept binary, n_removed long, n_spans long"
    changed = cut.mapInArrow(releasing(_finish), schema).withColumn("kept_sha256", F.sha2("kept", 256))
    same = texts.where("hashes is null").select(
        "doc_id",
        "n_bytes",
        *extra,
        F.col("text").cast("binary").alias("kept"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.coalesce("digest", F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
    )
    return changed.unionByName(same)


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows with their columns; ``text`` is what is left, without the bytes of characters that were cut in two."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = {c: f"c{i}" for i, c in enumerate(others)}  # whatever signs the given names hold
    rows = remove_repeats(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for c, p in plain.items()]), *plain.values())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.decode("utf-8", "ignore") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(text, pa.string())], names=[*batch.schema.names[1:], "text"]
            )

    chosen = rows.select("kept", "doc_id", *[f"_{p}" for p in plain.values()])
    done = chosen.mapInArrow(releasing(decode), f"{_types(chosen, 'kept')}, text string")
    return done.select(*[F.col(f"_{plain[c]}" if c in plain else c).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Every 50-byte string of every text, the smallest document that has it, and the bytes that larger ones lose.
ORACLE = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
s AS (SELECT doc_id, i, raw[i:i + 49] AS part FROM (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 48)) AS i FROM d)),
least AS (SELECT part, min(doc_id) AS first_doc FROM s GROUP BY part HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT s.doc_id, s.i FROM s JOIN least USING (part) WHERE s.doc_id > first_doc),
marked AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 AS joined FROM hits),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
  GROUP BY doc_id, run
),
gone AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, octet_length(raw) + 1, NULL FROM d),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS first_byte, a - 1 AS last_byte FROM ends),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN last_byte >= first_byte THEN hex(raw[first_byte:last_byte]) ELSE '' END, '' ORDER BY first_byte) AS left_hex
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(left_hex)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
