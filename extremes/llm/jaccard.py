"""N-gram Jaccard join with token-combination prefixes (operator 9).

Two texts link when the Jaccard similarity of their word-shingle sets reaches a threshold. The exact join works in
these steps, each of which covers every row:

1. *Profiles*: shingle set size and a 128-bit name of the set (its class) for every row. Equal sets share a class, so
   exact copies are one class from here on.
2. *Token counts*: every token counts into a table of counters whose number follows the input's size, within fixed
   bounds. Its logarithmic levels give the global token order, rare first, and split tokens into a rare and a frequent
   class.
3. *First links*: classes that share two of their three min-hash tokens are compared, exactly, with the smallest class
   of their group. This ties the bulk of each group of near copies together; it only saves work later.
4. *Prefixes*: a set of n tokens may miss ``d = n - ceil(t n)`` tokens of a partner. With r rare tokens in it, its
   prefix is its first d + 1 tokens when r > d, indexed one by one. Otherwise the r rare tokens are indexed one by one,
   and of the frequent ones either the next d + 2 - r by *pairs* (sets of up to PAIR_SIZE tokens) or the next d + 1 - r
   one by one (sets from t * PAIR_SIZE tokens on, so that two sets that can link always have one of the forms in
   common). A partner that shares no rare token and fewer than two of those d + 2 - r would miss more than d tokens, so
   partners always meet in some list of the index.
5. *Lists*: members of one list may link if they are not in one component already, and if sizes and set bitmaps leave
   room for the threshold. Each index bucket puts out a star over members that such pairs hold together, one row for a
   member at most. Lists of very frequent keys are dealt over parts, which meet block by block.
6. *Verification*: the components of the stars are groups that no link leaves. Each is compared exactly, in blocks of
   a bounded number of tokens; a pair that is joined already is not compared again, and a block puts out only the links
   that join something. The components of all links are formed.

The index travels as packed arrays, one row for each task and index bucket, so that Spark shuffles few large rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .connected import components
from .shingles import mix, set_name, shingle_set

#: Counters: one for SKETCH_BYTES bytes of input, at least and at most 2 to the power of these.
SKETCH_BYTES, LEAST_BITS, MOST_BITS = 256, 16, 24
SKETCH_PARTS = 64
#: Postings that a task holds before it puts them out.
FLUSH_POSTINGS = 1_000_000
#: Postings of an index bucket, about, and members of a part of the list of a very frequent key.
BUCKET_POSTINGS = 1_000_000
LIST_PART = 50_000
#: Largest set whose frequent tokens are indexed by pairs; it has (d + 2)(d + 1) / 2 of them at most.
PAIR_SIZE = 256
#: Tokens of the sets of one side of a block that is compared exactly (8 bytes each).
BLOCK_TOKENS = 2_000_000
#: Tokens of the sets that meet their group's smallest class in one task.
FIRST_TOKENS = 100_000
_SEEDS = mix(np.arange(77, 80, dtype=np.uint64)) | np.uint64(1)
_PAIR = mix(np.arange(90, 92, dtype=np.uint64)) | np.uint64(1)
#: Bits of a set's bitmap, at least; a larger set has the least power of two from twice its size on. Every token flips a
#: bit, so two sets differ in as many tokens as bits, at least.
BITMAP_BITS = 1024


def _slot(tokens: np.ndarray, n_slots: int) -> np.ndarray:
    return (tokens >> np.uint64(65 - n_slots.bit_length())).astype(np.int64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = max(BITMAP_BITS, 1 << (2 * len(tokens) - 1).bit_length())
    at = ((tokens * _PAIR[0]) >> np.uint64(32)) & np.uint64(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Bitmaps:
    """Bitmaps of several sets. Halves of a longer one, folded on each other, are the bitmap of half its length."""

    def __init__(self, bits: list[np.ndarray]):
        self.kind = np.array([(len(x) * 64 // BITMAP_BITS).bit_length() - 1 for x in bits], np.int64)
        self.place = np.zeros((int(self.kind.max(initial=0)) + 1, len(bits)), np.int32)
        self.rows = []
        for kind in range(len(self.place)):  # sets of this length and of the next
            own = np.flatnonzero((self.kind == kind) | (self.kind == kind + 1))
            self.place[kind, own] = np.arange(len(own))
            words = BITMAP_BITS // 64 << kind
            self.rows.append(np.stack([bits[i] if self.kind[i] == kind else bits[i][:words] ^ bits[i][words:] for i in own]) if len(own) else np.empty((0, words), np.uint64))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many tokens sets a and b (positions; sizes differ by less than half) differ at least."""
        out, kinds = np.zeros(len(a), np.int64), np.minimum(self.kind[a], self.kind[b])
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            for part in np.array_split(at, max(1, len(at) << kind >> 18)):
                x, y = self.rows[kind][self.place[kind, a[part]]], self.rows[kind][self.place[kind, b[part]]]
                out[part] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return out


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """(slots, counts); slots are empty where all counts are given."""
    kind = np.uint8 if counts.max(initial=0) < 256 else np.int64
    used = np.flatnonzero(counts)
    if 3 * len(used) > len(counts):
        return b"", counts.astype(kind).tobytes()
    return used.astype(np.uint32).tobytes(), counts[used].astype(kind).tobytes()


PROFILE = "doc_id long, n int, cls binary, m array<long>, bits binary, part int, salt int, slots binary, counts binary"
_PROFILE_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _profiles(width: int, n_slots: int):
    names = _names(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_slots, np.uint32)
        for batch in batches:
            ids, sizes, classes, keys, bits = batch.column(0).to_pylist(), [], [], [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), width)
                sizes.append(len(tokens))
                classes.append(set_name(tokens))
                keys.append([int((tokens * s).min().astype(np.int64)) for s in _SEEDS] if len(tokens) else None)
                bits.append(bitmap(tokens).tobytes() if len(tokens) else None)
                np.add.at(counts, _slot(tokens, n_slots), 1)
            none = [None] * len(ids)
            columns = [ids, sizes, classes, keys, bits, none, none, none, none]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PROFILE_TYPES, strict=True)], names)
        size, salt = n_slots // SKETCH_PARTS, TaskContext.get().partitionId() // 256
        for part in range(SKETCH_PARTS):
            own = counts[part * size : (part + 1) * size]
            if own.any():
                packed = _pack_counts(own)
                columns = [[None], [None], [None], [None], [None], [part], [salt], [packed[0]], [packed[1]]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _PROFILE_TYPES, strict=True)], names)

    return run


def _total(group: pa.Table, size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for slots, counts in zip(group.column("slots"), group.column("counts"), strict=True):
        at, raw = np.frombuffer(slots.as_py(), np.uint32), counts.as_py()
        values = np.frombuffer(raw, np.uint8 if len(raw) == (len(at) or size) else np.int64)
        if len(at):
            total[at] += values
        else:
            total += values
    return total


def _level(count) -> np.ndarray:
    """Counts on a logarithmic scale, eight steps for each doubling."""
    return np.minimum(255, np.floor(8 * np.log2(1 + np.asarray(count, float)))).astype(np.uint8)


def _levels(sketch: DataFrame, n_slots: int) -> tuple[np.ndarray, int]:
    """The level of every slot, and the first level of the frequent class."""
    size = n_slots // SKETCH_PARTS

    def part_sums(group: pa.Table) -> pa.Table:
        slots, counts = _pack_counts(_total(group, size))
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "slots": [slots], "counts": [counts]})

    def part_levels(group: pa.Table) -> pa.Table:
        total = _total(group, size)
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "levels": [_level(total).tobytes()], "total": pa.array([int(total.sum())], pa.int64())})

    levels, total = np.zeros(n_slots, np.uint8), 0
    sums = sketch.groupBy("part", "salt").applyInArrow(part_sums, "part int, slots binary, counts binary")  # of 256 tasks at most
    # SKETCH_PARTS rows, 2**MOST_BITS bytes in all at most
    for row in sums.groupBy("part").applyInArrow(part_levels, "part int, levels binary, total long").collect():
        levels[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["levels"], np.uint8)
        total += row["total"]
    return levels, int(_level(max(64, 2 * total / len(levels) + 32)))


def sketch_slots(docs: DataFrame) -> int:
    """How many counters: by the planner's estimate of the input's size, which steers speed only."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << min(MOST_BITS, max(LEAST_BITS, (size // SKETCH_BYTES).bit_length()))


def prefix_keys(tokens: np.ndarray, levels: np.ndarray, frequent: int, t_num: int, t_den: int, pair_size: int = PAIR_SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The index keys of one set, and their levels: single tokens, and pairs of frequent ones where the rare do not suffice."""
    n = len(tokens)
    missing = n - -(-t_num * n // t_den)
    level = levels[_slot(tokens, len(levels))]
    order = np.lexsort((tokens, level))
    rare = int((level < frequent).sum())
    single = order[: missing + 1] if rare > missing or n * t_den >= pair_size * t_num else order[:rare]
    keys, own = [tokens[single]], [level[single]]
    if rare <= missing and n <= pair_size:
        often = order[rare : missing + 2]
        first, second = np.triu_indices(len(often), 1)
        keys.append(mix(tokens[often[first]] * _PAIR[0] + tokens[often[second]] * _PAIR[1]))
        own.append(level[often[first]])  # the order is by level: the first is the rarer
    return np.concatenate(keys), np.concatenate(own)


def list_parts(level: np.ndarray, frequent: int, list_part: int) -> np.ndarray:
    """Over how many parts the list of a key is dealt, by the count that its level stands for."""
    return np.where(level < frequent, 1, np.ceil(2.0 ** ((level.astype(float) + 1) / 8) / list_part)).astype(np.int64)


INDEX = "bucket int, hot long, part int, parts int, keys binary, at binary, names binary, sizes binary"
_INDEX_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _index(width: int, buckets: int, levels: np.ndarray, frequent: int, t_num: int, t_den: int, pair_size: int, list_part: int):
    def row(bucket: int, hot: int, part: int, parts: int, key: np.ndarray, own: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        members, at = np.unique(own, return_inverse=True)
        values = [bucket, hot, part, parts, key.tobytes(), at.astype(np.uint32).tobytes(), names[members].tobytes(), sizes[members].tobytes()]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, _INDEX_TYPES, strict=True)], _names(INDEX))

    def flush(keys: list, at_level: list, names: list, sizes: list) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        own = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, parts = mix(np.concatenate(keys)), list_parts(np.concatenate(at_level), frequent, list_part)
        names, sizes = np.frombuffer(b"".join(names), "S16"), np.array(sizes, np.uint32)
        hot = parts > 1
        if hot.any():
            h_key, h_own, h_parts = key[hot], own[hot], parts[hot]
            whole = np.frombuffer(names.tobytes(), np.uint64).reshape(-1, 2)[h_own, 0]
            part = (mix(whole) % h_parts.astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, h_key))
            h_key, h_own, h_parts, part = h_key[order], h_own[order], h_parts[order], part[order]
            cuts = np.flatnonzero((np.diff(h_key) != 0) | (np.diff(part) != 0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(h_key)], strict=True):
                yield row(-1, int(h_key[lo].astype(np.int64)), int(part[lo]), int(h_parts[lo]), np.empty(0, np.uint32), h_own[lo:hi], names, sizes)
            key, own = key[~hot], own[~hot]
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        short = key.astype(np.uint32)  # a clash of two keys only adds a candidate
        order = np.lexsort((short, bucket))
        bucket, short, own = bucket[order], short[order], own[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)], strict=True):
            if hi > lo:
                yield row(int(bucket[lo]), 0, 0, 1, short[lo:hi], own[lo:hi], names, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), width)
                name = set_name(tokens)
                if len(tokens) < 2 or name in seen:  # a set of one token has equal partners only
                    continue
                seen.add(name)
                own = (*prefix_keys(tokens, levels, frequent, t_num, t_den, pair_size), name, len(tokens))
                for column, value in zip(held, own, strict=True):
                    column.append(value)
                n += len(own[0])
                if n > FLUSH_POSTINGS:
                    yield from flush(*held)
                    held, n = ([], [], [], []), 0
        yield from flush(*held)

    return run


LISTS = "bucket int, hot long, part int, parts int, at binary, lengths binary, members array<binary>, sizes binary"


def _shared_lists(group: pa.Table) -> pa.Table:
    """Of one bucket: the lists with two different classes or more, each set of members once. Of a frequent key's part: its members."""
    tables = [np.frombuffer(x.as_py(), "S16") for x in group.column("names")]
    base = np.r_[0, np.cumsum([len(t) for t in tables])]
    names, first, place = np.unique(np.concatenate(tables), return_index=True, return_inverse=True)
    size = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("sizes")])[first]
    bucket, hot, part = (group.column(c)[0].as_py() for c in ("bucket", "hot", "part"))
    if bucket < 0:
        at, lengths = np.arange(len(names)), np.array([len(names)])
    else:
        at = np.concatenate([place[np.frombuffer(x.as_py(), np.uint32) + lo] for x, lo in zip(group.column("at"), base[:-1], strict=True)])
        key = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("keys")])
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])]
        key, at = key[fresh], at[fresh]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        several = lengths > 1
        at, lengths = at[np.repeat(several, lengths)], lengths[several]
        if len(lengths):
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            a, b = (np.add.reduceat(mix(at.astype(np.uint64) + np.uint64(k)), starts) for k in (1, 1 << 40))
            order = np.lexsort((b, a))
            same = np.r_[False, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])]
            once = np.ones(len(lengths), bool)
            once[order[same]] = False
            at, lengths = at[np.repeat(once, lengths)], lengths[once]
        used, at = np.unique(at, return_inverse=True)
        names, size = names[used], size[used]
    raw = names.tobytes()
    return pa.table({
        "bucket": pa.array([bucket], pa.int32()), "hot": pa.array([hot], pa.int64()), "part": pa.array([part], pa.int32()),
        "parts": pa.array([max(group.column("parts").to_pylist())], pa.int32()),
        "at": pa.array([at.astype(np.uint32).tobytes()], pa.binary()), "lengths": pa.array([lengths.astype(np.uint32).tobytes()], pa.binary()),
        "members": pa.array([[raw[i : i + 16] for i in range(0, len(raw), 16)]], pa.list_(pa.binary())),
        "sizes": pa.array([size.astype(np.uint32).tobytes()], pa.binary()),
    })


def label_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is tied to by edges (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def may_link(a: np.ndarray, b: np.ndarray, size: np.ndarray, bits: Bitmaps, t_num: int, t_den: int) -> np.ndarray:
    """Whether sizes and bitmaps of sets a and b (positions) leave room for the threshold."""
    low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    good = t_den * low >= t_num * high
    at = np.flatnonzero(good)
    a, b = np.broadcast_to(a, good.shape)[at], np.broadcast_to(b, good.shape)[at]
    good[at] = bits.apart(a, b) * (t_den + t_num) <= (t_den - t_num) * (size[a] + size[b])
    return good


def list_labels(at: np.ndarray, lengths: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: Bitmaps, t_num: int, t_den: int) -> np.ndarray:
    """Labels of members such that any two of one list that may link, and are not in one component, have the same label."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.empty(0, np.int64)
    if not len(lengths):
        return np.arange(len(size))
    own = comp[at]
    mixed = np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts)
    small, edges = mixed & (lengths <= 32), []
    for shift in range(1, int(lengths[small].max(initial=0))):
        chosen = small & (lengths > shift)
        span = lengths[chosen] - shift
        first = np.repeat(starts[chosen] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        a, b = at[first], at[first + shift]
        keep = comp[a] != comp[b]
        a, b = a[keep], b[keep]
        keep = may_link(a, b, size, bits, t_num, t_den)
        edges.append(np.stack([a[keep], b[keep]]))
    a, b = np.concatenate(edges, 1) if edges else np.empty((2, 0), np.int64)
    label = label_edges(len(size), a, b)
    # long lists: members outside of a list's largest component against all its members, each pair once
    asked: dict[int, list[np.ndarray]] = {}
    for lo, n in zip(starts[mixed & ~small], lengths[mixed & ~small], strict=True):
        members = at[lo : lo + n]
        kinds, inverse, counts = np.unique(comp[members], return_inverse=True, return_counts=True)
        for i in members[inverse != counts.argmax()].tolist():
            asked.setdefault(i, []).append(members)
    mark = np.zeros(len(size), bool)
    for i, lists in asked.items():
        mark[:] = False
        for members in lists:
            mark[members] = True
        others = np.flatnonzero(mark)
        others = others[(label[others] != label[i]) & (comp[others] != comp[i])]
        others = others[may_link(np.array([i]), others, size, bits, t_num, t_den)]
        if len(others):
            joined = np.unique(np.r_[label[others], label[i]])
            label[np.isin(label, joined)] = joined[0]
    return label


def _star_rows(label: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """(member, root) of every label with two members or more."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.record_batch([pa.array(nodes[at], pa.int64()), pa.array(nodes[label[at]], pa.int64())], ["a", "b"])


def _candidates(t_num: int, t_den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = np.frombuffer(b"".join(row["members"]), "S16")
                known = row["known"]
                place = np.searchsorted(names, np.frombuffer(b"".join(k["cls"] for k in known), "S16"))
                nodes, comp = np.zeros(len(names), np.int64), -1 - np.arange(len(names), dtype=np.int64)
                bits = [np.zeros(BITMAP_BITS // 64, np.uint64)] * len(names)
                nodes[place] = [k["node"] for k in known]
                for p, k in zip(place, known, strict=True):
                    bits[p] = np.frombuffer(k["bits"], np.uint64)
                told = [(p, k["comp"]) for p, k in zip(place, known, strict=True) if k["comp"] is not None]
                kinds, own = np.unique(np.array([c for _, c in told], np.int64), return_inverse=True)
                comp[[p for p, _ in told]] = own
                lost = np.ones(len(names), bool)
                lost[place] = False  # without an id a class links nothing: the component of all such
                comp[lost] = len(kinds)
                sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
                sizes[lost] = 0
                yield _star_rows(list_labels(np.frombuffer(row["at"], np.uint32).astype(np.int64), np.frombuffer(row["lengths"], np.uint32).astype(np.int64), sizes, comp, Bitmaps(bits), t_num, t_den), nodes)

    return run


def _bit_block(t_num: int, t_den: int) -> Callable[[pa.Table], pa.Table]:
    """A star over the members of a block (sides: 0 right, 1 left, 2 both) that may link across it."""

    def run(group: pa.Table) -> pa.Table:
        nodes, comp, size, side = (group.column(c).to_numpy().astype(np.int64) for c in ("node", "comp", "n", "side"))
        bits = Bitmaps([np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()])
        label, right = np.arange(len(nodes)), side != 1
        for i in np.flatnonzero(side):
            others = np.flatnonzero(right & (label != label[i]) & (comp != comp[i]))
            others = others[may_link(np.array([i]), others, size, bits, t_num, t_den)]
            if len(others):
                joined = np.unique(np.r_[label[others], label[i]])
                label[np.isin(label, joined)] = joined[0]
        return pa.Table.from_batches([_star_rows(label, nodes)])

    return run


def joining_links(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, t_num: int, t_den: int) -> list[tuple[int, int]]:
    """Links between left and right sets (sides: 0 right, 1 left, 2 both), those only that join two components so far.

    Every left set meets all right sets of other components at once: what they have in common is counted by token.
    """
    size = np.array([len(s) for s in sets], np.int64)
    offsets, tokens = np.r_[0, np.cumsum(size)], np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    starts = np.flatnonzero(np.r_[True, tokens[order][1:] != tokens[order][:-1]])
    length = np.diff(np.r_[starts, len(tokens)])
    token = np.empty(len(tokens), np.int64)
    token[order] = np.repeat(np.arange(len(starts)), length)
    label, right, found = np.unique(comp, return_inverse=True)[1], side != 1, []
    for i in np.flatnonzero(side):
        if not (right & (label != label[i])).any():
            continue
        own = token[offsets[i] : offsets[i + 1]]
        own = own[length[own] > 1]
        common = np.zeros(len(sets), np.int64)
        for part in np.array_split(own, max(1, int(length[own].sum()) // 2_000_000)):
            n = length[part]
            at = np.repeat(starts[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(part) else part
            common += np.bincount(owner[at], minlength=len(sets))
        linked = np.flatnonzero(right & (label != label[i]) & (t_den * common >= t_num * (size[i] + size - common)))
        if len(linked):
            joined, first = np.unique(label[linked], return_index=True)
            found += [(int(i), int(j)) for j in linked[first]]
            label[np.isin(label, joined)] = label[i]
    return found


def _set_block(t_num: int, t_den: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        nodes, comp, side = (group.column(c).to_numpy().astype(np.int64) for c in ("node", "comp", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        links = np.array(joining_links(sets, comp, side, t_num, t_den), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[links[:, 0]], pa.int64()), "b": pa.array(nodes[links[:, 1]], pa.int64())})

    return run


def blocks(members: DataFrame, group: list[str], weight: str, bound: int) -> DataFrame:
    """``members(group, node, comp, ...)`` with ``chunk``, ``part`` and ``side``, so that all pairs of different components meet.

    A group within ``bound`` is one block. In a larger one the members outside of its heaviest component (the left side)
    are dealt over chunks and all members (the right side) over parts; every chunk meets every part. Groups of one
    component go.
    """
    by_comp = members.groupBy(*group, "comp").agg(F.sum(weight).alias("w"))
    whole = by_comp.groupBy(*group).agg(F.sum("w").alias("total"), F.max(F.struct("w", "comp")).alias("top")).where("total > top.w")
    many = lambda x: F.ceil(x / F.lit(float(bound))).cast("int")
    whole = whole.select(*group, F.col("top.comp").alias("main"), many(F.col("total")).alias("parts"), many(F.col("total") - F.col("top.w")).alias("chunks"))
    place = lambda chunk, part, side: F.struct(chunk.cast("int").alias("chunk"), part.cast("int").alias("part"), side.cast("int").alias("side"))
    left = F.col("comp") != F.col("main")
    own_part, own_chunk = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    spread = F.concat(
        F.transform(to(F.col("chunks")), lambda c: place(c, own_part, F.lit(0))),
        F.when(left, F.transform(to(F.col("parts")), lambda p: place(own_chunk, p, F.lit(1)))).otherwise(F.expr("cast(array() AS array<struct<chunk: int, part: int, side: int>>)")),
    )
    one = F.array(place(F.lit(0), F.lit(0), F.when(left, 2).otherwise(0)))
    dealt = members.join(whole, group).withColumn("at", F.explode(F.when(F.col("parts") == 1, one).otherwise(spread)))
    return dealt.select(*members.columns, "at.*")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(node, tokens)`` of the rows of ``docs`` whose doc_id is in ``ids(node)``; equal rows of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = shingle_set(text.as_py(), width)
                name = (node, set_name(tokens))
                if len(tokens) and name not in seen:
                    seen.add(name)
                    nodes.append(node)
                    sets.append(tokens.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    wanted = docs.select("doc_id", "text").join(ids.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "node long, tokens binary")


def verify(docs: DataFrame, placed: DataFrame, key: list[str], width: int, t_num: int, t_den: int) -> DataFrame:
    """Links ``(a, b)`` that join something within each block ``key`` of ``placed(key, node, comp, side)``."""
    rows = placed.join(sets_of(docs, placed, width), "node")
    return rows.select(*key, "node", "comp", "side", "tokens").groupBy(*key).applyInArrow(_set_block(t_num, t_den), "a long, b long")


def _first_links(source: DataFrame, classes: DataFrame, width: int, t_num: int, t_den: int) -> DataFrame:
    """Links to the smallest class of each group that shares two min-hash tokens."""
    signs = classes.where("node IS NOT NULL AND n > 1").select(
        "node", "n", F.posexplode(F.array(F.xxhash64(F.expr("m[0]"), F.expr("m[1]")), F.xxhash64(F.expr("m[0]"), F.expr("m[2]")), F.xxhash64(F.expr("m[1]"), F.expr("m[2]")))).alias("slot", "sign")
    )
    leaders = signs.groupBy("slot", "sign").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1").select("slot", "sign", "leader")
    star = materialize(signs.join(leaders, ["slot", "sign"]).where("node <> leader").groupBy("leader", "node").agg(F.min("n").alias("n")), "stars")
    salts = star.groupBy("leader").agg(F.ceil(F.sum("n") / F.lit(float(FIRST_TOKENS))).cast("int").alias("salts"))
    right = star.join(salts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node", F.lit(0).alias("side"))
    left = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("node"), F.lit(1).alias("side"))
    placed = materialize(right.unionByName(left).withColumn("comp", F.col("node")), "first")
    return materialize(verify(source, placed, ["leader", "salt"], width, t_num, t_den), "links")


def jaccard_components(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), pair_size: int = PAIR_SIZE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Two documents link when ``threshold[1] * intersection >= threshold[0] * union``; ``component_id`` is the smallest
    ``doc_id`` that links reach. Null and wordless texts have 0 shingles, link with nothing and are their own component.
    Rows that share a ``doc_id`` are one node of the graph. A null ``doc_id`` links nothing: its component is that of
    its equal texts, if any, else null. Other columns are not read. An empty table gives an empty one.
    """
    t_num, t_den = threshold
    source, n_slots = docs.select("doc_id", "text"), sketch_slots(docs)
    first = materialize(source.mapInArrow(_profiles(width, n_slots), PROFILE), "profiles")
    rows = first.where("part IS NULL").select("doc_id", "n", "cls", "m", "bits")
    levels, frequent = _levels(first.where("part IS NOT NULL").select("part", "salt", "slots", "counts"), n_slots)
    classes = materialize(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("bits").alias("bits")), "classes")
    total = classes.agg(F.sum("n").alias("n"), F.count("*").alias("c")).first()
    buckets = max(16, math.ceil(((total["n"] or 0) * (1 - t_num / t_den) + total["c"]) / BUCKET_POSTINGS))

    first_links = _first_links(source, classes, width, t_num, t_den)
    known = components(first_links)

    index = source.select("text").mapInArrow(_index(width, buckets, levels, frequent, t_num, t_den, pair_size, LIST_PART), INDEX)
    lists = materialize(index.groupBy("bucket", "hot", "part").applyInArrow(_shared_lists, LISTS), "lists")
    tied = classes.where("node IS NOT NULL").join(known, "node", "left").select("cls", "node", F.col("component").alias("comp"), "n", "bits")
    place = ["bucket", "hot", "part"]
    members = lists.select(*place, F.explode("members").alias("cls")).join(tied, "cls")
    named = members.where("bucket >= 0").groupBy(*place).agg(F.collect_list(F.struct("cls", "node", "comp", "bits")).alias("known"))  # BUCKET_POSTINGS, about, at most
    stars = lists.where("bucket >= 0").join(named, place).select("at", "lengths", "members", "sizes", "known").mapInArrow(_candidates(t_num, t_den), "a long, b long")
    if not lists.where("bucket < 0").isEmpty():
        hot = members.where("bucket < 0").select("hot", "node", F.coalesce("comp", "node").alias("comp"), "n", "bits", F.lit(1).alias("one"))
        placed = blocks(hot, ["hot"], "one", LIST_PART).select("hot", "chunk", "part", "node", "comp", "n", "bits", "side")
        stars = stars.unionByName(placed.groupBy("hot", "chunk", "part").applyInArrow(_bit_block(t_num, t_den), "a long, b long"))

    groups = components(stars.distinct()).select("node", F.col("component").alias("held"))
    sizes = classes.where("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    asked = groups.join(known, "node", "left").join(sizes, "node").select("held", "node", F.coalesce("component", "node").alias("comp"), "n")
    placed = materialize(blocks(asked, ["held"], "n", BLOCK_TOKENS).drop("n"), "blocks")
    links = first_links.unionByName(verify(source, placed, ["held", "chunk", "part"], width, t_num, t_den))
    # rows that share an id tie the classes of their texts
    ends = classes.where("node IS NOT NULL").select("cls", "node")
    several = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("doc_id")
    by_id = rows.where("n > 0").join(several, "doc_id", "left_semi").join(ends, "cls").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.unionByName(by_id))
    result = classes.join(found, "node", "left").select("cls", F.coalesce("component", "node").alias("component"))
    return rows.join(result, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller ``doc_id``; all columns stay as they are.

    Rows with a null id and wordless texts stay, and so do all rows of the smallest id, repeated ones too. An empty
    table gives an empty one.
    """
    groups = jaccard_components(docs, width, threshold).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)
