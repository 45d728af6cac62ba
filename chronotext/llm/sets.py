"""Size-aware set similarity join: signatures of fixed subsets for light sets, inverted lists for heavy ones.

A text is the set of its distinct words. Two sets of n and m words have similarity >= t only if they differ in at most
d(n + m) words. The word universe is cut into G = d // 2 + 1 groups; then at least one group differs in at most one
word, so that its words on the one side are, whole or without one word, its words on the other side. Each set therefore
enumerates, for each group, the whole group and its subsets of one word less, and sets meet on equal subsets: nothing
is lost. Every set is listed so, but not every set asks everywhere: of two sets the larger asks, and a set of n words is
sure to meet its partners if its groups allow d + 1 differences in all, where a group asked in whole allows one, a group
asked with one word more or less two, and one not asked none. The groups have some to spare, so each set leaves out its
most crowded signatures. Because d grows with the sizes, the sums n + m are cut into bands, each with its own G; a set takes part in the
bands its possible partners reach. Bands of large sets may instead scan inverted lists of the rarest words (any two
similar sets share one among the first n - ceil(t n) + 1 in a fixed order). Bands, and from where on lists are
scanned, are chosen by cost from the size histogram of all rows and from a sample that shapes only the plan: groups and
word order may be any, the result is the same.

What travels is one packed block of postings per task and bucket: 3 bytes of signature and an 8-byte key made of the
parity of the word hashes (57 bits) and the size (7 bits). Two keys bound the difference of their sets from below, so
nearly all chance meetings are dropped by xor and popcount before anything is fetched; what is left is checked exactly
against the texts. Under crowded signatures, whose meetings grow as the square of their postings, a second parity of 64
bits goes along, so that chance pairs there do not outgrow the true ones.

Skew: exact copies collapse to one key inside a task and again in a bucket; signatures of more than CELL_POSTINGS
expected postings are spread over cells, as many as their number asks for: a set is listed in one and asks in all. Across
two kinds, over a grid of cells in which every pair still meets.

Across two kinds of sets (training and evaluation) only pairs of different kinds meet: the whole groups of the one with
the groups of the other, and in buckets of their own the other way round.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import draw_limit, drawn, hash_of
from chronotext.session import cut_lineage, ship_package, shuffle_partitions

#: For bytes: letters and figures stay, all else is a blank.
WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
U = np.uint64
PARITY, SIZE_BITS = 57, 7
CODE_BITS = 23
#: Sample of sets from which the plan is shaped, postings of one bucket, postings of a signature in one cell of its grid,
#: the widest grid.
SAMPLE, BUCKET_POSTINGS, CELL_POSTINGS, WIDEST = 8_000, 1_500_000, 8_000, 64
#: What a posting does beside its kind: it is listed, or also asks the whole groups of its signature, or these and the
#: subsets; or it asks without being listed. WIDE is added if a second parity goes along, as it does for signatures of
#: more than WIDE_POSTINGS expected postings. Bits of the table of crowds; most that a set leaves out.
LISTED, WHOLE, ALL, ONLY_WHOLE, ONLY_ALL = range(5)
WIDE, WIDE_POSTINGS, ASK_BITS, CROWD_BITS, LEFT_OUT = 8, 4_000, 4, 18, 6
#: Bits of a filter for each value, the most bits of a filter (16 MB); beyond, values are looked up by a join. Bits of a slice.
VALUE_BITS, MOST_BITS, SLICE_BITS = 8, 1 << 27, 1 << 20


#: What names a set (key and content hash) and bounds its difference from others (wide parity).
NAMED = ["key", "content", "low", "high"]


def words(sentence: str) -> list[str]:
    """The longest runs of a-z and 0-9 in the lower-cased sentence."""
    return sentence.lower().encode("ascii", "replace").translate(WORD_BYTES).decode("ascii").split()


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


class Vocabulary(dict):
    """Numbers words as they come, with their hashes; each worker has its own numbering."""

    MOST = 2_000_000

    def __init__(self) -> None:
        self.new: list[int] = []
        self.hashes = np.zeros(0, U)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(_hash(word))
        return n

    def grown(self) -> np.ndarray:
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.array(self.new, U)])
            self.new = []
        return self.hashes

    def bounded(self) -> None:
        if len(self) > self.MOST:
            self.clear()
            self.new, self.hashes = [], np.zeros(0, U)


@dataclass
class Sets:
    """Sets as one flat array; rows: their places in the input."""

    rows: np.ndarray
    flat: np.ndarray
    sizes: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def take(self, keep: np.ndarray) -> Sets:
        return Sets(self.rows[keep], self.flat[np.repeat(keep, self.sizes)], self.sizes[keep])


def read_sets(sentences: Iterable[str | None], least: int, vocabulary: Vocabulary) -> Sets:
    rows, flat, sizes = [], [], []
    number = vocabulary.__getitem__
    for i, s in enumerate(sentences):
        if s is None:
            continue
        w = set(words(s))
        if len(w) >= least:
            rows.append(i)
            sizes.append(len(w))
            flat.extend(map(number, w))
    return Sets(np.array(rows, np.int64), np.array(flat, np.int64), np.array(sizes, np.int64))


def keys_of(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity of the word hashes and the size (127: larger than can be told), as one 64-bit key per set."""
    if not len(sizes):
        return np.zeros(0, U)
    bits = U(1) << (mix(hashes) % U(PARITY))
    return (np.bitwise_xor.reduceat(bits, starts) << U(SIZE_BITS)) | np.minimum(sizes, 127).astype(U)


def second_parity(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parity of 64 bits by another hash than that of the keys."""
    return np.bitwise_xor.reduceat(U(1) << (mix(hashes ^ U(0x3C6EF372FE94F82B)) % U(64)), starts) if len(starts) else np.zeros(0, U)


def wide_parity(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A third parity of the word hashes, of 128 bits in two numbers, by another hash than the others."""
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, U)
    at = mix(hashes ^ U(0xA5A5A5A5DEADBEEF)) % U(128)
    bit = U(1) << (at % U(64))
    return np.bitwise_xor.reduceat(np.where(at < 64, bit, U(0)), starts), np.bitwise_xor.reduceat(np.where(at < 64, U(0), bit), starts)


def content_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits that, with the key, name the set."""
    return mix(np.add.reduceat(hashes, starts)) if len(starts) else np.zeros(0, U)


@dataclass
class Measure:
    """Jaccard similarity of at least t between sets of at least `least` words."""

    t: Fraction
    least: int

    def overlap(self, total: np.ndarray | int) -> np.ndarray | int:
        a, b = self.t.numerator, self.t.numerator + self.t.denominator
        return -(-(a * total) // b)

    def difference(self, total: np.ndarray | int) -> np.ndarray | int:
        return total - 2 * self.overlap(total)

    def holds(self, a: set, b: set) -> bool:
        o = len(a & b)
        return o * (self.t.numerator + self.t.denominator) >= self.t.numerator * (len(a) + len(b))

    def table(self) -> np.ndarray:
        """Largest difference for two size codes, -1 where sizes alone rule a pair out."""
        n = np.arange(128)
        a, b = n[:, None], n[None, :]
        out = self.difference(a + b)
        out[(np.minimum(a, b) * self.t.denominator < np.maximum(a, b) * self.t.numerator)] = -1
        out[127, :] = out[:, 127] = PARITY
        out[:127, 127][n[:127] < 127 * float(self.t) - 1] = -1
        out[127, :127] = out[:127, 127]
        return out.astype(np.int16)


@dataclass
class Band:
    """Pairs with low < n + m <= high. lists: scan inverted lists instead of group subsets."""

    low: int
    high: int
    groups: int
    lists: bool
    member: np.ndarray  # by size: takes part
    group_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))  # by place in Plan.known
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, U))  # sorted signatures that are spread over cells
    grid: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # how many rows and columns of cells
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by size: differences its groups have to allow, 0 if it need not ask
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, U))  # signatures that occur more than once in the sample
    times: np.ndarray = field(default_factory=lambda: np.zeros((2, 0), np.float32))  # as whole group, as subset
    wide: float = np.inf  # from so many times on, a second parity goes along

    def crowds(self) -> np.ndarray:
        """(2, 2^CROWD_BITS): how often signatures of these upper bits occur in the sample, whole and as subset."""
        out = np.zeros((2, 1 << CROWD_BITS), np.float32)
        for row, times in zip(out, self.times):
            np.maximum.at(row, (self.often >> U(64 - CROWD_BITS)).astype(np.int64), times)
        return out


@dataclass
class Plan:
    measure: Measure
    bands: list[Band]
    known: np.ndarray  # sorted hashes of the sample's words
    rank: np.ndarray  # their frequency in the sample
    buckets: int


def balanced_groups(flat: np.ndarray, sizes: np.ndarray, count: int, groups: int) -> np.ndarray:
    """A group for each word such that the words of a set spread evenly, by information, over the groups."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    owner, df = owner[order], np.bincount(flat, minlength=count)
    ends = np.cumsum(df)
    weight = np.log2(np.maximum(len(sizes), 2) / np.maximum(df, 1)) + 0.05
    load, out = np.zeros((len(sizes), groups)), np.arange(count) % groups
    for w in np.argsort(-df * weight, kind="stable"):
        if df[w]:
            mine = owner[ends[w] - df[w] : ends[w]]
            out[w] = g = load[mine].sum(0).argmin()
            load[mine, g] += weight[w]
    return out.astype(np.int16)


def group_signatures(sets: Sets, hashes: np.ndarray, group: np.ndarray, groups: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, cell, kind) of each whole group (kind 0) and of each subset of one word less (kind 1); cell: owner * groups + group."""
    n = len(sets.sizes)
    cell = sets.owner * groups + group
    whole = np.zeros(n * groups, U)
    np.add.at(whole, cell, hashes)
    own = (np.arange(n * groups) % groups).astype(U) * U(0x9E3779B97F4A7C15) + U(salt)
    return (
        np.concatenate([mix(whole ^ own), mix((whole[cell] - hashes) ^ own[cell])]),
        np.concatenate([np.arange(n * groups), cell]),
        np.repeat(np.array([0, 1], np.int8), [n * groups, len(hashes)]),
    )


def list_signatures(sets: Sets, hashes: np.ndarray, rank: np.ndarray, measure: Measure, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest words of each set, as many as any similar set must share one of."""
    owner = sets.owner
    order = np.lexsort((hashes, rank, owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sets.sizes) - sets.sizes, sets.sizes)
    need = sets.sizes + (-sets.sizes * measure.t.numerator) // measure.t.denominator + 1
    first = order[place < need[owner]]
    return mix(hashes[first] ^ U(salt)), owner[first], np.zeros(len(first), np.int8)


def signatures(sets: Sets, hashes: np.ndarray, plan: Plan, place: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, owner, kind, cell). hashes, place: of each word of `sets`; place: in plan.known, -1 if not there."""
    b, salt = plan.bands[band], 0x5851F42D4C957F2D * (band + 1) & (2**64 - 1)
    if b.lists:
        s, owner, kind = list_signatures(sets, hashes, np.where(place < 0, 0, plan.rank[place]), plan.measure, salt)
        return s, owner, kind, owner
    group = np.where(place < 0, (hashes % U(b.groups)).astype(np.int64), b.group_of[place])
    s, cell, kind = group_signatures(sets, hashes, group, b.groups, salt)
    return s, cell // b.groups, kind, cell


def places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def make_plan(measure: Measure, histogram: dict[int, int], sample: list[str], fixed_buckets: int) -> Plan:
    """Bands, groups and the use of lists by the cost they would have, measured on the sample."""
    vocabulary = Vocabulary()
    sets = read_sets(sample, measure.least, vocabulary)
    hashes = vocabulary.grown()
    order = np.argsort(hashes)
    known, df = hashes[order], np.bincount(sets.flat, minlength=len(hashes))[order]
    sizes = np.array(sorted(n for n in histogram if n >= measure.least), np.int64)
    if not len(sizes):
        return Plan(measure, [], known, df, 1)
    if not len(known):  # no word is known; all are grouped by their hash
        known, df, hashes = np.zeros(1, U), np.zeros(1, np.int64), np.zeros(1, U)
    sampled = max(1, len(sets.sizes))
    counts = np.array([histogram[n] for n in sizes], float)
    fits = np.minimum.outer(sizes, sizes) * measure.t.denominator >= np.maximum.outer(sizes, sizes) * measure.t.numerator
    total = np.add.outer(sizes, sizes)
    d = measure.difference(np.arange(total.max() + 1))
    edges = [int(total[fits].min()) - 1]
    top = int(total[fits].max())
    reach = np.maximum.accumulate(d)
    steps = [t for t in range(edges[0] + 1, top) if reach[t + 1] // 2 > reach[t] // 2]
    edges += steps[:: max(1, len(steps) // 12)]
    edges = sorted({*edges, top})
    here = places(known, hashes)
    flat_hash, flat_place = hashes[sets.flat], here[sets.flat]
    scale = (counts.sum() / sampled) ** 2
    trial: dict[int, tuple[np.ndarray, float]] = {}

    def groups_for(g: int) -> tuple[np.ndarray, float]:
        if g not in trial:
            groups = balanced_groups(flat_place, sets.sizes, len(known), g)
            s, _, kind = group_signatures(sets, flat_hash, groups[flat_place], g, 1)
            u, inv = np.unique(s, return_inverse=True)
            full, less = np.bincount(inv[kind == 0], minlength=len(u)).astype(float), np.bincount(inv[kind == 1], minlength=len(u))
            trial[g] = groups, float((full * (full - 1) / 2 + full * less).sum())
        return trial[g]

    s, _, _ = list_signatures(sets, flat_hash, df[flat_place], measure, 1)
    c = np.unique(s, return_counts=True)[1].astype(float)
    list_pairs = float((c * (c - 1) / 2).sum())
    POSTING, PAIR = 0.6e-6, 6e-9

    def cost(low: int, high: int) -> tuple[float, Band]:
        member = np.zeros(int(sizes.max()) + 1, bool)
        member[sizes[(fits & (total > low) & (total <= high)).any(1)]] = True
        mine = counts * member[sizes]
        share = (mine.sum() / counts.sum()) ** 2
        g = int(d[low + 1 : high + 1].max() // 2 + 1)
        by_groups = (mine * (sizes + g)).sum() * POSTING + groups_for(g)[1] * share * scale * PAIR
        by_lists = (mine * (sizes * (1 - float(measure.t)) + 1)).sum() * POSTING + list_pairs * share * scale * PAIR
        return min((by_groups, False), (by_lists, True))[0], Band(low, high, g, by_lists < by_groups, member)

    best: dict[int, tuple[float, list[Band]]] = {edges[0]: (0.0, [])}
    for j in range(1, len(edges)):
        options = []
        for i in range(j):
            c_, band = cost(edges[i], edges[j])
            options.append((best[edges[i]][0] + c_, best[edges[i]][1] + [band]))
        best[edges[j]] = min(options, key=lambda x: x[0])
    bands = best[edges[-1]][1]
    plan = Plan(measure, bands, known, df, fixed_buckets)
    asks = (sizes[None, :] <= sizes[:, None]) | (sizes[:, None] >= 127)  # keys don't tell sizes from 127 on apart
    postings = 0.0
    for i, b in enumerate(bands):
        b.group_of = groups_for(b.groups)[0]
        keep = b.member[np.minimum(sets.sizes, len(b.member) - 1)]
        s, _, kind, _ = signatures(part := sets.take(keep), hashes[part.flat], plan, here[part.flat], i)
        u, c = np.unique(s, return_counts=True)
        expected = c * counts.sum() / sampled
        often = (c >= 8) & (expected > 2 * CELL_POSTINGS)
        b.hot, b.grid = u[often], np.minimum(WIDEST, -(-expected[often] // CELL_POSTINGS)).astype(np.int64)
        b.need = np.zeros(len(b.member), np.int64)
        b.need[sizes] = np.where(fits & asks & (total > b.low) & (total <= b.high), d[total] + 1, 0).max(1)
        b.wide = WIDE_POSTINGS * sampled / counts.sum()
        b.often, at = u[c > 1], np.flatnonzero(c > 1)
        b.times = np.stack([np.bincount(np.searchsorted(u, s[kind == k]), minlength=len(u))[at] for k in (0, 1)]).astype(np.float32)
        postings += len(s) * counts.sum() / sampled
    plan.buckets = max(fixed_buckets, int(postings / BUCKET_POSTINGS) + 1)
    return plan


def cells(keys: np.ndarray, grid: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, cell): each key of a frequent signature goes to `grid` cells: those of role 0 to a row of cells and those
    of role 1 to a column, so that any two across meet.
    """
    at = np.repeat(np.arange(len(keys)), grid)
    other = np.arange(len(at)) - np.repeat(np.cumsum(grid) - grid, grid)
    mine = (mix(keys[at]) % np.maximum(grid[at], 1).astype(U)).astype(np.int64)
    return at, np.where(role[at] == 0, mine * WIDEST + other, other * WIDEST + mine)


def listed_and_asking(keys: np.ndarray, kind: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, cell, kind): each key of a frequent signature is listed in one of `grid` cells, and asks, if it does, in all."""
    asks = (kind >> 1) & (WIDE - 1)
    asking = np.flatnonzero(asks)
    at = np.repeat(asking, grid[asking])
    every = np.arange(len(at)) - np.repeat(np.cumsum(grid[asking]) - grid[asking], grid[asking])
    own = (mix(keys) % np.maximum(grid, 1).astype(U)).astype(np.int64)
    return np.r_[np.arange(len(keys)), at], np.r_[own, every], np.r_[kind - (asks << 1), kind[at] + ((ONLY_WHOLE - WHOLE) << 1)]


def spread_hot(sig: np.ndarray, key: np.ndarray, kind: np.ndarray, band: Band, across: bool, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings with those of frequent signatures spread over cells."""
    if not len(band.hot):
        return sig, key, kind, *others
    place = places(band.hot, sig)
    hot = place >= 0
    if across:
        at, cell = cells(key[hot], band.grid[place[hot]], kind[hot])
        more = kind[hot][at]
    else:
        at, cell, more = listed_and_asking(key[hot], kind[hot], band.grid[place[hot]])
    return (
        np.concatenate([sig[~hot], mix(sig[hot][at] + cell.astype(U))]),
        np.concatenate([key[~hot], key[hot][at]]),
        np.concatenate([kind[~hot], more]),
        *(np.concatenate([x[~hot], x[hot][at]]) for x in others),
    )


def pack(sig: np.ndarray, keys: np.ndarray, kind: np.ndarray, buckets: int, first: int = 0, second: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Blocks by bucket, numbered from `first`: sorted codes (asks, signature bits, kind) as deltas, the keys, second parities.

    kind: in its lowest bit; above it, what the posting asks, and WIDE if its second parity goes along.
    """
    bucket = (sig % U(buckets)).astype(np.int64)
    code = ((kind.astype(np.int64) >> 1) << (CODE_BITS + 1)) | ((sig >> U(64 - CODE_BITS)).astype(np.int64) << 1) | (kind & 1)
    order = np.argsort((bucket << (CODE_BITS + 1 + ASK_BITS)) | code)
    bucket, code, keys = bucket[order], code[order], keys[order]
    second = np.zeros(len(code), U) if second is None else second[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        deltas = np.diff(code[a:b], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        small = zlib.compress(deltas, 1)
        wide = a + int(np.searchsorted(code[a:b], WIDE << (CODE_BITS + 1)))
        yield first + int(bucket[a]), len(small).to_bytes(4, "little") + small + keys[a:b].astype("<u8").tobytes() + second[wide:b].astype("<u8").tobytes()


def opened(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, keys, second parities, 0 where none goes along)."""
    n = int.from_bytes(block[:4], "little")
    planes = np.frombuffer(zlib.decompress(block[4 : 4 + n]), np.uint8).reshape(4, -1)
    code = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
    rest = np.frombuffer(block, "<u8", offset=4 + n)
    return code, rest[: len(code)], np.r_[np.zeros(2 * len(code) - len(rest), U), rest[len(code) :]]


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    return opened(block)[:2]


def place_in_order(code: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sorts by signature and kind, then by size, by the upper bits of the parity and by what is asked."""
    asks, sig = code >> (CODE_BITS + 1), code & ((1 << (CODE_BITS + 1)) - 1)
    return (sig.astype(U) << U(40)) | ((key & U(127)) << U(33)) | ((key >> U(SIZE_BITS + 24 + ASK_BITS)) << U(ASK_BITS)) | asks.astype(U)


def in_order(code: np.ndarray, key: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(codes, keys, keys that occur twice under one code, others), sorted by place_in_order, repeats dropped."""
    order = np.argsort(place_in_order(code, key))
    code, key = code[order], key[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (key[1:] != key[:-1])] if len(code) else np.zeros(0, bool)
    return code[new], key[new], np.unique(key[~new]), *(x[order][new] for x in others)


def meetings(code: np.ndarray, key: np.ndarray, limit: np.ndarray, cross: bool, second: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys that share a signature and may be similar, smaller key first; if cross, of kind 0 with kind 1.

    Each posting that asks meets those listed that are not larger, by place_in_order. code, key: as in_order gives them.
    """
    if cross:
        run = code >> 1
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(run)]
        zeros = np.add.reduceat(1 - (code & 1), starts) if len(starts) else np.zeros(0, np.int64)
        asking = np.flatnonzero(~code & 1)
        own = np.repeat(np.arange(len(starts)), zeros)
        for i, j in compared(asking, (starts + zeros)[own], ends[own], key, key, limit):
            yield key[i], key[j]
        return
    wide, what = np.divmod(code >> (CODE_BITS + 1), WIDE)
    run = (code >> 1) & ((1 << CODE_BITS) - 1)
    second = np.zeros(len(key), U) if second is None else second
    # postings that are alone under their signature meet none
    same = run[1:] == run[:-1]
    held = np.r_[False, same] | np.r_[same, False] if len(run) else np.zeros(0, bool)
    code, key, what, run, second, wide = (x[held] for x in (code, key, what, run, second, wide == 1))
    listed = what < ONLY_WHOLE
    order, to = place_in_order(code & ((1 << (CODE_BITS + 1)) - 1), key)[listed], key[listed]
    second_to, wide_to = second[listed], wide[listed]
    for kind, asking in ((0, what > LISTED), (1, ((what == ALL) | (what == ONLY_ALL)) & (code & 1 == 0))):
        at = np.flatnonzero(asking)
        target = (run[at] << 1) | kind
        begin = np.searchsorted(order, target.astype(U) << U(40))
        end = np.searchsorted(order, place_in_order(target, key[at]) | U((1 << ASK_BITS) - 1), "right")
        for i, j in compared(at, begin, end, key, to, limit):
            a, b = key[i], to[j]
            most = limit[(a & U(127)).astype(np.int64), (b & U(127)).astype(np.int64)]
            far = np.where(wide[i] & wide_to[j] & (most < PARITY), np.bitwise_count(second[i] ^ second_to[j]), 0)
            ok = (far <= most) & (a != b)
            yield np.minimum(a, b)[ok], np.maximum(a, b)[ok]


def compared(at: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray, to: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): key[i], of places `at`, with to[j] of begin:end, as far as parities and sizes allow; those of equal `begin` follow each other."""
    one, two, most = key >> U(SIZE_BITS), to >> U(SIZE_BITS), int(limit.max())
    count = end - begin
    at, begin, end, count = (x[count > 0] for x in (at, begin, end, count))

    def check(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = key[i], to[j]
        ok = np.bitwise_count((a ^ b) >> U(SIZE_BITS)) <= limit[(a & U(127)).astype(np.int64), (b & U(127)).astype(np.int64)]
        return i[ok], j[ok]

    starts = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]]) if len(begin) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(begin)]
    total = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, np.int64)
    long = (total > 8_192) & (total > 256 * (ends - starts))
    few = ~np.repeat(long, ends - starts)
    # few in a run: each with each, by places
    first, start, count = at[few], begin[few], count[few]
    upto, n = np.cumsum(count), 0
    while n < len(first):
        to_n = max(n + 1, int(np.searchsorted(upto, (upto[n - 1] if n else 0) + 100_000, "right")))
        c = count[n:to_n]
        i = np.repeat(first[n:to_n], c)
        j = np.repeat(start[n:to_n], c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c))
        near = np.flatnonzero(np.bitwise_count(one[i] ^ two[j]) <= most)
        yield check(i[near], j[near])
        n = to_n
    # long runs: blocks of the matrix, that fit into the cache
    for a, e in zip(starts[long], ends[long]):
        for x in range(a, e, 32):
            mine = at[x : min(x + 32, e)]
            last = int(end[x : min(x + 32, e)].max())
            for u in range(int(begin[a]), last, 4096):
                v = min(u + 4096, last)
                near = np.flatnonzero(np.bitwise_count(one[mine][:, None] ^ two[None, u:v]) <= most)
                if len(near):
                    yield check(mine[near // (v - u)], near % (v - u) + u)


def size_histogram(rows: DataFrame, text: str, least: int) -> dict[int, int]:
    """Rows by number of distinct words (at most as many entries as there are sizes), over all rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            for s in b.column(0).to_pylist():
                if s is not None:
                    n = len(set(words(s)))
                    total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["n", "c"])

    counted = rows.select(text).mapInArrow(count, "n int, c long").filter(F.col("n") >= least)
    return {r["n"]: r["c"] for r in counted.groupBy("n").agg(F.sum("c").alias("c")).collect()}


def plan_for(rows: DataFrame, id_: str, text: str, measure: Measure) -> tuple[Plan, list[str], int]:
    """(plan, sample of texts, rows with enough words). The sample is drawn from rows with enough words, by hash in the scan."""
    ship_package(rows.sparkSession)
    histogram = size_histogram(rows, text, measure.least)
    total = sum(histogram.values())

    def long_enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([s is not None and len(set(words(s))) >= measure.least for s in b.column(text).to_pylist()], pa.bool_()))

    few = rows.select(id_, text).filter(hash_of([id_, text]) <= draw_limit(SAMPLE, total))
    sample = [r[0] for r in drawn(few.mapInArrow(long_enough, few.schema), [text], [id_, text], SAMPLE)]
    return make_plan(measure, histogram, sample, shuffle_partitions(rows.sparkSession)), sample, total


def blocks_of(parts: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    out = list(parts)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "block"])


def chunked(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[list[list]]:
    """The columns of `block` rows at a time."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        held = [h + c for h, c in zip(held, columns)] if held else columns
        while len(held[0]) >= block:
            yield [h[:block] for h in held]
            held = [h[block:] for h in held]
    if held and held[0]:
        yield held


def band_postings(sets: Sets, hashes: np.ndarray, keys: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, signatures, places in `sets`, kinds, cells) of each band."""
    known = places(plan.known, hashes)
    for b, band in enumerate(plan.bands):
        keep = (sets.sizes < len(band.member)) & band.member[np.minimum(sets.sizes, len(band.member) - 1)]
        part = sets.take(keep)
        s, owner, k, cell = signatures(part, hashes[part.flat], plan, known[part.flat], b)
        yield b, s, np.flatnonzero(keep)[owner], k, cell


def asked(s: np.ndarray, cell: np.ndarray, sizes: np.ndarray, band: Band, crowds: np.ndarray) -> np.ndarray:
    """What each posting of the sets asks, by what costs least in the sample.

    A partner is missed only if it differs in one word of each group asked in whole and in two of each asked with its
    subsets. What is left out keeps the sum of these above the largest difference that a partner may have.
    """
    g, n = band.groups, len(sizes)
    need = band.need[sizes]
    at = (s >> U(64 - CROWD_BITS)).astype(np.int64)
    whole = crowds[0][at]
    less = np.bincount(cell[n * g :], weights=whole[n * g :], minlength=n * g).reshape(n, g)
    exact = whole[: n * g].reshape(n, g) + 0.02
    near = exact + crowds[1][at[: n * g]].reshape(n, g) + less + 0.04
    spare = np.where(need > 0, np.minimum(2 * g - need, LEFT_OUT), 0)
    most = int(spare.max(initial=0))
    # cost[k]: of the groups from here on, if k of what they allow may be left out
    cost, best = np.zeros((most + 1, n)), np.zeros((g, most + 1, n), np.int8)
    for i in range(g - 1, -1, -1):
        now = near[:, i] + cost
        for left, price in ((1, exact[:, i]), (2, 0.0)):
            for k in range(left, most + 1):
                other = price + cost[k - left]
                better = other < now[k]
                now[k] = np.where(better, other, now[k])
                best[i, k][better] = left
        cost = now
    asks = np.zeros((n, g), np.int8)
    for i in range(g):
        left = best[i, spare, np.arange(n)]
        asks[:, i] = ALL - left
        spare = spare - left
    asks[need == 0] = LISTED
    asks = asks.ravel()
    return np.concatenate([asks, np.where(asks[cell[n * g :]] == ALL, WHOLE, LISTED)])


def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    empty = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
    return tuple(np.concatenate(p) for p in zip(empty, *parts))


def postings(batches: Iterable[pa.RecordBatch], plan: Plan, block: int = 16_384) -> Iterator[pa.RecordBatch]:
    """One row (bucket, block) per task, chunk and bucket from rows of (text)."""
    vocabulary, crowds = Vocabulary(), [b.crowds() for b in plan.bands]
    crowded = [c.sum(0) >= b.wide for b, c in zip(plan.bands, crowds)]
    for (texts,) in chunked(batches, block):
        vocabulary.bounded()
        sets = read_sets(texts, plan.measure.least, vocabulary)
        hashes = vocabulary.grown()
        starts = np.cumsum(sets.sizes) - sets.sizes
        keys = keys_of(hashes[sets.flat], starts, sets.sizes)
        # up to two copies of a key say that there are copies; a third says nothing more
        by_key = np.argsort(keys, kind="stable")
        nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(np.r_[True, keys[by_key][1:] != keys[by_key][:-1]], np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
        copies = keys[by_key][nth < 2]
        single = first_of_each(keys, content_of(hashes[sets.flat], starts))
        sets, keys = sets.take(single), keys[single]
        second = second_parity(hashes[sets.flat], np.cumsum(sets.sizes) - sets.sizes)
        parts = [(mix(copies ^ U(0xC0FFEE)), copies, np.zeros(len(copies), np.int64), np.zeros(len(copies), U))]
        for b, s, at, k, cell in band_postings(sets, hashes, keys, plan):
            asks = WHOLE if plan.bands[b].lists else asked(s, cell, sets.sizes[at[: int((k == 0).sum()) : plan.bands[b].groups]], plan.bands[b], crowds[b])
            wide = crowded[b][s >> U(64 - CROWD_BITS)]
            parts.append(spread_hot(s, keys[at], k | ((asks + WIDE * wide) << 1), plan.bands[b], False, second[at]))
        sig, key, kind, second = (np.concatenate(p) for p in zip(*parts))
        yield blocks_of(pack(sig, key, kind, plan.buckets, 0, second))


def first_of_each(keys: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """A mask of the first of all rows that agree in keys and others."""
    single = np.zeros(len(keys), bool)
    if len(keys):
        single[np.unique(np.stack([keys, *others]), axis=1, return_index=True)[1]] = True
    return single


def across_postings(sets: Sets, hashes: np.ndarray, keys: np.ndarray, kind: np.ndarray, plan: Plan) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Postings (signature, key, role) of sets of kind 0 and 1, so that sets of different kinds meet, role 0 with 1.

    First: whole groups of kind 0 with whole groups and subsets of kind 1. Second: whole groups of kind 1 with subsets of kind 0.
    """
    one, two = [], []
    for b, s, at, less, _ in band_postings(sets, hashes, keys, plan):
        band, key, k = plan.bands[b], keys[at], kind[at]
        use = (k == 1) | (less == 0)
        one.append(spread_hot(s[use], key[use], k[use], band, True))
        use = (less == 1 - k) & (not band.lists)
        two.append(spread_hot(s[use], key[use], 1 - k[use], band, True))
    return joined(one), joined(two)


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, codes, keys, second parities): all postings of each bucket, from rows (bucket, block) sorted by bucket."""
    now, held = -1, []

    def whole() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return now, *(np.concatenate(p) for p in zip(*map(opened, held)))

    for batch in batches:
        for b, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != now and held:
                yield whole()
                held = []
            now = b
            held.append(block)
    if held:
        yield whole()


def met(blocks: DataFrame, buckets: int, meet) -> DataFrame:
    """(key_a, key_b) of what meets in the buckets; bucket i is task i, so that tasks are even."""
    placed = blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return cut_lineage(placed.mapInArrow(meet, "key_a long, key_b long").distinct())


def key_pairs(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), U)
    return pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64))], ["key_a", "key_b"])


def candidates(rows: DataFrame, text: str, plan: Plan) -> DataFrame:
    """(key_a, key_b): keys that may belong to similar sets; equal keys where a key occurs more than once."""
    limit = plan.measure.table()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, code, key, second in by_bucket(batches):
            code, key, twice, second = in_order(code, key, second)
            found = [np.stack([twice, twice])]
            for a, b in meetings(code, key, limit, False, second):
                if len(a):
                    found.append(np.stack([a, b]))
            yield key_pairs(found)

    return met(rows.select(text).mapInArrow(lambda it: postings(it, plan), "bucket int, block binary"), plan.buckets, meet)


@dataclass
class Filter:
    """Which values may be in a one-column table. words: bits by hash, None if there are too many values; then `values` tells."""

    values: DataFrame
    words: np.ndarray | None


def filter_of(values: DataFrame) -> Filter:
    """A filter of VALUE_BITS bits for each value of a one-column table, counted first; at most MOST_BITS (16 MB), else a join.

    Places of bits go to the task of their slice, which sends its slice packed; so no task holds more than its slices.
    """
    n = values.count()
    size = 1 << max(16, int(n * VALUE_BITS).bit_length())
    if size > MOST_BITS:
        return Filter(values, None)
    per = min(size, SLICE_BITS)

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.asarray(b.column(0))
            for i in np.unique(at // per).tolist():
                held.setdefault(i, np.zeros(per, bool))[at[at // per == i] % per] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["slice", "block"])

    bit = F.pmod(F.xxhash64(F.col(values.columns[0])), F.lit(size)).alias("bit")
    placed = values.select(bit).repartition(max(1, min(size // per, shuffle_partitions(values.sparkSession))), F.floor(F.col("bit") / per))
    out = np.zeros(size // 8, np.uint8)
    for r in placed.mapInArrow(unite, "slice int, block binary").collect():
        out[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["block"], np.uint8)
    return Filter(values, out.view("<i8"))


def key_filter(pairs: DataFrame) -> Filter:
    return filter_of(pairs.select(F.explode(F.array("key_a", "key_b")).alias("k")))


def maybe_in(rows: DataFrame, known: Filter, column: str = "key") -> DataFrame:
    """Rows whose column may be in the filter: all that are, and about one in VALUE_BITS of the others (none by a join)."""
    if known.words is None:
        return rows.join(known.values.toDF("__known").distinct(), F.col(column) == F.col("__known"), "left_semi")
    shared, size = rows.sparkSession.sparkContext.broadcast(known.words), len(known.words) * 64

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.asarray(b.column("__bit"))
            yield b.filter(pa.array((shared.value[bit >> 6] >> (bit & 63)) & 1 == 1)).drop_columns(["__bit"])

    return rows.withColumn("__bit", F.pmod(F.xxhash64(F.col(column)), F.lit(size))).mapInArrow(kept, rows.schema)


def keyed(rows: DataFrame, text: str, least: int, others: list[str]) -> DataFrame:
    """Rows with enough words, with the key, the content hash and the wide parity of their set."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            vocabulary.bounded()
            sets = read_sets(b.column(text).to_pylist(), least, vocabulary)
            h = vocabulary.grown()[sets.flat]
            starts = np.cumsum(sets.sizes) - sets.sizes
            kept = b.take(pa.array(sets.rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *(pa.array(x.view(np.int64)) for x in (keys_of(h, starts, sets.sizes), content_of(h, starts), *wide_parity(h, starts)))], [*kept.schema.names, *NAMED]
            )

    few = rows.select(*others, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields)
    return few.mapInArrow(add, f"{schema}, " + ", ".join(f"{c} long" for c in NAMED))


def one_each(named: DataFrame) -> DataFrame:
    """Each set once, placed by its key, which the join by key needs anyway."""
    return named.select(*NAMED).repartition("key").distinct()


def close_pairs(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame, measure: Measure) -> DataFrame:
    """(key_a, content_a, key_b, content_b) of candidate sets whose wide parities allow the similarity. sets_*: NAMED."""
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in NAMED])
    both = pairs.join(side(sets_a, "a"), "key_a").join(side(sets_b, "b"), "key_b")
    size = lambda s: F.col(f"key_{s}").bitwiseAND(127)
    total, part = size("a") + size("b"), measure.t.numerator + measure.t.denominator
    most = total - 2 * F.floor((total * measure.t.numerator + part - 1) / part)
    far = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ("low", "high"))
    return both.filter((F.greatest(size("a"), size("b")) == 127) | (far <= most)).select("key_a", "content_a", "key_b", "content_b")
