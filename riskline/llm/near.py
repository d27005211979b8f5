"""Exact n-gram Jaccard join by pivots.

A document is its set of word shingles. 1 - Jaccard similarity is a metric, so a pivot's distances
bound those between others: two documents within r of each other differ by at most r in their
distance to any pivot. Regions are cut by nearest pivot (Voronoi), documents near a border
go to every region they may have partners in, and regions are joined recursively and exactly.

At distance 1, where two sets share nothing, that bound says nothing, and nearly all pairs are
there. So the first cut is by parts of the sets: hashing splits a set into K classes, more than
the shingles in which two linked sets can differ, so at least one class is the same in both and
its content names a bucket that both are in. Connected buckets form the top regions; no link
leaves one. Inside, pivots decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.links import components
from riskline.llm.text import batches, file_place, fresh
from riskline.session import materialize, release, scratch, ship

ship(__name__)

CHUNK = 1 << 20
FILTER_BITS = 23
# Common shingles: in so many sets of a batch, and so many at most, the most frequent. They only
# decide which buckets are small, never which documents link.
OFTEN = 3
MAX_COMMON = 500_000
# Documents a Python worker holds at once.
BATCH = 4_000
# Bucket names are dealt in ranges of about so many; of a name, so many bytes go on in its range.
RANGE, NAME_BYTES = 1 << 20, 5
PIVOTS = 8
SMALL = 24
# A cut of a large region: the share its largest part may keep, and all parts together.
MOST, EXTRA = 0.8, 1.5
# Inside a task, all parts of a cut together may exceed the region by this, as the cuts are nested.
CROWD = 1.2
# Shingles of more than one in so many members of a crowded region name no bucket in it.
CROWDED = 20
_RANDOM = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values (the finishing steps of a common 64-bit hash)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_KEPT: dict[int, np.ndarray] = {}


def _powers(size: int, base: int) -> np.ndarray:
    """The first ``size`` powers, kept for the next chunk."""
    if len(_KEPT.get(base, ())) < size:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _KEPT[base] = np.multiply.accumulate(out)
    return _KEPT[base]


def _room(size: int) -> int:
    return 1 << max(20, int(size).bit_length())


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles.

    A-Z count as a-z. Fewer than k words are one shingle; no word, no shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < CHUNK):
            size += len(raw[end]) + 1
            end += 1
        yield from _chunk(raw[at:end], k)
        at = end


def _chunk(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    gap = _SPACE[data]
    room = _room(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[data] * _powers(room, _BASE)[: len(data)], out=sums[1:])
    word = ~gap
    starts = np.flatnonzero(word & np.concatenate(([True], gap[:-1])))
    stops = np.flatnonzero(word & np.concatenate((gap[1:], [True]))) + 1
    back = _powers(room, pow(_BASE, -1, 1 << 64))[starts]
    hashes = _mix((sums[stops] - sums[starts]) * back + (stops - starts).astype(np.uint64))
    runs = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for j in range(k):
        runs = runs * _U(_BASE) + hashes[j : j + len(runs)]
    runs = _mix(runs)
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    firsts = np.searchsorted(starts, edges)
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=int(b - a))], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


class Threshold:
    """Similarity of at least ``percent`` in a hundred, and the bands of set size for it."""

    def __init__(self, percent: int):
        self.percent = percent
        self.radius = 1 - percent / 100
        self.lows = [1]
        self.classes: list[tuple[int, int]] = []

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:
            low = self.lows[-1]
            nxt = max(low + 1, -(-100 * low // self.percent))
            m, p = nxt - 1, self.percent
            # Most shingles that linked sets, the smaller one in this band, can differ in.
            differ = (100 - p) * (m + 100 * m // p) // (100 + p)
            k = differ + 1
            while k < 2 * differ + 4 and k - 1.3 * k * exp(-low / k) < differ + 2:
                k += 1
            self.lows.append(nxt)
            self.classes.append((k, differ))
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def buckets(self, items: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Names of the set's classes, in its own size band and, as a larger partner, the one below.

        Linked sets differ in at most ``differ`` shingles, so also without the ``common`` ones, and
        agree in K - differ classes or more. If a set without its common shingles has more filled
        classes than ``differ``, a filled one is among those, and both sets leave their filled ones.
        Sets with too few also leave the classes of all their shingles, with the empty ones
        if even then too few are filled. That holds for any list of common shingles;
        a good one keeps passages that many documents quote from naming buckets.

        Of filled classes enough, the least names suffice: those of a set that come before the least name
        it has in common with a linked one are in shingles they differ in, of which there are at most ``most``.
        """
        n, p = len(items), self.percent
        rare = items[common[np.searchsorted(common, items) % len(common)] != items] if len(common) else items
        own, out = self.band(len(items)), []
        for b in (own, own - 1) if own else (own,):
            k, differ = self.classes[b]
            partner = 100 * n // p if b == own else self.lows[own] - 1
            most = min(differ, (100 - p) * (n + partner) // (100 + p))
            for salt, chosen in ((0, rare), (1 << 20, items)):
                which = ((chosen >> _U(32)) % _U(k)).astype(np.int64)
                content = np.zeros(k, dtype=np.uint64)
                np.add.at(content, which, _mix(chosen))
                names = _mix(_mix(content + _U(b + 1 + salt)) + np.arange(k, dtype=np.uint64) * _U(_BASE))
                filled = np.bincount(which, minlength=k) > 0
                enough = filled.sum() > differ
                if enough:
                    out.append(np.partition(names[filled], most)[: most + 1])
                    break
                out.append(names if salt else names[filled])
        return np.concatenate(out)

    def linked(self, inter: np.ndarray, union: np.ndarray) -> np.ndarray:
        return (100 * inter >= self.percent * union) & (inter > 0)


def _key(items: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes())).astype(np.int64))


def _rows(frames: Iterator[pd.DataFrame], k: int, count: bool) -> Iterator[pd.DataFrame]:
    """id, key of the set and its size; the first row of a batch holds the shingles of several different sets of it, with their number."""
    for frame in frames:
        found = list(shingle_sets(frame["text"].tolist(), k))
        keys = [_key(s) for s in found]
        out = pd.DataFrame({"id": pd.array([None if pd.isna(x) else int(x) for x in frame["id"]], dtype="Int64"), "key": keys, "n": [len(s) for s in found]})
        often: list[list] = [[] for _ in found]
        counts: list[list] = [[] for _ in found]
        if count and found:
            values = np.concatenate(list(dict(zip(keys, found)).values()))
            del found
            values.sort()
            first = np.flatnonzero(np.concatenate((values[:1] == values[:1], values[1:] != values[:-1])))
            number = np.diff(np.append(first, len(values)))
            often[0], counts[0] = values[first[number >= OFTEN]].view(np.int64), number[number >= OFTEN]
        out["h"], out["c"] = often, counts
        yield out.astype({"key": "int64", "n": "int64"})


def _nodes(batch: int, places: np.ndarray) -> np.ndarray:
    """Numbers of the sets at ``places`` of a batch."""
    return _mix(np.array([batch], dtype=np.int64).view(np.uint64) ^ _mix(places.astype(np.uint64) + _U(1))).view(np.int64)


def _sketch(frames: Iterator[pd.DataFrame], k: int, percent: int, common: np.ndarray, ranges: int) -> Iterator[pd.DataFrame]:
    """The bucket names of the different sets of a batch, a row for each range of names, and a row of the sets' keys.

    Members of one bucket meet in their batch first: only the least key of a batch goes
    on for a bucket, the others share one more bucket with it alone. So a bucket sends at most one name from each batch.
    A name moves as its low bytes and its owner's place in the batch, written as the step from the name before;
    the row of keys tells whom a place means. Names that differ in their high part only
    make a bucket larger, never smaller. Batches are told by what they hold, so a task that runs again gives the same.
    """
    rule = Threshold(percent)
    for frame in frames:
        keys, names, owners, seen = [], [], [], set()
        for items in shingle_sets(frame["text"].tolist(), k):
            key = _key(items)
            if len(items) and key not in seen:
                seen.add(key)
                names.append(rule.buckets(items, common).view(np.int64))
                owners.append(np.full(len(names[-1]), len(keys)))
                keys.append(key)
        if not names:
            continue
        ids = np.array(keys, dtype=np.int64)
        all_names, all_owners = np.concatenate(names), np.concatenate(owners)
        order = np.lexsort((ids[all_owners], all_names))
        n, o = all_names[order], all_owners[order]
        head = np.concatenate(([True], n[1:] != n[:-1]))
        least = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
        pairs = np.unique(np.stack((o[~head], least[~head])), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        both = ids[pairs].view(np.uint64)
        own = _mix(both[0] ^ _mix(both[1])).view(np.int64)
        n, o = np.concatenate((n[head], own, own)).view(np.uint64), np.concatenate((o[head], *pairs))
        part = ((n >> _U(8 * NAME_BYTES)) % _U(ranges)).astype(np.int64)
        order = np.lexsort((o, part))
        low = n[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]
        part, o = part[order], o[order]
        batch = _key(ids)
        rows = [(-1 - batch % ranges, batch, ids.tobytes(), b"")]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(edges[:-1], edges[1:]):
            rows.append((int(part[a]), batch, np.diff(o[a:b], prepend=0).astype("<u2").tobytes(), low[a:b].tobytes()))
        yield pd.DataFrame(rows, columns=["part", "batch", "owners", "names"])


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """For a range of names, pairs of sets with a bucket in common; for a row of keys, number and key of each set."""
    if frame["part"].iloc[0] < 0:
        nodes, to = [], []
        for batch, owners in zip(frame["batch"], frame["owners"]):
            to.append(np.frombuffer(owners, dtype=np.int64))
            nodes.append(_nodes(batch, np.arange(len(to[-1]))))
        return pd.DataFrame({"node": np.concatenate(nodes), "to": np.concatenate(to), "named": True})
    nodes = np.concatenate([_nodes(batch, np.cumsum(np.frombuffer(o, dtype="<u2").astype(np.int64))) for batch, o in zip(frame["batch"], frame["owners"])])
    low = np.zeros((len(nodes), 8), dtype=np.uint8)
    low[:, :NAME_BYTES] = np.frombuffer(b"".join(frame["names"]), dtype=np.uint8).reshape(-1, NAME_BYTES)
    names = low.view("<u8")[:, 0]
    order = np.argsort(names, kind="stable")
    names, nodes = names[order], nodes[order]
    starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    least = np.repeat(np.minimum.reduceat(nodes, starts), np.diff(np.append(starts, len(names))))
    pairs = pd.DataFrame({"node": nodes, "to": least, "named": False})[nodes != least]
    return pairs.drop_duplicates()


def _members(frames: Iterator[pd.DataFrame], k: int, bits: np.ndarray) -> Iterator[pd.DataFrame]:
    """Key, size and set of the rows that the bit filter lets through; in place of the set its text, where that is shorter."""
    for frame in frames:
        at = frame["at"].to_numpy()
        texts = frame["text"].to_numpy()[(bits[at >> 6] >> (at & 63)) & 1 == 1].tolist()
        sets = list(shingle_sets(texts, k))
        short = [len(t.encode("utf-8", "surrogatepass")) < 8 * len(s) for t, s in zip(texts, sets)]
        out = pd.DataFrame({"key": pd.Series([_key(s) for s in sets], dtype="int64"), "n": pd.Series([len(s) for s in sets], dtype="int64")})
        out["text"] = pd.Series([t if x else None for t, x in zip(texts, short)], dtype=object)
        out["items"] = pd.Series([None if x else s.view(np.int64) for s, x in zip(sets, short)], dtype=object)
        yield out


def _sets(frame: pd.DataFrame, k: int) -> list[np.ndarray]:
    """The sets of rows that have them or their texts."""
    made = shingle_sets([t for t in frame["text"] if isinstance(t, str)], k)
    return [next(made).view(np.int64) if isinstance(t, str) else np.asarray(x, dtype=np.int64) for t, x in zip(frame["text"], frame["items"])]


def _with_sets(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = frame[["region", "key"]].copy()
        out["items"] = pd.Series(_sets(frame, k), index=out.index, dtype=object)
        yield out


class _Region:
    """The exact join of the sets of one region; ``root`` tells the components."""

    def __init__(self, sets: list[np.ndarray], rule: Threshold):
        self.rule, self.sets = rule, sets
        self.sizes = np.array([len(s) for s in sets])
        flat, self.tokens = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.mark = np.zeros(len(flat), dtype=bool)
        self.root = np.arange(len(sets))

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with others."""
        mine = self.tokens[self.starts[pivot] : self.starts[pivot + 1]]
        self.mark[mine] = True
        sizes = self.sizes[others]
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        where = np.repeat(self.starts[others] - begin, sizes) + np.arange(sizes.sum())
        found = np.add.reduceat(self.mark[self.tokens[where]].astype(np.int64), begin)
        self.mark[mine] = False
        return found

    def against(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Link the pivot with all of ``others`` it is near to; its distances to them."""
        inter = self.shared(pivot, others)
        union = self.sizes[pivot] + self.sizes[others] - inter
        for r in np.unique(self.root[others[self.rule.linked(inter, union)]]):
            a, b = sorted((r, self.root[pivot]))
            if a != b:
                self.root[self.root == b] = a
        return 1 - inter / union

    def join(self, members: np.ndarray) -> None:
        while len(members) > 1 and (self.root[members] != self.root[members[0]]).any():
            if len(members) <= SMALL:
                pivot, members = members[0], members[1:]
                small, large = np.minimum(self.sizes[members], self.sizes[pivot]), np.maximum(self.sizes[members], self.sizes[pivot])
                ask = members[(self.root[members] != self.root[pivot]) & (100 * small >= self.rule.percent * large)]
                if len(ask):
                    self.against(pivot, ask)
                continue
            order = members[np.argsort(self.sizes[members], kind="stable")]
            chosen = order[np.linspace(0, len(order) - 1, PIVOTS).astype(int)]
            far = np.stack([self.against(p, members) for p in chosen])
            rest = ~np.isin(members, chosen)
            members, far = members[rest], far[:, rest]
            nearest = far.min(axis=0)
            slack = 1e-9
            # The region of those that share nothing with any pivot, or nearly so.
            parts = [members[nearest >= 1 - self.rule.radius - slack]]
            for row in far:
                parts.append(members[(nearest < 1) & (row - nearest <= 2 * self.rule.radius + slack)])
            if max(map(len, parts)) > MOST * len(members) or sum(map(len, parts)) > CROWD * len(members):
                # Pivots do not part these; each is compared with those it shares a bucket with.
                self.crowd(members)
                return
            for part in parts:
                self.join(part)
            return

    def crowd(self, members: np.ndarray) -> None:
        """Every member in turn is a pivot for the members of its buckets that are not linked with it yet."""
        if not len(members):
            return
        values, counts = np.unique(np.concatenate([self.sets[m] for m in members]).view(np.uint64), return_counts=True)
        common = values[counts > max(OFTEN, len(members) // CROWDED)]
        names = [np.unique(self.rule.buckets(self.sets[m].view(np.uint64), common)) for m in members]
        which = np.unique(np.concatenate(names), return_inverse=True)[1]
        owners = np.repeat(np.arange(len(members)), [len(n) for n in names])
        shared = np.bincount(which)[which] > 1
        which, owners = which[shared], owners[shared]
        weight = np.bincount(which)
        # Those with most neighbours come first, as they link most.
        order = np.argsort(-np.bincount(owners, weights=weight[which], minlength=len(members)), kind="stable")
        turn = np.empty(len(members), dtype=np.int64)
        turn[order] = np.arange(len(members))
        every = max(64, len(members) // 50)
        for begin in range(0, len(members), every):
            # Members that have had their turn leave, and buckets in which all are linked or one is left.
            root = self.root[members]
            waiting = turn[owners] >= begin
            which, owners = which[waiting], owners[waiting]
            if not len(which):
                return
            deal = np.argsort(which, kind="stable")
            which, owners = which[deal], owners[deal]
            starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            sizes = np.diff(np.append(starts, len(which)))
            mixed = np.minimum.reduceat(root[owners], starts) != np.maximum.reduceat(root[owners], starts)
            keep = np.repeat(mixed, sizes)
            which, owners = which[keep], owners[keep]
            starts, sizes = np.cumsum(sizes[mixed]) - sizes[mixed], sizes[mixed]
            bucket = np.repeat(np.arange(len(starts)), sizes)
            by_owner = np.argsort(owners, kind="stable")
            edges = np.searchsorted(owners[by_owner], np.arange(len(members) + 1))
            for m in order[begin : begin + every]:
                of = bucket[by_owner[edges[m] : edges[m + 1]]]
                if not len(of):
                    continue
                first = np.cumsum(sizes[of]) - sizes[of]
                near = np.zeros(len(members), dtype=bool)
                near[owners[np.repeat(starts[of] - first, sizes[of]) + np.arange(sizes[of].sum())]] = True
                near &= turn > turn[m]
                ask, pivot = members[near], members[m]
                small, large = np.minimum(self.sizes[ask], self.sizes[pivot]), np.maximum(self.sizes[ask], self.sizes[pivot])
                ask = ask[(self.root[ask] != self.root[pivot]) & (100 * small >= self.rule.percent * large)]
                if len(ask):
                    self.against(pivot, ask)


def _join_regions(frame: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """Key and least key of its component, for the regions of one bin."""
    rule, out = Threshold(percent), []
    # A key stands in several regions where one was cut.
    frame = frame.drop_duplicates(["region", "key"])
    frame = frame[frame.duplicated("region", keep=False)]
    all_keys, sets = frame["key"].to_numpy(), _sets(frame, shingle)
    for rows in frame.groupby("region", sort=False).indices.values():
        keys = all_keys[rows]
        region = _Region([sets[i] for i in rows], rule)
        region.join(np.arange(len(rows)))
        least = pd.Series(keys).groupby(region.root).transform("min").to_numpy()
        out.append(pd.DataFrame({"key": keys, "to": least})[keys != least])
    return pd.concat(out) if out else pd.DataFrame({"key": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})


def _blocks(members: DataFrame, limit: int) -> DataFrame:
    """Regions that pivots do not part: every two blocks of half a task's bytes are a region."""
    sizes = members.groupBy("region").agg(F.ceil(F.sum(F.size("items") * 8) / (limit / 2)).cast("int").alias("blocks"))
    rows = members.join(sizes, "region").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("region", F.least("b", o), F.greatest("b", o)))
    return rows.select(F.explode(pair).alias("region"), "key", "items")


def _split_hot(members: DataFrame, rule: Threshold, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Cut regions of more than ``limit`` bytes by distributed pivots until none is left.

    Returns (region, key, items) in regions that fit a task, and the links found on the way. Every
    round takes PIVOTS members of each large region, links and removes them, drops regions in which all
    are one component already, and deals the others out by nearest pivot with their windows. A cut counts
    if no part keeps more than MOST of the region and its windows add less than EXTRA to it, so rounds end and
    copies are bounded; other regions are joined by pairs of blocks, each of which fits a task.
    """
    ready, links, percent, radius = None, None, rule.percent, rule.radius
    while True:
        weight = members.groupBy("region").agg(F.sum(F.size("items") * 8).alias("bytes"))
        hot = materialize(weight.where(F.col("bytes") > limit).select("region"), "near-hot")
        if hot.isEmpty():
            return (members if ready is None else ready.unionByName(members)), links
        fits = materialize(members.join(hot, "region", "left_anti"), "near-fits")
        ready = fits if ready is None else ready.unionByName(fits)
        large = materialize(members.join(hot, "region", "left_semi"), "near-large")
        # Few rows a region, found with a bounded heap for each task and region.
        best = large.groupBy("region").agg(F.expr(f"slice(array_sort(collect_set(IF(pmod(xxhash64(key), 1024) = 0, key, NULL))), 1, {PIVOTS})").alias("a"), F.min("key").alias("b"), F.max("key").alias("c"))
        named = best.select("region", F.explode(F.array_distinct(F.concat("a", F.array("b", "c")))).alias("key"))
        pivots = large.join(named, ["region", "key"]).select("region", F.col("key").alias("pivot"), F.col("items").alias("p"))
        pivots = materialize(pivots, "near-pivots")
        inter = F.size(F.array_intersect("items", "p"))
        union = F.size("items") + F.size("p") - inter
        far = large.join(pivots, "region").select(
            "region", "key", "pivot", (1 - inter / union).alias("d"), ((100 * inter >= percent * union) & (inter > 0)).alias("linked")
        )
        far = materialize(far, "near-far")
        found = far.where("linked AND key != pivot").select("key", F.col("pivot").alias("to"))
        links = found if links is None else links.unionByName(found)
        done = materialize(components(links), "near-linked")
        near = far.groupBy("region", "key").agg(F.min("d").alias("least"), F.collect_list(F.struct("pivot", "d")).alias("ds"), F.max(F.col("key") == F.col("pivot")).alias("is_pivot"))
        slack = 2 * radius + 1e-9
        regions = F.concat(
            F.when(F.col("least") >= 1 - radius - 1e-9, F.array(F.xxhash64("region"))).otherwise(F.array().cast("array<bigint>")),
            F.when(F.col("least") < 1, F.transform(F.filter("ds", lambda x: x["d"] - F.col("least") <= slack), lambda x: F.xxhash64("region", x["pivot"])))
            .otherwise(F.array().cast("array<bigint>")),
        )
        dealt = near.where(~F.col("is_pivot")).select("key", F.col("region").alias("was"), F.explode(F.array_distinct(regions)).alias("region"))
        dealt = materialize(dealt, "near-dealt")
        parts = dealt.groupBy("was", "region").agg(F.count("*").alias("n")).groupBy("was").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
        before = dealt.groupBy("was").agg(F.count_distinct("key").alias("n"))
        stuck = parts.join(before, "was").where((F.col("most") > MOST * F.col("n")) | (F.col("all") > EXTRA * F.col("n")))
        stuck = materialize(stuck.select("was"), "near-stuck")
        whole = dealt.join(stuck, "was", "left_semi").select("key", F.col("was").alias("region")).distinct()
        items = large.select("key", "items").dropDuplicates(["key"])

        def still_open(rows: DataFrame) -> DataFrame:
            rooted = rows.join(done, "key", "left").withColumn("root", F.coalesce("to", "key"))
            open_ = rooted.groupBy("region").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("region")
            return rows.join(open_, "region", "left_semi").join(items, "key").select("region", "key", "items")

        ready = ready.unionByName(materialize(_blocks(still_open(whole), limit), "near-blocks"))
        members = materialize(still_open(dealt.join(stuck, "was", "left_anti").select("region", "key")), "near-members")


def near_components(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text",
    region_bytes: int = 32 << 20, bin_bytes: int = 8 << 20, leave_out_common: bool = True,
) -> DataFrame:
    """id, n_shingles, component_id: a row per row of ``docs``.

    Rows link when 100 * intersection >= percent * union of their shingle sets; a component is
    what links reach, named by its least id. Without words (null, empty, blank) a row links with
    nothing and is its own component. Repeated rows are rows of one component; null ids count
    only where nothing else can name a component; an empty table gives an empty result;
    other columns are not looked at. Ids are integers. Shingles are compared as 64-bit hashes.

    ``leave_out_common`` counts frequent shingles first, so that quoted passages do not make large
    regions; the result is the same without, and nine in ten does well without.

    Texts are read three times: what moves is five bytes and a step for each class and batch, and the texts, or
    sets where these are smaller, of documents that share a bucket with another.
    """
    source = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with batches(docs.sparkSession, BATCH):
        return _components(source, shingle, percent, id, region_bytes, bin_bytes, leave_out_common)


def _components(source: DataFrame, shingle: int, percent: int, id: str, region_bytes: int, bin_bytes: int, leave_out_common: bool) -> DataFrame:
    common = np.zeros(0, dtype=np.uint64)
    rows = source.mapInPandas(lambda f: _rows(f, shingle, leave_out_common), "id long, key long, n long, h array<long>, c array<long>")
    rows = materialize(rows, "near-rows")
    if leave_out_common:
        often = rows.select(F.explode(F.arrays_zip("h", "c")).alias("x")).select("x.*")
        often = often.groupBy("h").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "h").limit(MAX_COMMON)
        common = np.sort(often.select("h").toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))
    size = rows.agg(F.sum("n").alias("shingles"), F.count("*").alias("rows")).first()
    # A set leaves fewer names than half its shingles, or a few.
    ranges = ((size.shingles or 0) // 2 + 4 * size.rows) // RANGE + 1
    # Buckets are dealt as they are made; a written table of them would be as large as the shuffle.
    names = source.mapInPandas(lambda f: _sketch(f, shingle, percent, common, ranges), "part long, batch long, owners binary, names binary")
    meets = materialize(names.groupBy("part").applyInPandas(_meet, "node long, to long, named boolean"), "near-meets")
    # The largest shuffle here; what follows needs room of its own.
    release(source.sparkSession)
    keys = meets.where("named").select("node", F.col("to").alias("key")).distinct()
    pairs = meets.where("NOT named").select("node", "to").distinct().join(keys, "node").select("key", "to")
    pairs = pairs.join(keys.select(F.col("node").alias("to"), F.col("key").alias("least")), "to").select("key", F.col("least").alias("to"))
    edges = materialize(pairs.where("key != to").distinct(), "near-edges")
    region = materialize(components(edges).select(F.col("key"), F.col("to").alias("region")), "near-regions")

    at = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    # One row for each key before anything is joined; a null id is asked for where a key has no other.
    wanted = rows.groupBy("key").agg(F.min("id").alias("id")).join(region, "key", "left_semi")
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    # A filter of fixed size, 2 ** FILTER_BITS bits, whatever the corpus; it only ever lets more through.
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in words.collect():
        bits[r.word] = r.bits
    sets = source.withColumn("at", at).mapInPandas(lambda f: _members(f, shingle, bits), "key long, n long, text string, items array<long>")
    members = materialize(sets.join(region, "key").select("region", "key", "n", "text", "items"), "near-members")
    heavy = members.groupBy("region").agg((F.sum("n") * 8).alias("bytes")).where(F.col("bytes") > region_bytes).select("region")
    heavy = materialize(heavy, "near-heavy")
    whole = members.join(heavy, "region", "left_semi").select("region", "key", "text", "items")
    whole = materialize(whole.mapInPandas(lambda f: _with_sets(f, shingle), "region long, key long, items array<long>"), "near-whole")
    cut, links = _split_hot(whole, Threshold(percent), region_bytes)
    cut = cut.select("region", "key", F.size("items").cast("long").alias("n"), F.lit(None).cast("string").alias("text"), "items")
    members = members.join(heavy, "region", "left_anti").select("region", "key", "n", "text", "items").unionByName(cut)
    total = members.agg(F.sum("n") * 8).first()[0] or 0
    bins = F.pmod(F.xxhash64("region"), F.lit(total // bin_bytes + 1))
    joined = members.withColumn("bin", bins).groupBy("bin").applyInPandas(lambda f: _join_regions(f, shingle, percent), "key long, to long")
    joined = materialize(joined, "near-joined")
    if links is not None:
        joined = materialize(components(joined.unionByName(links)), "near-final")
    named = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id")).join(joined, "key", "left")
    named = materialize(named.select("key", "id", F.coalesce("to", "key").alias("top")), "near-named")
    tops = materialize(named.groupBy("top").agg(F.min("id").alias("component_id")), "near-tops")
    names = materialize(named.join(tops, "top").select("key", "component_id"), "near-names")
    out = rows.select("id", "key", "n").join(names, "key", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", prefer: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that with the least ``prefer``, nulls last, where there is such a column.

    Rows of files are told by a 64-bit hash of their place, which is the same in every scan, however the
    files are split; other tables are numbered once and written, and all scans read that. Ties go by hash or number. Every row counts
    for itself, also with a null or repeated id; rows without words stay; columns are unchanged.
    Texts move only if the list of dropped rows is too large for Spark to broadcast. Tables on the way
    are deleted when the list of dropped rows is written.
    """
    row, place = fresh(docs, "row"), file_place(docs)
    if place is not None:
        numbered = docs.withColumn(row, place)
    else:
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "near-numbered")
    with scratch(docs.sparkSession) as keep:
        found = near_components(numbered, shingle, percent, id=row, text=text).select(F.col(row).alias("r"), F.col("component_id").alias("c"))
        several = found.where("r != c").select("c").distinct()
        ids = F.col(prefer) if prefer in docs.columns else F.lit(None).cast("long")
        members = found.join(several, "c", "left_semi").join(numbered.select(F.col(row).alias("r"), ids.alias("p")), "r")
        members = materialize(members, "near-several")
        best = members.groupBy("c").agg(F.min(F.struct(F.col("p").isNull(), "p", "r"))["r"].alias("best"))
        gone = keep(members.join(best, "c").where("r != best").select(F.col("r").alias(row)), "near-gone")
    return numbered.join(gone, row, "left_anti").drop(row)


def op1_jaccard_join(spark, folder: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{folder}/documents.parquet"), shingle=3, percent=90, leave_out_common=False)
