"""N-gram Jaccard self-join by a size-aware heavy-light split.

Documents are sets of word 5-grams.  Two sets with a Jaccard similarity of at
least 3/4 share c members among the first n - ceil(3n/4) + c of each, in any order
common to all sets (c = 2 + n/16, of the smaller set); here frequent members come
last.  Lists of sets that
share such a member are contracted first (members against the first of the
list, verified).  What is left between different groups is joined by size: small
sets by the two-member subsets of their prefix, large ones by scanning the lists
of their prefix members, with the size between them chosen by the cost of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import settle
from .rows import SLICE, WORD, finished, unused

GRAM = 5
NUMERATOR, DENOMINATOR = 75, 100
SUBSET, DEPTH = 2, 16  # members two linked sets share in their prefixes: SUBSET + (size of the smaller) / DEPTH
#: Members of at least so many sets come last in the order; of these at most MAX_FREQUENT are told apart (the most
#: frequent).  Any order gives the same links; this one keeps the lists short.
FREQUENT, MAX_FREQUENT = 256, 500_000
RANGE_BYTES = 12_000_000  # text per range of members that one call sorts
SUBSET_COST = 4  # a subset is moved and grouped, a list entry only read
BLOCK = 64  # sets of a family that are tested together
LIST_BLOCK = 512  # sets of a list whose subsets are enumerated together
GROUP = 500  # followers of a leader that are tested together
FLUSH = 4_000_000  # members a task packs at a time
_BASE = 0x5851F42D4C957F2D
_STIR = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STIR
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of the word 5-grams of a text; of the whole sequence, if shorter."""

    def __init__(self) -> None:
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.power = np.cumprod(np.full(n, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(n, pow(_BASE, -1, 2 ** 64), np.uint64))

    def __call__(self, text: str) -> np.ndarray:
        data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
        if len(data) >= len(self.power):
            self.grow(2 * len(data))
        inside = np.concatenate([[False], ~_SEPARATOR[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[::2], edges[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=total[1:])
        words = _stir((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
        width = min(GRAM, len(words))
        grams = np.full(len(words) - width + 1, np.uint64(width))
        for j in range(width):
            grams = grams * np.uint64(_BASE) + words[j:j + len(grams)]
        return np.unique(_stir(grams))


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for a set: equal sets have equal signatures."""
    return (int(_stir(shingles ^ _STIR).sum(dtype=np.uint64).view(np.int64)), int(_stir(shingles + _STIR).sum(dtype=np.uint64).view(np.int64)))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def prefix_length(n: int) -> int:
    return min(n, n - -(-NUMERATOR * n // DENOMINATOR) + SUBSET + n // DEPTH)


# ---------------------------------------------------------------- packed members


def _pack(sorted_values: np.ndarray) -> bytes:
    steps = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, SLICE).columns))


def _ranges(members: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each range of ``bits``-bit members starts, in sorted order."""
    starts = (np.arange(ranges + 1, dtype=object) << bits) // ranges
    starts[-1] = (1 << bits) - 1
    cuts = np.searchsorted(members, starts.astype(np.uint64))
    cuts[-1] = len(members)
    return cuts


def frequent_members(docs: DataFrame, bits: int, ranges: int) -> np.ndarray:
    """The most frequent members, cut to ``bits`` bits: at most MAX_FREQUENT.

    Every member of every set is counted (equal sets of a task once).  Tasks send
    sorted, packed members by range, and a range, whose size is fixed by RANGE_BYTES,
    is counted in one call.
    """
    schema = _arrow("range bigint, packed binary")
    shift = np.uint64(64 - bits)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, size = Shingler(), set(), [], 0

        def flush() -> pa.RecordBatch:
            members = np.sort(np.concatenate(held) >> shift)
            cuts = _ranges(members, bits, ranges)
            found = [(r, _pack(members[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
            return _batch(list(zip(*found)), schema)

        for _, text, _ in _texts(batches):
            shingles = shingler(text or "")
            if len(shingles) and (sig := signature(shingles)) not in seen:
                seen.add(sig)
                held.append(shingles)
                size += len(shingles)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        members = np.sort(np.concatenate([_unpack(p) for p in table["packed"].to_pylist()]))
        first = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]]))
        n = np.diff(np.append(first, len(members)))
        many = n >= FREQUENT
        return pa.table({"member": members[first][many].astype(np.int64), "n": n[many].astype(np.int64)})

    counts = docs.mapInArrow(gather, "range bigint, packed binary").groupBy("range").applyInArrow(count, "member bigint, n bigint")
    rows = counts.orderBy(F.desc("n"), "member").limit(MAX_FREQUENT).select("member").toArrow()
    return np.sort(rows["member"].to_numpy().astype(np.uint64))


_SCANNED = ("uid bigint, doc_id bigint, mark bigint, n bigint, high bigint, low bigint, range bigint, part bigint, packed binary, places binary, "
            "member bigint")


def scan(docs: DataFrame, frequent: np.ndarray, bits: int, ranges: int) -> DataFrame:
    """Three kinds of rows in one written table.

    Documents (uid, doc_id, n, high, low); packed prefix members by range, with the
    places of their documents in the task (part + place = uid); and rows of frequent
    prefix members (member, uid).  Equal sets of a task give their members once.
    """
    schema, shift = _arrow(_SCANNED), np.uint64(64 - bits)
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)
    width = len(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId() << 40
        often, shingler, seen = shipped.value, Shingler(), set()
        out: list[tuple] = []
        light: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        size = 0

        def flush() -> list[tuple]:
            members, places = np.concatenate(light), np.concatenate(owner)
            order = np.argsort(members, kind="stable")
            members, places = members[order], places[order]
            cuts = _ranges(members, bits, ranges)
            return [(None,) * 6 + (r, part, _pack(members[a:b]), zstandard.compress(places[a:b].tobytes(), 1), None)
                    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]

        for place, (key, text, mark) in enumerate(_texts(batches)):
            shingles = shingler(text or "")
            n = len(shingles)
            high, low = signature(shingles)
            out.append((part + place, key, mark, n, high, low) + (None,) * (width - 6))
            if n and (high, low) not in seen:
                seen.add((high, low))
                members = shingles >> shift
                at = np.minimum(np.searchsorted(often, members), max(0, len(often) - 1))
                late = often[at] == members if len(often) else np.zeros(n, bool)
                first = np.concatenate([members[~late], members[late]])[:prefix_length(n)]
                common = first[max(0, int((~late).sum())):]
                light.append(first[:len(first) - len(common)])
                owner.append(np.full(len(light[-1]), place, np.uint32))
                size += len(light[-1])
                out += [(part + place,) + (None,) * (width - 2) + (int(m),) for m in np.unique(common)]
            if size >= FLUSH:
                out += flush()
                light, owner, size = [], [], 0
            if len(out) >= 5_000:
                yield _batch(list(zip(*out)), schema)
                out = []
        if light:
            out += flush()
        if out:
            yield _batch(list(zip(*out)), schema)

    return finished(docs.mapInArrow(pack, _SCANNED))


def shared_members(scanned: DataFrame) -> DataFrame:
    """(member, uid) of prefix members that at least two scanned sets have."""

    def meet(table: pa.Table) -> pa.Table:
        members = [_unpack(p) for p in table["packed"].to_pylist()]
        places = [np.frombuffer(zstandard.decompress(p), np.uint32).astype(np.int64) + part
                  for p, part in zip(table["places"].to_pylist(), table["part"].to_pylist())]
        all_members, all_places = np.concatenate(members), np.concatenate(places)
        order = np.argsort(all_members, kind="stable")
        all_members, all_places = all_members[order], all_places[order]
        same = all_members[1:] == all_members[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return pa.table({"member": all_members[shared].astype(np.int64), "uid": all_places[shared]})

    packed = scanned.filter(F.col("packed").isNotNull()).select("range", "part", "packed", "places")
    light = packed.groupBy("range").applyInArrow(meet, "member bigint, uid bigint")
    return light.unionByName(scanned.filter(F.col("member").isNotNull()).select("member", "uid"))


# ---------------------------------------------------------------- links


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, by label passing and jumping; every round is written."""
    both = settle(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                  .union(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = settle(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        passed = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = passed.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = settle(passed.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return labels


def _short(shingles: np.ndarray) -> bytes:
    """A set in 5 bytes a member.  Two sets of n members take a foreign member for a common one with a chance of
    n*n/2**40, which matters only for a pair one member short of a link."""
    return np.unique(shingles >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _members(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _verify(pairs: DataFrame, sets: DataFrame, family: DataFrame) -> DataFrame:
    """Linked pairs (a, b) that connect whatever the linked ones of ``pairs`` connect.

    Nodes of a family (those with one list leader) are cut into blocks of about
    BLOCK; a pair of blocks gets each of its sets once, however many pairs it tests.
    """
    sized = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    block = family.join(sized, "family").select("node", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("_blocks"))).alias("block"))
    pairs = (pairs.join(block.select(F.col("node").alias("a"), F.col("block").alias("_a")), "a", "left")
             .join(block.select(F.col("node").alias("b"), F.col("block").alias("_b")), "b", "left")
             .select("a", "b", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
             .select("a", "b", F.xxhash64(F.least("_a", "_b"), F.greatest("_a", "_b")).alias("unit")))
    pairs = settle(pairs)
    needed = pairs.select("unit", F.col("a").alias("node")).union(pairs.select("unit", F.col("b").alias("node"))).distinct()
    packed = needed.join(sets, "node").select("unit", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "packed")
    schema = _arrow("a bigint, b bigint")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, found = None, {}, []
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            while parent[node] != node:
                parent[node] = node = parent[parent[node]]
            return node

        for key, a, b, data in _texts(batches):
            if key != unit:
                unit, held, parent = key, {}, {}
            if b is None:
                held[a] = _members(data)
                parent[a] = a
            elif root(a) != root(b) and linked(held[a], held[b]):  # those already connected in this unit need no test
                parent[root(b)] = root(a)
                found.append((a, b))
                if len(found) >= 1_000:
                    yield _batch(list(zip(*found)), schema)
                    found = []
        if found:
            yield _batch(list(zip(*found)), schema)

    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    dealt = packed.union(pairs.select("unit", "a", "b", F.lit(None).cast("binary"))).repartition(parts, "unit")
    return finished(dealt.sortWithinPartitions("unit", F.col("b").asc_nulls_first()).mapInArrow(test, "a bigint, b bigint"))


def _leaders(lists: DataFrame) -> DataFrame:
    """(a, b, enough): for each node the list leader it shares most lists with; ``enough`` for a link to be possible.

    The leader of a list, among sets of like size, is the node with the longest
    lists in all: of a text and its edited copies, most likely the text.
    """
    length = lists.groupBy("member").agg(F.count("*").alias("list"))
    degree = lists.join(length, "member").groupBy("node").agg(F.sum("list").alias("degree"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    banded = lists.join(degree, "node").withColumn("band", band)
    first = banded.groupBy("member", "band").agg(F.max(F.struct("degree", "node", "n")).alias("_l")).select(
        "member", "band", F.col("_l.node").alias("b"), F.col("_l.n").alias("n_b"))
    shared = banded.join(first, ["member", "band"]).filter((F.col("node") != F.col("b")) & _alike("n", "n_b"))
    counted = shared.groupBy("node", "b").agg(F.count("*").alias("_c"), F.max(_least("n", "n_b")).alias("_k"))
    best = counted.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("_c", "b", "_k")).alias("_b"))
    return finished(best.select("a", "_b.b", (F.col("_b._c") >= F.col("_b._k")).alias("enough")))


def _contract(docs: DataFrame, sets: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``stars`` that are linked.

    Every set moves once, to its leader.  A leader with many followers is copied
    for each GROUP of them, so no task sees more than that for one leader.
    """
    groups = stars.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    followers = stars.join(groups, "b").select("a", "b", "groups", F.lit(False).alias("leads"))
    both = followers.union(groups.select(F.col("b").alias("a"), "b", "groups", F.lit(True)))
    wanted = both.join(sets.select(F.col("node").alias("a"), F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "high", "low"), "a")
    moved, schema = "a bigint, b bigint, groups int, leads boolean, packed binary", _arrow("a bigint, b bigint")
    moved_schema = _arrow(moved)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out, seen = Shingler(), [], set()
        for text, high, low, a, b, n, leads in _texts(batches):
            if (a, b) in seen:  # rows equal in key and text
                continue
            seen.add((a, b))
            shingles = shingler(text or "")
            if signature(shingles) == (high, low):
                out.append((a, b, n, leads, _short(shingles)))
            if len(out) >= SLICE:
                yield _batch(list(zip(*out)), moved_schema)
                out = []
        if out:
            yield _batch(list(zip(*out)), moved_schema)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for a, b, leads, packed in _texts(batches):
            if leads:
                current, held = b, _members(packed)
            elif current == b and linked(_members(packed), held):
                yield _batch([[a], [b]], schema)

    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    joined = docs.join(wanted, same).select("text", "high", "low", "a", "b", "groups", "leads")
    dealt = joined.mapInArrow(pack, moved).withColumn("group", F.explode(
        F.when(F.col("leads"), F.sequence(F.lit(0), F.col("groups") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), F.col("groups")).cast("int")))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    near = dealt.repartition(parts, "b", "group").sortWithinPartitions("b", "group", F.desc("leads")).select("a", "b", "leads", "packed")
    return finished(near.mapInArrow(test, "a bigint, b bigint").distinct())


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): the sets of the given nodes."""
    schema = _arrow("node bigint, packed binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out, seen = Shingler(), [], set()
        for text, node, high, low in _texts(batches):
            if node in seen:  # rows equal in key and text
                continue
            seen.add(node)
            shingles = shingler(text or "")
            if signature(shingles) == (high, low):
                out.append((node, _short(shingles)))
            if len(out) >= SLICE:
                yield _batch(list(zip(*out)), schema)
                out = []
        if out:
            yield _batch(list(zip(*out)), schema)

    wanted = nodes.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "node", "high", "low")
    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))).select("text", "node", "high", "low")
    return finished(joined.mapInArrow(work, "node bigint, packed binary"))


def _least(a: str, b: str):
    """Prefix members that linked sets of these sizes share at least.

    Of the set whose prefix ends first, all members it shares are in both prefixes
    or behind its own, so what is behind bounds the rest of the intersection.
    """
    def behind(n: str):
        return F.ceil(F.lit(NUMERATOR) * F.col(n) / DENOMINATOR) - SUBSET - F.floor(F.col(n) / DEPTH)

    common = F.ceil(F.lit(NUMERATOR) * (F.col(a) + F.col(b)) / (NUMERATOR + DENOMINATOR))
    # one less: two members of a set may be cut to the same bits
    return F.greatest(F.lit(SUBSET), SUBSET - 1 + F.floor(F.least(a, b) / DEPTH), common - F.greatest(behind(a), behind(b), F.lit(0)) - 1)


def _least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_least`` for arrays of sizes."""
    def behind(n: np.ndarray) -> np.ndarray:
        return -(-NUMERATOR * n // DENOMINATOR) - SUBSET - n // DEPTH

    common = -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))
    rest = np.maximum(np.maximum(behind(a), behind(b)), 0)
    return np.maximum(np.maximum(SUBSET, SUBSET - 1 + np.minimum(a, b) // DEPTH), common - rest - 1)


def _alike(a: str, b: str) -> object:
    return (DENOMINATOR * F.col(a) >= NUMERATOR * F.col(b)) & (DENOMINATOR * F.col(b) >= NUMERATOR * F.col(a))


def boundary(lists: DataFrame) -> int:
    """The set size up to which subsets are cheaper than list scans.

    Per set: subsets are its pairs of shared members; a scan reads the lists of its
    shared members.  The size with the least total cost is taken, sizes in eighths
    of an octave, so the sums that reach the driver are a few hundred rows.
    """
    length = lists.groupBy("member").agg(F.count("*").alias("list"))
    cost = (lists.join(length, "member").groupBy("node", "n").agg(F.count("*").alias("u"), F.sum("list").alias("scan"))
            .withColumn("bin", F.floor(8 * F.log2("n"))).groupBy("bin")
            .agg(F.sum(F.col("u") * (F.col("u") - 1) / 2).alias("subsets"), F.sum("scan").alias("scan"), F.max("n").alias("n")))
    rows = sorted(cost.collect())
    best, at = sum(r.scan for r in rows), 0
    total = best
    for r in rows:
        total += SUBSET_COST * r.subsets - r.scan
        if total < best:
            best, at = total, r.n
    return at


def _homes(small: DataFrame) -> DataFrame:
    """The rows with ``home``: the member with the longest list a set stands in."""
    rows = small.select("node", F.explode("m").alias("member"))
    length = rows.groupBy("member").agg(F.count("*").alias("list"))
    longest = rows.join(length, "member").groupBy("node").agg(F.max(F.struct("list", "member")).alias("_l"))
    return settle(small.join(longest.select("node", F.col("_l.member").alias("home")), "node"))


def _blocked(small: DataFrame) -> DataFrame:
    """Rows (whole, member, left, right, side, node, n, label, home, m) of the units in which pairs of sets are counted.

    Sets of one home meet once, in units of it (``whole``), however many lists they
    share; a list is left with its pairs of different homes.  Homes and lists are cut
    into blocks of about LIST_BLOCK sets and a unit is a pair of blocks, so no task
    holds a long one; in a list the sets of its main home meet the others only.
    """
    own = _homes(small)
    sized = (own.groupBy("home").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"), F.min("label").alias("_x"), F.max("label").alias("_y"))
             .filter("_x != _y").select("home", "blocks"))
    whole = own.join(sized, "home").select(
        F.lit(True).alias("whole"), F.col("home").alias("member"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        (F.col("blocks") - 1).alias("last"), "node", "n", "label", "home", "m")

    rows = own.withColumn("member", F.explode("m"))
    lists = (rows.groupBy("member", "home").agg(F.count("*").alias("k")).groupBy("member")
             .agg(F.max(F.struct("k", "home")).alias("main"), F.sum("k").alias("total"), F.count("*").alias("homes")).filter("homes > 1")
             .select("member", F.when(F.col("total") > LIST_BLOCK, F.col("main")).alias("main"), "total")
             .withColumn("rest", F.ceil((F.col("total") - F.coalesce("main.k", F.lit(0))) / LIST_BLOCK).cast("int"))
             .withColumn("mains", F.ceil(F.coalesce("main.k", F.lit(0)) / LIST_BLOCK).cast("int")))
    inside = F.coalesce(F.col("home") == F.col("main.home"), F.lit(False))
    mark = F.xxhash64("node")
    crossed = rows.join(lists, "member").select(
        F.lit(False).alias("whole"), "member", F.when(inside, F.col("rest") + F.pmod(mark, F.col("mains"))).otherwise(F.pmod(mark, F.col("rest"))).cast("int").alias("block"),
        F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("mains") - 1).alias("last"), "node", "n", "label", "home", "m")
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    return (whole.unionByName(crossed).select("whole", "member", "block", "node", "n", "label", "home", "m", other)
            .select("whole", "member", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                    (F.col("block") > F.col("other")).alias("side"), "node", "n", "label", "home", "m"))


def _first_shared(member: int | None, left: list[tuple], right: list[tuple], same: bool) -> list[tuple[int, int]]:
    """The candidate pairs of different homes whose smallest shared prefix member is ``member``, or, without one, all
    candidate pairs; rows are (node, n, label, home, m).

    Every set stands in the bucket of each subset {member, y}; a pair is counted in the buckets it shares.
    """
    both = left if same else left + right
    y = np.concatenate([np.asarray(r[4], np.int64) for r in both])
    at = np.repeat(np.arange(len(both)), [len(r[4]) for r in both])
    order = np.argsort(y, kind="stable")
    y, at = y[order], at[order]
    edges = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1], [True]]))
    rows = len(left)
    width = rows if same else len(right)
    count, before = np.full((rows, width), member is not None, np.int32), np.zeros((rows, width), bool)
    for start, stop in zip(edges[:-1], edges[1:]):
        if stop - start < 2 or y[start] == member:
            continue
        i = j = at[start:stop]
        if not same:
            i, j = i[i < rows], j[j >= rows] - rows
            if not len(i) or not len(j):
                continue
        if member is not None and y[start] < member:
            before[np.ix_(i, j)] = True
        else:
            count[np.ix_(i, j)] += 1
    n, labels, homes, nodes = (np.array([r[c] for r in both], np.int64) for c in (1, 2, 3, 0))
    second = slice(None) if same else slice(rows, None)
    n_a, n_b = n[:rows, None], n[None, second]
    fits = ~before & (labels[:rows, None] != labels[None, second]) & (count >= _least_shared(n_a, n_b))
    fits &= (DENOMINATOR * n_a >= NUMERATOR * n_b) & (DENOMINATOR * n_b >= NUMERATOR * n_a)
    if member is not None:
        fits &= homes[:rows, None] != homes[None, second]
    if same:
        fits = np.triu(fits, 1)
    found = np.argwhere(fits)
    pairs = np.sort(np.stack([nodes[:rows][found[:, 0]], nodes[second][found[:, 1]]], 1), 1)
    return [(int(a), int(b)) for a, b in pairs]


def _subset_pairs(small: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) among small sets: each comes out once, in its home or at its smallest shared prefix member."""
    schema = _arrow("a bigint, b bigint")

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            if unit is not None:
                pairs = _first_shared(None if unit[0] else unit[1], *sides, same=unit[2] == unit[3])
                if pairs:
                    yield _batch(list(zip(*pairs)), schema)

        for whole, member, left, right, side, *row in _texts(batches):
            if (whole, member, left, right) != unit:
                yield from close()
                unit, sides = (whole, member, left, right), ([], [])
            sides[side].append(row)
        yield from close()

    parts = max(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), small.sparkSession.sparkContext.defaultParallelism)
    unit = ["whole", "member", "left", "right"]
    return _blocked(small).repartition(parts, *unit).sortWithinPartitions(*unit).mapInArrow(enumerate_subsets, "a bigint, b bigint")


def residual_pairs(lists: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of nodes in different groups, by the heavy-light split of ``lists``
    (member, node, n, label); lists whose nodes are all in one group are gone before."""
    mixed_ = lists.groupBy("member").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x != _y").select("member")
    lists = settle(lists.join(mixed_, "member"))
    size = boundary(lists)
    small = lists.filter(F.col("n") <= size).groupBy("node", "n", "label").agg(F.sort_array(F.collect_list("member")).alias("m"))

    def scanned(x: DataFrame, y: DataFrame, once: bool) -> DataFrame:
        other = y.select("member", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
        pairs = x.join(other, "member").filter((F.col("label") != F.col("label_b")) & _alike("n", "n_b"))
        if once:
            pairs = pairs.filter(F.col("node") < F.col("b"))
        return (pairs.groupBy(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
                .agg(F.count("*").alias("_c"), F.max(_least("n", "n_b")).alias("_k")).filter("_c >= _k").select("a", "b"))

    large = lists.filter(F.col("n") > size)
    near = lists.filter((F.col("n") <= size) & (DENOMINATOR * F.col("n") >= NUMERATOR * size))
    return _subset_pairs(settle(small)).union(scanned(large, large, True)).union(scanned(large, near, False))


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies, first) for every row.

    ``component_id`` is the smallest key reachable by links; ``n_copies`` counts the
    rows with an equal set; ``first`` is true for one row of each component (that
    with the smallest key).

    * NULL, empty and wordless texts: no shingles, linked with nothing.
    * NULL key: takes part; its component has the smallest key of the others, or NULL.
    * Repeated rows, also with one key, are documents of their own.
    * No rows: no rows.  Other columns are not read.
    """
    return _grouped(df, key, text).drop("mark")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that with the smallest key (NULL keys last).

    Rows without words are linked with nothing and all stay; of other rows equal in key and text one stays.
    """
    held, mark = (unused(name, df) for name in ("key", "mark"))
    first = _grouped(df, key, text).filter("first").select(F.col("doc_id").alias(held), F.col("mark").alias(mark))
    marked = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    wordless = ~F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    kept = df.filter(~wordless).join(first, F.col(key).eqNullSafe(F.col(held)) & (marked == F.col(mark)), "left_semi")
    return kept.withColumn(mark, marked).dropDuplicates([key, mark]).drop(mark).unionByName(df.filter(wordless))


def _grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                     F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    bits = min(56, max(32, int(size).bit_length() + 10))
    ranges = max(1, size // RANGE_BYTES)
    scanned = scan(docs, frequent_members(docs, bits, ranges), bits, ranges)
    rows = scanned.filter(F.col("n").isNotNull()).select("uid", "doc_id", "mark", "n", "high", "low")
    sets = settle(rows.filter(F.col("n") > 0).groupBy("high", "low", "n").agg(
        F.min("uid").alias("node"), F.min_by("doc_id", "uid").alias("doc_id"), F.min_by("mark", "uid").alias("mark"), F.count("*").alias("n_copies")))
    members = settle(rows.join(sets.select("high", "low", "node", "n_copies"), ["high", "low"], "left"))
    found = settle(shared_members(scanned).join(members.select("uid", "node", "n"), "uid").select("member", "node", "n").distinct())
    several = found.groupBy("member").agg(F.min("node").alias("_x"), F.max("node").alias("_y")).filter("_x != _y").select("member")
    lists = finished(found.join(several, "member"))

    leaders = _leaders(lists)
    near = _contract(docs, sets, leaders.filter("enough").select("a", "b"))
    labels = components(near)
    labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    pairs = finished(residual_pairs(labelled))
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    family = settle(leaders.select(F.col("a").alias("node"), F.col("b").alias("family"))
                    .union(leaders.select("b", "b").distinct()).groupBy("node").agg(F.max("family").alias("family")))
    far = _verify(pairs, _sets(docs, sets.join(asked, "node", "left_semi")), family)
    labels = components(near.unionByName(far))

    whole = settle(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node", "uid")))
    best = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("_first"))
    return whole.join(best, "label").select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id",
                                            F.coalesce("n_copies", F.lit(1)).alias("n_copies"), (F.col("uid") == F.col("_first")).alias("first"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+{GRAM - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-{GRAM - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DENOMINATOR}*c >= {NUMERATOR}*(x.n+y.n-c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
