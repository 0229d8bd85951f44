"""Prefix trie of conversations, built as z-fast tries.

A symbol is a whole turn.  Each task keeps a compacted trie of the conversations
it has read: a node stands for a run of turns without a branch, and a dictionary
holds it under the hash of its prefix at the two-fattest depth of that run.  Fat
binary search probes these handles, so a conversation of m turns finds its exit
node in about log2(m) probes; batches are located against the trie as it stands
and then inserted group by group from the exit's parent down.  At the end, or
when a trie grows past MAX_HELD turns, its edges are expanded to one row per
depth.  A node is known by the hash of its whole prefix, so rows of different
tasks are added up by that hash: any distribution of the conversations gives the
same trie, a common start is combined where it is read, and no task needs a
whole subtree.

Sums over subtrees need no walk by level either.  The smallest member of a node
owns it; what a conversation owns is the tail of its own path, so it adds its
total to each prefix above that tail and running sums to the nodes within it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .rows import WORD, map_rows

#: Expanded nodes a task's trie may stand for before it is emitted and started anew; it changes the speed only.
MAX_HELD = 200_000
#: A node with more than a HEAVY-th of all children is joined to them by broadcast: fewer than HEAVY such nodes exist.
HEAVY = 1000
ROOT = b"\0" * 16


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie over prefix hashes; node 0 is the root with the empty extent."""

    def __init__(self):
        self.top, self.depth, self.edge, self.words, self.parent = [0], [0], [[]], [[]], [-1]
        self.members, self.smallest = [0], [None]  # of the conversations that end at the node's extent
        self.handle: dict[bytes, int] = {}
        self.child: dict[bytes, int] = {}  # by the first prefix hash of the child's edge
        self.held = 0

    def _add(self, parent: int, top: int, edge: list, words: list) -> int:
        node = len(self.top)
        for column, value in ((self.top, top), (self.depth, top + len(edge)), (self.edge, edge), (self.words, words),
                              (self.parent, parent), (self.members, 0), (self.smallest, None)):
            column.append(value)
        self.child[edge[0]] = node
        self._hold(node)
        return node

    def _hold(self, node: int) -> None:
        at = two_fattest(self.top[node], self.depth[node])
        self.handle[self.edge[node][at - self.top[node] - 1]] = node

    def exit_parent(self, path: list, start: int = 0) -> int:
        """The deepest node at or below ``start`` whose whole extent begins the path: fat binary search over handles."""
        node, low, high = start, self.depth[start], len(path)
        while low < high:
            at = two_fattest(low, high)
            found = self.handle.get(path[at - 1])
            if found is None:
                high = at - 1
            elif self.depth[found] <= len(path) and self.edge[found][-1] == path[self.depth[found] - 1]:
                node, low = found, self.depth[found]
            else:
                return self.parent[found]
        return node

    def insert(self, above: int, path: list, words: list, members: int, smallest: int) -> None:
        """A path whose exit lies below ``above``; a branch inside an edge splits the node there."""
        at = self.depth[above]
        if len(path) > at:
            node = self.child.get(path[at])
            if node is None:
                node = self._add(above, at, path[at:], words[at:])
                self.held += len(path) - at
            else:
                edge, same = self.edge[node], 1  # the first hash is equal; equal hashes form a prefix of the edge
                low, high = 1, min(len(edge), len(path) - at)
                while low < high:
                    same = (low + high + 1) // 2
                    low, high = (same, high) if edge[same - 1] == path[at + same - 1] else (low, same - 1)
                same = low
                if same < len(edge):
                    self._split(node, same)
                    node = self.parent[node]
                if len(path) > at + same:
                    node = self._add(node, at + same, path[at + same:], words[at + same:])
                    self.held += len(path) - at - same
        else:
            node = above
        self.members[node] += members
        self.smallest[node] = smallest if self.smallest[node] is None else min(smallest, self.smallest[node])

    def _split(self, node: int, same: int) -> None:
        edge, words, top = self.edge[node], self.words[node], self.top[node]
        upper = self._add(self.parent[node], top, edge[:same], words[:same])
        self.parent[node], self.top[node], self.edge[node], self.words[node] = upper, top + same, edge[same:], words[same:]
        self.child[edge[same]] = node
        self._hold(node)

    def insert_batch(self, rows: list[tuple]) -> None:
        """(path, words, conversation) rows: equal paths once, located together, inserted by exit."""
        once: dict[bytes, list] = {}
        for path, words, name in rows:
            seen = once.setdefault(path[-1] if path else ROOT, [path, words, 0, name])
            seen[2] += 1
            seen[3] = min(seen[3], name)
        groups: dict[int, list] = {}
        for entry in once.values():
            groups.setdefault(self.exit_parent(entry[0]), []).append(entry)
        for start, entries in groups.items():
            for path, words, members, smallest in entries:
                self.insert(self.exit_parent(path, start), path, words, members, smallest)

    def expanded(self) -> Iterator[tuple]:
        """(prefix, parent prefix, depth, members, smallest member, words) of every depth, counted below it as well."""
        members, smallest = self.members[:], self.smallest[:]
        for node in sorted(range(1, len(self.top)), key=self.depth.__getitem__, reverse=True):
            up = self.parent[node]
            members[up] += members[node]
            smallest[up] = smallest[node] if smallest[up] is None else min(smallest[up], smallest[node])
        if members[0]:
            yield ROOT, None, 0, members[0], smallest[0], 0
        for node in range(1, len(self.top)):
            before = self.edge[self.parent[node]][-1] if self.parent[node] else ROOT
            for i, (prefix, words) in enumerate(zip(self.edge[node], self.words[node])):
                yield prefix, before, self.top[node] + i + 1, members[node], smallest[node], words
                before = prefix


def _turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns): a 128-bit mark and a word count per turn, in order.  Texts are not moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    return (df.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint"), turn.alias("turn"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["mark"].alias("mark"), t["words"].alias("words"))).alias("turns")))


def rebuilt(df: DataFrame, every: int = 20, parts: int = 4) -> DataFrame:
    """(conv_id, turns) of each conversation c, its first h turns taken from conversation c - c % every.

    h is crc32 of the decimal id, modulo ``parts``.  A base that is absent gives
    no turns.  Rows without a conv_id belong to no conversation and are left out.
    """
    own = settle(_turns(df))
    base = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, parts - 1).alias("_first")).filter(F.col("_base") % every == 0)
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % parts).cast("int")
    rest = F.expr("filter(turns, (t, i) -> i >= _taken)")
    return (own.withColumn("_taken", taken).withColumn("_base", F.col("conv_id") - F.col("conv_id") % every)
            .join(base, "_base", "left")
            .select("conv_id", F.concat(F.coalesce(F.expr("slice(_first, 1, _taken)"), F.array().cast(own.schema["turns"].dataType)), rest).alias("turns")))


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns) as given: ordered by turn, NULL first, equal turns by their hash; NULL role and text are empty."""
    return _turns(df)


def _paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, path, words): the hash of every prefix, the empty one first."""
    def start():
        def work(columns):
            out = []
            for name, marks, words in zip(*columns):
                path, at = [ROOT], ROOT
                for mark in marks:
                    at = hashlib.md5(at + mark).digest()
                    path.append(at)
                out.append((name, path, words))
            return out
        return work

    return map_rows(sequences, {"conv_id": F.col("conv_id"), "marks": F.col("turns.mark"), "words": F.col("turns.words")},
                    "conv_id bigint, path array<binary>, words array<int>", start)


def _partial_tries(paths: DataFrame) -> DataFrame:
    schema = "prefix binary, parent binary, depth int, n_convs bigint, conv_id bigint, words int"
    arrow = pa.schema([("prefix", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("n_convs", pa.int64()),
                       ("conv_id", pa.int64()), ("words", pa.int32())])

    def emitted(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in trie.expanded():
            rows.append(row)
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                names, found, words = (c.to_pylist() for c in part.columns)
                trie.insert_batch([(p[1:], w, n) for p, w, n in zip(found, words, names)])
                if trie.held > MAX_HELD:
                    yield from emitted(trie)
                    trie = ZFastTrie()
        yield from emitted(trie)

    return paths.select("conv_id", "path", "words").mapInArrow(run, schema)


def _ends(paths: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of the conversations that end at a node.

    The digest is of one ordered list, so one task reads it; ids reach it packed
    4,096 at most to a row and are hashed as they come.
    """
    packed = (paths.groupBy(F.element_at("path", -1).alias("prefix"), F.shiftright("conv_id", 12).alias("part"))
              .agg(F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids")))
    ordered = packed.repartition(F.col("prefix")).sortWithinPartitions("prefix", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for prefix, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix == at:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = prefix, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["prefix", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["prefix", "ends_sha256"])

    return ordered.mapInArrow(run, "prefix binary, ends_sha256 string")


def _parents(nodes: DataFrame, total: int) -> DataFrame:
    """(prefix, parent_conv_id) of the nodes that another conversation's node is above.

    One row a conversation at most: below its first own node it owns the parents too.
    The few nodes with very many children are broadcast, the rest joined by hash.
    """
    top = (nodes.filter("depth > 0").groupBy("conv_id").agg(F.min_by(F.struct("prefix", "parent"), "depth").alias("_n"))
           .select("_n.prefix", F.col("_n.parent").alias("_up")))
    up = nodes.select(F.col("prefix").alias("_up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = F.col("n_children") * HEAVY > total
    wide = F.broadcast(up.filter(heavy).drop("n_children"))
    return (top.join(wide, "_up").select("prefix", "parent_conv_id")
            .unionByName(top.join(wide, "_up", "left_anti").join(up.filter(~heavy), "_up").select("prefix", "parent_conv_id")))


def build(sequences: DataFrame) -> DataFrame:
    """One row per trie node of (conv_id, turns) sequences with distinct ids, as ``rebuilt`` and ``conversations`` return.

    (prefix, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): ``prefix`` is the hash of the node's turns, conv_id its
    smallest member.  Turns are equal when role and text are, judged by 128-bit
    hashes.  A sequence without turns ends at the root.  No sequence: no row.
    """
    paths = settle(_paths(sequences))
    merged = settle(_partial_tries(paths).groupBy("prefix").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.any_value("words").alias("words")))
    children = merged.filter("depth > 0").groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(merged.join(children, "prefix", "left").fillna(0, ["n_children"])
                   .withColumn("_saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("_leaf", (F.col("n_children") == 0).cast("bigint")))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    inside = nodes.select("prefix", F.sum("_saved").over(below).alias("_saved"), F.sum("_leaf").over(below).alias("_leaf"))
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("_from"), F.sum("_saved").alias("_saved"), F.sum("_leaf").alias("_leaf"))
    above = (owned.join(paths.select("conv_id", "path"), "conv_id")
             .select(F.explode(F.expr("slice(path, 1, _from)")).alias("prefix"), "_saved", "_leaf"))
    sums = inside.unionByName(above).groupBy("prefix").agg(F.sum("_leaf").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    first = Window.partitionBy("conv_id").orderBy("depth")
    own_parent = nodes.select("prefix", "conv_id", "depth", "n_convs", "n_children", F.lag("conv_id").over(first).alias("_own"))
    return (own_parent.join(sums, "prefix").join(_ends(paths), "prefix", "left").join(_parents(nodes, nodes.count()), "prefix", "left")
            .select("prefix", "conv_id", F.col("depth").cast("bigint").alias("depth"),
                    F.coalesce("_own", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


#: The query op11 in DuckDB: nodes as lists of turn hashes, crc32 worked out bit by bit.
SQL = """
WITH turn AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
marked AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS mark, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turn),
own AS (SELECT conv_id, list({'m': mark, 'w': words} ORDER BY turn NULLS FIRST, mark) AS turns,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
   lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
     lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) AS c FROM marked GROUP BY conv_id),
taken AS (SELECT conv_id, turns, xor(c, 4294967295) % 4 AS h FROM own),
made AS (SELECT t.conv_id, coalesce(b.turns, [])[1:h::INT] || t.turns[h::INT + 1:] AS turns FROM taken t LEFT JOIN own b ON b.conv_id = t.conv_id - t.conv_id % 20),
step AS (SELECT conv_id, d, turns[1:d::INT] AS node, CASE WHEN d > 0 THEN turns[d::INT].w ELSE 0 END AS w, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM made)),
keyed AS (SELECT conv_id, d, md5(d || node::VARCHAR) AS k, CASE WHEN d > 0 THEN md5((d - 1) || node[1:d::INT - 1]::VARCHAR) END AS up, w, ends FROM step),
node AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM keyed GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
own_saved AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * w AS saved FROM node LEFT JOIN kids USING (k)),
over_paths AS (SELECT DISTINCT a.k, n.k AS below, n.saved, n.n_children FROM own_saved n JOIN keyed e ON e.conv_id = n.conv_id AND e.d = n.depth
  JOIN keyed a ON a.conv_id = n.conv_id AND a.d <= n.depth),
sums AS (SELECT k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM over_paths GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM own_saved n JOIN sums s USING (k) LEFT JOIN node p ON p.k = n.up
"""
