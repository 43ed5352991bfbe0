"""Prefix trie of conversations by union-find over neighbours in sorted order.

Conversations become sequences of turn names (16 bytes of a digest). Equal sequences are one class; classes are sorted
by range, so each partition holds a stretch of the sorted order. Sorted neighbours are linked by the number of leading
turns they share, and a partition's links are worked off from the deepest on: union-find joins the two components
of a link, and every such merge makes the branching node of that depth. A component on its way up passes the
nodes on its edge, one per turn.

A node is final unless it lies on the path of the partition's first or last sequence, since only those may go on in
the neighbouring partitions. So a partition contracts to at most two paths that carry the sums of all that hangs from
them. The paths of neighbouring partitions are merged by the same procedure, a bounded number of partitions at a time,
until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradearea.sources.scratch import cut

NAME = 16
#: partitions merged by one task of a round
MERGED = 16
#: turns per partition of the sorted order, and ids per piece of a class
TURNS, IDS = 250_000, 4096
SALTS = 8
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_name(role: Column, text: Column) -> Column:
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, NAME)


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, names, sizes): the turn names of each conversation in order, and the bytes of each turn's text.

    Turns go by number (null first), then role, then text. Null role and text are empty. Turns that repeat count each; rows
    without conversation id belong to none. A conversation's names are one row (16 bytes a turn, no texts).
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("t"), r.alias("r"), t.alias("x"), turn_name(r, t).alias("name"), F.octet_length(t).cast("bigint").alias("size"))
    # turns whose number repeats are put in order by their role and text, which then travel no further
    placed = rows.groupBy("conv", "t").agg(F.array_sort(F.collect_list(F.struct("r", "x", "name", "size"))).alias("_x")).select(
        "conv", F.struct("t", F.transform("_x", lambda x: x["name"]).alias("names"), F.transform("_x", lambda x: x["size"]).alias("sizes")).alias("_t"))
    listed = placed.groupBy("conv").agg(F.sort_array(F.collect_list("_t")).alias("_l"))
    return listed.select("conv", F.flatten(F.transform("_l", lambda x: x["names"])).alias("names"), F.flatten(F.transform("_l", lambda x: x["sizes"])).alias("sizes"))


def rebuilt(own: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation with its first `head` turns taken from another one: both expressions over conv_id.

    Fewer turns there give a shorter head, an absent conversation an empty one.
    """
    named = own.withColumnRenamed("conv", "conv_id").withColumns({"_base": base, "_h": head})
    wanted = named.select("_base").distinct()
    heads = own.join(wanted.withColumnRenamed("_base", "conv"), "conv", "left_semi").select(
        F.col("conv").alias("_base"), F.col("names").alias("_names"), F.col("sizes").alias("_sizes"))
    met = named.join(heads, "_base", "left")

    def mixed(first: str, rest: str, kind: str) -> Column:
        return F.concat(F.slice(F.coalesce(F.col(first), F.array().cast(kind)), F.lit(1), F.col("_h")), F.slice(F.col(rest), F.col("_h") + 1, F.size(rest)))

    return met.select(F.col("conv_id").alias("conv"), mixed("_names", "names", "array<binary>").alias("names"), mixed("_sizes", "sizes", "array<bigint>").alias("sizes"))


def classes(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence: seq (its names in a row), sizes, n conversations, least id, ends (digest of its ids).

    The ids of a class are joined in pieces by tasks of their own; one pass over the pieces, in order, makes the digest.
    """
    joined = convs.select("conv", F.coalesce(F.concat_ws("", F.transform("names", F.hex)), F.lit("")).alias("_hex"), "sizes")
    rows = cut(joined.select("conv", F.unhex("_hex").alias("seq"), F.sha2(F.col("_hex").cast("binary"), 256).alias("name"), "sizes"), "sequences")
    pieces = rows.groupBy("name", F.shiftright(F.col("conv").cast("bigint"), IDS.bit_length() - 1).alias("bucket")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.col("conv").cast("bigint"))), lambda c: c.cast("string")), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"), F.min(F.col("conv").cast("bigint")).alias("least"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hasher, n, least, out = None, None, 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["name"] != name:
                    if name is not None:
                        out.append((name, n, least, hasher.hexdigest()))
                    name, hasher, n, least = r["name"], hashlib.sha256(r["ids"].encode()), 0, r["least"]
                else:
                    hasher.update(b"," + r["ids"].encode())
                n += r["n"]
            if len(out) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["name", "n", "least", "ends"])
                out = []
        if name is not None:
            out.append((name, n, least, hasher.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["name", "n", "least", "ends"])

    found = pieces.repartition("name").sortWithinPartitions("name", "bucket").mapInArrow(digests, "name string, n bigint, least bigint, ends string")
    heads = rows.select(F.col("conv").cast("bigint").alias("least"), "seq", "sizes")
    return found.join(heads, "least").select("seq", "sizes", "n", "least", "ends")


class Part:
    """A component of neighbours: its node at `depth`, what is below it, and what its path still carries above.

    `carried` has per depth (n, least, kids, leaves, saved, ends) of nodes that an earlier step left open.
    """

    __slots__ = ("seq", "sizes", "depth", "n", "least", "kids", "leaves", "saved", "ends", "rows", "carried", "open")

    def __init__(self, seq, sizes, carried, is_open):
        self.seq, self.sizes, self.carried, self.open = seq, sizes, carried, is_open
        self.depth = len(sizes)
        self.rows: list[int] = []
        self.n, self.least, self.kids, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None
        if not is_open:
            self.take(carried.pop(self.depth, None))

    def take(self, more) -> None:
        """Add what hangs from the same node."""
        if more:
            n, least, kids, leaves, saved, ends = more
            self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved
            self.least = least if self.least is None else self.least if least is None else min(self.least, least)
            self.ends = self.ends or ends


def added(a, b):
    """Sums of two carried nodes of the same place."""
    if not a or not b:
        return a or b
    least = a[1] if b[1] is None else b[1] if a[1] is None else min(a[1], b[1])
    return (a[0] + b[0], least, a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] or b[5])


def path_name(seq: bytes, depth: int) -> str:
    return hashlib.sha256(seq[:NAME * depth]).hexdigest()


def shared(a: bytes, b: bytes) -> int:
    """Leading turns that two sequences share."""
    least = min(len(a), len(b))
    if a[:least] == b[:least]:
        return least // NAME
    differ = np.frombuffer(a, np.uint8, least) != np.frombuffer(b, np.uint8, least)
    return int(differ.argmax()) // NAME


class Forest:
    """Merges sorted items (seq, sizes, carried) by descending links; `last` when no neighbours are left outside."""

    def __init__(self, items: list, last: bool, named: bool):
        self.rows: list[list] = []
        self.named = named
        end = len(items) - 1
        parts = [Part(seq, sizes, carried, not last and i in (0, end)) for i, (seq, sizes, carried) in enumerate(items)]
        links = [shared(a[0], b[0]) for a, b in zip(items, items[1:])]
        up = list(range(len(items)))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in sorted(range(len(links)), key=lambda k: -links[k]):
            a, b = find(i), find(i + 1)
            up[b] = a
            parts[a] = self.merged(parts[a], parts[b], links[i])
        self.left: list[Part] = []
        if items:
            if last:
                top = parts[find(0)]
                self.raised(top, 0)
                self.final(top)
            else:
                self.left = [parts[find(0)]]

    def final(self, p: Part) -> None:
        """The component's node is complete: its row, and its children learn their parent's conversation."""
        leaves, total = p.leaves if p.kids else 1, p.saved + ((p.n - 1) * p.sizes[p.depth - 1] if p.depth else 0)
        for r in p.rows:
            self.rows[r][2] = p.least
        p.rows = [len(self.rows)]
        self.rows.append([p.least, p.depth, None, p.n, p.kids, leaves, total, p.ends or EMPTY, path_name(p.seq, p.depth) if self.named else None, None])
        p.leaves, p.saved, p.kids, p.ends = leaves, total, 1, None

    def raised(self, p: Part, depth: int) -> None:
        """Move a closed component up its edge, node by node."""
        while p.depth > depth:
            self.final(p)
            p.depth -= 1
            p.take(p.carried.pop(p.depth, None))

    def hang(self, p: Part, q: Part, depth: int) -> None:
        """A closed component q becomes part of what the open path p carries from `depth` upwards."""
        if q.depth > depth:
            self.raised(q, depth + 1)
            self.final(q)
            got = (q.n, q.least, 1, q.leaves, q.saved, None)
        else:
            got = (q.n, q.least, q.kids, q.leaves, q.saved, q.ends)
        name = path_name(p.seq, depth) if q.rows else None
        for r in q.rows:
            self.rows[r][9] = name
        p.carried[depth] = added(p.carried.get(depth), got)
        for d, more in q.carried.items():
            p.carried[d] = added(p.carried.get(d), more)

    def merged(self, a: Part, b: Part, depth: int) -> Part:
        if a.open and b.open:
            # both ends of the stretch: one keeps what is above their parting, the other what is below
            for d in [d for d in b.carried if d <= depth]:
                a.carried[d] = added(a.carried.get(d), b.carried.pop(d))
            self.other = b
            return a
        if a.open or b.open:
            p, q = (a, b) if a.open else (b, a)
            self.hang(p, q, depth)
            return p
        for p in (a, b):
            self.raised(p, depth)
        if len(a.rows) < len(b.rows):
            a, b = b, a
        a.take((b.n, b.least, b.kids, b.leaves, b.saved, b.ends))
        a.rows += b.rows
        for d, more in b.carried.items():
            a.carried[d] = added(a.carried.get(d), more)
        return a

    def paths(self) -> list[tuple]:
        """What stays open, in sorted order: (seq, sizes, carried) of the first and the last sequence."""
        if not self.left:
            return []
        first = self.left[0]
        two = [first, self.other] if getattr(self, "other", None) else [first]
        return sorted(((p.seq, p.sizes, p.carried) for p in two), key=lambda p: p[0])


ROW = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, name string, parent_name string"
STRETCH = ROW + ", part bigint, seq binary, sizes array<bigint>, carried array<struct<depth:bigint,n:bigint,least:bigint,kids:bigint,leaves:bigint,saved:bigint,ends:string>>"
_FIELDS = [f.rsplit(" ", 1)[0].strip() for f in ROW.split(", ")]
_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in ROW.split(", ")]
_CARRIED = pa.list_(pa.struct([(f, pa.string() if f == "ends" else pa.int64()) for f in ("depth", "n", "least", "kids", "leaves", "saved", "ends")]))


def _table(forest: Forest, part: int) -> pa.Table:
    """Rows of final nodes, and of the paths that stay open."""
    left = forest.paths()
    none = len(forest.rows)
    columns = [pa.array([r[i] for r in forest.rows] + [None] * len(left), t) for i, t in enumerate(_TYPES)]
    carried = [[dict(zip(("depth", "n", "least", "kids", "leaves", "saved", "ends"), (d, *v))) for d, v in sorted(c.items()) if v] for _, _, c in left]
    return pa.table([
        *columns, pa.array([part] * (none + len(left)), pa.int64()), pa.array([None] * none + [p[0] for p in left], pa.binary()),
        pa.array([None] * none + [list(p[1]) for p in left], pa.list_(pa.int64())), pa.array([None] * none + carried, _CARRIED)],
        names=[*_FIELDS, "part", "seq", "sizes", "carried"])


def stretches(kinds: DataFrame, partitions: int) -> DataFrame:
    """Forests of the partitions of the sorted order: final nodes, and open paths tagged with their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            for seq, sizes, n, least, ends in zip(*[batch.column(c).to_pylist() for c in ("seq", "sizes", "n", "least", "ends")]):
                items.append((seq, sizes, {len(sizes): (n, least, 0, 0, 0, ends)}))
        yield from _table(Forest(items, False, False), TaskContext.get().partitionId()).to_batches(10000)

    return kinds.repartitionByRange(partitions, "seq").sortWithinPartitions("seq").mapInArrow(run, STRETCH)


def merged_paths(left: DataFrame, last: bool) -> DataFrame:
    """Open paths of neighbouring partitions, MERGED partitions at a time, as one; with `last`, the rest of the trie."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("part", "seq", "sizes", "carried")]), key=lambda r: (r[0], r[1]))
        items = [(seq, sizes, {c["depth"]: (c["n"], c["least"], c["kids"], c["leaves"], c["saved"], c["ends"]) for c in carried}) for _, seq, sizes, carried in rows]
        return _table(Forest(items, last, True), key[0].as_py())

    return left.groupBy(F.expr(f"part div {MERGED}").alias("_merged")).applyInArrow(run, STRETCH)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per distinct sequence of leading turns of `convs` (conv, names, sizes), from the empty one on.

    conv_id (smallest conversation that begins so), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    and saved_tokens (over the subtree with its top, (n_convs - 1) times the bytes of the last turn), ends_sha256 (digest of
    the ids, ascending, of the conversations that end there). Conversation ids are distinct whole numbers.
    An empty table gives no rows. A task holds about TURNS turns of names, or one conversation; very many equal conversations
    are one class from the start.
    """
    spark = convs.sparkSession
    kinds = cut(classes(convs), "classes")
    turns = kinds.agg(F.sum(F.size("sizes"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // TURNS + 1)
    steps = [cut(stretches(kinds, partitions), "stretches")]
    while True:
        last = partitions <= MERGED
        steps.append(cut(merged_paths(steps[-1].filter("seq is not null"), last), "merged"))
        partitions = -(-partitions // MERGED)
        if last:
            break
    nodes = steps[0]
    for step in steps[1:]:
        nodes = nodes.unionByName(step)
    nodes = nodes.filter("seq is null").select(*_FIELDS)
    # children of open paths learn their parent's conversation by its name; a parent may have very many
    known = steps[1].select("name", "conv_id")
    for step in steps[2:]:
        known = known.unionByName(step.select("name", "conv_id"))
    known = known.filter("name is not null").select(F.col("name").alias("parent_name"), F.col("conv_id").alias("_parent"), F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    told = nodes.filter("parent_name is not null").withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")).join(
        known, ["parent_name", "_salt"]).withColumn("parent_conv_id", F.col("_parent"))
    out = [c for c in _FIELDS if c not in ("name", "parent_name")]
    return nodes.filter("parent_name is null").select(*out).unionByName(told.select(*out))
