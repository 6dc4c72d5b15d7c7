"""N-gram Jaccard join by count vectors in an R-tree.

A document's 5-word shingles are hashed into groups; how often each group occurs
is a point with as many coordinates as there are groups. The overlap of two sets
is at most the sum of the smaller counts of each coordinate, and that of any two
boxes of points at most the sum of the smaller upper bounds. There are so many
groups (2^32) that points and boxes are sparse, so boxes of unlike documents
hardly share a coordinate and are parted high in the tree.

1. Documents that can have no partner stay out: of a linked pair both sets share
   some of their first shingles in the order of the hashes, so a document whose
   first shingles occur nowhere else is linked with nothing.
2. The rest are packed by their heaviest groups: points that share a shingle
   among the rarest fifth of their sets are packed together, as all linked ones
   do, and cut into subtrees of bounded size. A subtree is one task's work: tree,
   bounds, verification on the sets, then on the words themselves.
3. Subtrees that share such a shingle are joined in pairs, for what is not yet in
   one component.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import common
from palimpsest.llm.components import components

SHINGLE = 5
#: Of a set the first n / MORE shingles beyond the first fifth are looked at to tell which documents may have a partner.
MORE = 8
#: Points of a leaf, children of a node.
LEAF, FAN = 32, 8
#: Points and shingles of a subtree; a larger document is a subtree by itself.
POINTS, SHINGLES = 4096, 1 << 18
#: Text that is hashed at once.
BLOCK = 1 << 20

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def enough(both: int, a: int, b: int) -> bool:
    """Jaccard similarity 0.8 or more of sets of a and b members with `both` common ones."""
    return both > 0 and 100 * both >= 80 * (a + b - both)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets of hashes."""
    return enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))


def words_linked(a: str, b: str) -> bool:
    """Of the shingles of two texts, compared as words."""
    sets = []
    for text in (a, b):
        w = _WORD.findall(text.encode().translate(_LOWER))
        sets.append({tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))})
    return enough(len(sets[0] & sets[1]), len(sets[0]), len(sets[1]))


def identity(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _sets(col: pa.Array) -> list[np.ndarray]:
    return common.shingle_sets(col, SHINGLE)


def describe(docs: DataFrame) -> DataFrame:
    """__id, th and th2 (digests of the text), sid and sid2 (identity of the set), n of every document."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__text", BLOCK):
            sets = _sets(block.column(3))
            who = [identity(s) for s in sets]
            made = [pa.array([w[0] for w in who], pa.int64()), pa.array([w[1] for w in who], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*block.columns[:3], *made], names=["__id", "th", "th2", "sid", "sid2", "n"])

    return docs.select("__id", *_digests(), "__text").mapInArrow(run, f"__id {kind}, th long, th2 long, sid long, sid2 long, n long")


def _digests() -> list:
    return [F.xxhash64("__text").alias("th"), F.xxhash64(F.lit(7), "__text").alias("th2")]


def beyond(n: int) -> int:
    """How many of its first shingles a set of n members must share with a partner that looks at as many or more."""
    return 1 + n // MORE


def suspects(docs: DataFrame) -> DataFrame:
    """sid of the sets that may have a partner.

    Two linked sets of a and b members share l of the first a // 5 + l and b // 5 + l of the hashes, for any l. Each
    set looks at its first n // 5 + beyond(n); a partner has 0.8 n members at least, so beyond(0.8 n) of them occur in
    another set's. Counts are upper bounds, as copies of a set in several blocks may be counted more than once. Of the
    sets of a block that share a hash only two are dealt out, so no hash becomes one task's burden.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__text", 4 * BLOCK):
            known: dict[int, tuple[np.ndarray, int]] = {}
            for part in common.blocks([block], "__text", BLOCK):
                for s in _sets(part.column(0)):
                    if len(s):
                        known.setdefault(identity(s)[0], (s[: len(s) // 5 + beyond(len(s))], beyond(-(-4 * len(s) // 5))))
            if not known:
                continue
            parts = [p for p, _ in known.values()]
            sids, need = np.fromiter(known, np.int64, len(known)), np.array([k for _, k in known.values()], np.int64)
            cell, at = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(cell, kind="stable")
            cell, at = cell[order].view(np.int64), at[order]
            same = cell[1:] == cell[:-1]
            inner = np.zeros(len(cell), bool)
            inner[1:-1] = same[1:] & same[:-1]  # neither the first nor the last of a hash
            here = np.bincount(at[inner], minlength=len(sids))
            cell, at = cell[~inner], at[~inner]
            none = np.zeros(len(cell), np.int32)
            own = common.mix(sids.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cell, own])), pa.array(np.concatenate([sids[at], sids])), pa.array(np.concatenate([none, here]).astype(np.int32)), pa.array(np.concatenate([none, need]).astype(np.int32))],
                names=["cell", "sid", "here", "need"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell and sid; a batch's last row waits for what follows it.
        last = (None, None, False)

        def made(sid, c, need):
            return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(c.astype(np.int64)), pa.array(need.astype(np.int64))], names=["sid", "c", "need"])

        for batch in batches:
            cell, sid, here, need = (np.asarray(batch.column(k)) for k in range(4))
            own = need > 0
            yield made(sid[own], here[own], need[own])
            cell, sid = cell[~own], sid[~own]
            if last[0] is not None:
                cell, sid = np.append(last[0], cell), np.append(last[1], sid)
            if not len(cell):
                continue
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (sid[1:] != sid[:-1])
            cell, sid = cell[new], sid[new]
            shared = np.zeros(len(cell), bool)
            shared[1:] = cell[1:] == cell[:-1]
            shared[:-1] |= shared[1:]
            shared[0] |= last[2]
            last = (cell[-1], sid[-1], bool(shared[-1]))
            found, c = np.unique(sid[:-1][shared[:-1]], return_counts=True)
            yield made(found, c, np.zeros(len(found)))
        if last[2]:
            yield made(np.array([last[1]], np.int64), np.ones(1), np.zeros(1))

    rows = docs.select("__text").where("__text is not null").mapInArrow(emit, "cell long, sid long, here int, need int")
    found = rows.repartition(F.col("cell")).sortWithinPartitions("cell", "sid").mapInArrow(count, "sid long, c long, need long")
    return found.groupBy("sid").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("sid")


def members_of(texts: DataFrame) -> DataFrame:
    """cell, sid, n, m, first: which sets of texts (sid, n, text) have a shingle (cell) among the first n // 5 + 1 of
    their set, rare ones first; m sets have it, of which first is the smallest. Only shingles with two sets at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text", BLOCK):
            sets = _sets(block.column(2))
            size = [len(s) for s in sets]
            cells = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.repeat(np.asarray(block.column(0)), size)), pa.array(np.repeat(size, size).astype(np.int32))], names=["cell", "sid", "n"])

    rows = texts.select("sid", "n", "text").mapInArrow(run, "cell long, sid long, n int")
    df = rows.groupBy("cell").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("sid")
    ranked = rows.join(df, "cell").withColumn("__k", F.row_number().over(own.orderBy("df", "cell"))).withColumn("__c", F.count("*").over(own))
    # The others of a set's n shingles occur nowhere else and come before these.
    rare = common.written(ranked.where(F.col("__k") + F.col("n") - F.col("__c") <= F.floor(F.col("n") / 5) + 1).select("cell", "sid", "n"), "rare")
    cells = rare.groupBy("cell").agg(F.count("*").alias("m"), F.min("sid").alias("first")).where("m > 1")
    return common.written(rare.join(cells, "cell"), "members")


def packed(members: DataFrame) -> DataFrame:
    """sid, block, at (place in the block) of every member: blocks are runs of like points, of bounded size. Points that hang together by
    shared cells come next to each other, then those with the same most frequent cell, then those of like size."""
    hang = components(members.where("sid <> first").select(F.col("first").alias("u"), F.col("sid").alias("v")))
    home = members.groupBy("sid").agg(F.max(F.struct("m", "cell"))["cell"].alias("home"), F.first("n").alias("n"))
    points = common.written(home.join(hang, home["sid"] == hang["id"]).select("sid", "n", "home", F.col("root").alias("bundle")), "points")
    sizes = points.groupBy("bundle").agg(F.count("*").alias("many"), F.sum("n").alias("much"))
    points = points.join(sizes, "bundle").withColumn("wide", F.when((F.col("many") > POINTS) | (F.col("much") > SHINGLES), F.col("home")))
    order = ["bundle", "wide", "home", "n", "sid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, count, total = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            out, places = [], []
            for sid, n, bundle, many, much in zip(*(batch.column(k).to_pylist() for k in range(5))):
                # A bundle that fits into a block is not cut.
                ahead = (many, much) if bundle != last else (1, n)
                fits = ahead[0] <= POINTS and ahead[1] <= SHINGLES
                if count and ((fits and (count + ahead[0] > POINTS or total + ahead[1] > SHINGLES)) or (not fits and bundle != last) or count + 1 > POINTS or total + n > SHINGLES):
                    block, count, total = block + 1, 0, 0
                last, count, total = bundle, count + 1, total + n
                out.append(block)
                places.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), pa.array(places, pa.int64())], names=["sid", "block", "at"])

    rows = points.repartitionByRange(F.col("bundle"), F.col("wide")).sortWithinPartitions(*order)
    return common.written(rows.select("sid", "n", "bundle", "many", "much").mapInArrow(run, "sid long, block long, at long"), "blocks")


class Points:
    """The points of one task: sets, their group counts, texts, and which component each is in."""

    def __init__(self, sid: list[int], root: list[int], text: list[str]) -> None:
        self.sid, self.text = sid, text
        self.sets = []
        for part in common.blocks([pa.RecordBatch.from_arrays([pa.array(text, pa.large_string())], names=["t"])], "t", BLOCK):
            self.sets += _sets(part.column(0))
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.label = np.unique(np.array(root, np.int64), return_inverse=True)[1]
        self.groups = []
        for s in self.sets:
            g, c = np.unique((s >> np.uint64(32)).astype(np.uint32), return_counts=True)
            self.groups.append((g, c.astype(np.uint16)))

    def join(self, a: int, b: int) -> bool:
        """Whether two points are linked; then their components become one."""
        if not linked(self.sets[a], self.sets[b]) or not words_linked(self.text[a], self.text[b]):
            return False
        self.label[self.label == self.label[b]] = self.label[a]
        return True


class RTree:
    """Sparse points in leaves in the order given; a node keeps the coordinatewise maximum of the counts below it, the
    least and the greatest size."""

    def __init__(self, points: Points, members: np.ndarray) -> None:
        self.points, self.members = points, members
        self.nodes: list[tuple] = []  # children, first and last member, groups, greatest counts, least and greatest size
        self.dense: dict[int, np.ndarray] = {}
        level = []
        for k in range(0, len(members), LEAF):
            some = members[k : k + LEAF]
            level.append(self._node(None, k, k + len(some), [points.groups[i] for i in some], [points.n[i] for i in some], [points.n[i] for i in some]))
        while len(level) > 1:
            above = []
            for k in range(0, len(level), FAN):
                kids = level[k : k + FAN]
                low, high = self.nodes[kids[0]][1], self.nodes[kids[-1]][2]
                above.append(self._node(kids, low, high, [self.nodes[i][3:5] for i in kids], [self.nodes[i][5] for i in kids], [self.nodes[i][6] for i in kids]))
            level = above
        self.root = level[0] if level else None

    def _node(self, kids, low, high, boxes, least, most) -> int:
        groups, counts = np.concatenate([g for g, _ in boxes]), np.concatenate([c for _, c in boxes])
        order = np.argsort(groups, kind="stable")
        groups, counts = groups[order], counts[order]
        start = np.nonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))[0]
        self.nodes.append((kids, low, high, groups[start], np.maximum.reduceat(counts, start), min(least), max(most)))
        return len(self.nodes) - 1

    def matrix(self, leaf: int) -> np.ndarray:
        """Counts of a leaf's points, a row each, over the groups of its box."""
        if leaf not in self.dense:
            if len(self.dense) >= FAN:
                self.dense.clear()
            _, low, high, groups, *_ = self.nodes[leaf]
            out = np.zeros((high - low, len(groups)), np.uint16)
            for row, i in enumerate(self.members[low:high]):
                g, c = self.points.groups[i]
                out[row, np.searchsorted(groups, g)] = c
            self.dense[leaf] = out
        return self.dense[leaf]


def tree_links(a: RTree, b: RTree) -> list[tuple[int, int]]:
    """Links that join components, between the points of two trees or (a is b) within one."""
    points, out = a.points, []
    stack = [] if a.root is None or b.root is None else [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        kx, lx, hx, gx, cx, nx, mx = a.nodes[x]
        ky, ly, hy, gy, cy, ny, my = b.nodes[y]
        ix, iy = a.members[lx:hx], b.members[ly:hy]
        one = points.label[ix[0]]
        if (points.label[ix] == one).all() and (points.label[iy] == one).all():
            continue
        own = a is b and x == y
        if not own:
            if 5 * mx < 4 * ny or 5 * my < 4 * nx:
                continue
            at = np.minimum(np.searchsorted(gy, gx), len(gy) - 1)
            both = gy[at] == gx
            at = at[both]
            if 9 * int(np.minimum(cx[both], cy[at]).sum(dtype=np.int64)) < 4 * (nx + ny):
                continue
        if kx is not None and (ky is None or own or len(kx) >= len(ky)):
            stack += [(p, q) for k, p in enumerate(kx) for q in kx[k:]] if own else [(p, y) for p in kx]
        elif ky is not None:
            stack += [(x, q) for q in ky]
        else:
            left, right = (a.matrix(x), b.matrix(y)) if own else (a.matrix(x)[:, both], b.matrix(y)[:, at])
            bound = np.zeros((len(ix), len(iy)), np.float32)
            for t in range(1, int(min(left.max(initial=0), right.max(initial=0))) + 1):
                bound += (left >= t).astype(np.float32) @ (right >= t).astype(np.float32).T
            na, nb = points.n[ix][:, None], points.n[iy][None]
            ok = (9 * bound >= 4 * (na + nb)) & (5 * na >= 4 * nb) & (5 * nb >= 4 * na)
            if own:
                ok &= np.arange(len(ix))[:, None] < np.arange(len(iy))[None]
            p, q = np.nonzero(ok)
            for k in np.argsort(-bound[p, q] / (na[p, 0] + nb[0, q]), kind="stable"):
                i, j = int(ix[p[k]]), int(iy[q[k]])
                if points.label[i] != points.label[j] and points.join(i, j):
                    out.append((points.sid[i], points.sid[j]))
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of one key (the first `keys` columns) each, of sorted batches."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(int(c[a]) for c in columns)
            if held and key != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    common.give_back()


def linked_in_blocks(rows: DataFrame) -> DataFrame:
    """u, v: links that join components, of rows i, j, block, at, sid, root, text: the points of block i among
    themselves where i = j, else those of block i with those of block j. Rows of a group come in the order of at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            points = Points(*(t.column(k).to_pylist() for k in (4, 5, 6)))
            block, at = np.asarray(t.column(2)), np.arange(t.num_rows)
            i, j = t.column(0)[0].as_py(), t.column(1)[0].as_py()
            first = RTree(points, at[block == i])
            found = np.array(tree_links(first, first if i == j else RTree(points, at[block == j])), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    rows = rows.select("i", "j", "block", "at", "sid", "root", "text").repartition("i", "j").sortWithinPartitions("i", "j", "block", "at", "sid")
    return common.written(rows.mapInArrow(run, "u long, v long"), "links")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (key), n_shingles, component_id for every row of docs.

    Linked: Jaccard similarity of the sets of 5-word shingles 0.8 or more; component_id is the smallest key of all that
    links reach. Null or empty texts and texts without words have no shingles and are linked with nothing; their
    component is their own key. Documents with equal sets are one set in the search. A null key counts as no smallest
    key, so a component of null keys only has a null id. Repeated rows are linked. An empty table gives no rows.
    Shingles are 64-bit hashes of their words and sets are told by 128 bits; a link between different sets is taken
    only after its words are compared.
    """
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    with common.scratch(docs.sparkSession):
        meta = common.written(describe(rows), "meta", hold=True)
        classes = common.written(_classes(rows, meta), "classes", hold=True)
    out = meta.join(classes, ["sid", "sid2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _classes(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """sid, sid2, component of every set."""
    few = common.written(suspects(rows), "suspects")
    # One text of each set stands for it.
    points = meta.where("n > 0").join(few, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("th", "th2", "n")).alias("p")).select("sid", "p.*")
    points = common.written(points, "chosen")
    some = rows.select("__text", *_digests()).where(common.Filter.of(points, "th").column(F.col("th")))
    texts = some.groupBy("th", "th2").agg(F.first("__text").alias("text")).join(points, ["th", "th2"]).select("sid", "n", "text")
    texts = common.written(texts, "texts")

    members = members_of(texts)
    placed = packed(members)
    alone = F.col("block").alias("i"), F.col("block").alias("j")
    links = linked_in_blocks(texts.join(placed, "sid").select(*alone, "block", "at", "sid", F.col("sid").alias("root"), "text"))
    links = links.unionByName(_across(members, placed, texts, links))
    final = components(links)

    least = meta.where("n > 0").groupBy("sid", "sid2").agg(F.min("__id").alias("least"))
    named = least.join(final, least["sid"] == final["id"], "left").select("sid", "sid2", "least", "root")
    together = named.where("root is not null")
    whole = together.groupBy("root").agg(F.min("least").alias("component"))
    alike = named.where("root is null").select("sid", "sid2", F.col("least").alias("component"))
    return together.join(whole, "root").select("sid", "sid2", "component").unionByName(alike)


def _across(members: DataFrame, placed: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """Links between points of different blocks that share a cell and are not yet in one component."""
    spread = members.select("cell", "sid").join(placed, "sid")
    several = spread.groupBy("cell").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x < y").select("cell")
    spread = common.written(spread.join(several, "cell"), "spread")
    if spread.isEmpty():
        return links.limit(0)
    roots = components(links)
    spread = spread.join(roots, spread["sid"] == roots["id"], "left").select("cell", "sid", "block", "at", F.coalesce("root", "sid").alias("root"))
    open_cells = spread.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("cell")
    spread = common.written(spread.join(open_cells, "cell"), "open")
    held = spread.select("cell", "block").distinct()
    pairs = held.select("cell", F.col("block").alias("i")).join(held.select("cell", F.col("block").alias("j")), "cell").where("i < j").select("i", "j").distinct()
    pairs = common.written(pairs, "pairs")
    points = spread.select("block", "sid", "at", "root").distinct()
    dealt = pairs.join(points, pairs["i"] == points["block"]).unionByName(pairs.join(points, pairs["j"] == points["block"]))
    return linked_in_blocks(dealt.join(texts.select("sid", "text"), "sid"))


def op10_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.load(spark, sf_dir, "documents").select("doc_id", "text"))
