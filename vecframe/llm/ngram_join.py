"""N-gram Jaccard join by prefix trees.

Equal n-gram sets are one class.  A first pass finds blocks: sets of similar size are cut by hash into so many parts that
any two similar enough must agree in most of at least one part (pigeonhole), and sets that agree so are in one block, as
are those that are linked so through others.  Every link therefore lies within a block, and blocks are about as small as
the groups of near copies themselves.  N-grams that very many sets have (a line that opens thousands of texts) would chain sets that have
little else in common, the more of them the larger the table: parts are made of the others, where a set has enough of those.  In a block the sets, in one order of n-grams, are stored in a prefix tree: its
shared beginnings share their partial overlaps with all sets that are looked up, and a branch is left as soon as the
overlap can't reach the bound with what remains, or all that is below belongs to the component of the asking set.
Blocks of more than BLOCK_SETS sets are cut into portions that different tasks join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import stage, workers_of
from .components import connected_components, forest
from .elias_fano import pack, pack_sorted, unpack, unpack_sorted
from .memory import using
from .words import mix, numbered, words

#: Sets, and n-grams, of one portion of a block.
BLOCK_SETS, BLOCK_GRAMS = 250, 200_000
#: Keys that a task combines before it sends them on.
RUN_PARTS = 1_000_000
#: One part in so many is spare; ways of dealing out sets that leave too many places empty.
SPARE_PARTS, DEALS = 12, 6
#: The first ways of dealing leave out common n-grams: those that one in COMMON_SHARE sets has, as about COMMON_SETS sets
#: of all kinds show, and no more of them than COMMON_MOST.  They say which keys tell little, and never decide on a link.
COMMON_DEALS, COMMON_SHARE, COMMON_SETS, COMMON_MOST = 3, 1000, 10_000, 100_000
#: Differences in a part, and places of a part, of each turn.
TURNS = ((1, 4), (2, 6))
#: Ranges of keys that meet on their own: at least so many, so that small and large tables repeat edges alike, and no more
#: keys in one (about) than this; ranges that a task has at most, where they are many.
LEAST_BUCKETS, BUCKET_KEYS, BUCKETS_A_TASK = 256, 1 << 21, 5
#: Places that the rows of one block are dealt to where they learn about the block.
SALTS = 32
#: Rows without an id are known by numbers from here on, made from their texts.
NAMELESS = 1 << 62


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The set of hashed n-grams of words of each text, sorted; with fewer words, the whole sequence; without words, none."""
    word, starts = numbered(texts)
    m = len(word) - n + 1
    gram = np.zeros(max(m, 0), "u8")
    for i in range(n):
        if m > 0:
            gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + word[i : i + m])
    out = []
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(gram[a : z - n + 1]))
        elif z > a:
            x = np.full(1, z - a, "u8")
            for w in word[a:z]:
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, "u8"))
    return out


def true_shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The same set, of the words themselves."""
    w = words(text)
    return set(zip(*[w[i:] for i in range(n)])) if len(w) >= n else {tuple(w)} if w else set()


class Bound:
    """Similarity of at least per_cent / 100: union and intersection of sets that link."""

    def __init__(self, per_cent: int):
        self.p = per_cent
        #: band k holds sizes from edges[k] up to edges[k + 1]; sets that link are in one band or in neighbours
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * 100 // self.p + 1)
        self._edges = np.array(self.edges)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self._edges, size, "right")) - 1

    def differences(self, band: int) -> int:
        """N-grams in which two sets that link, the larger of this band, can differ at most."""
        return 2 * (self.edges[band + 1] - 1) * (100 - self.p) // (100 + self.p)

    def overlap(self, a: np.ndarray | int, b: np.ndarray | int):
        """Least intersection of sets of these sizes that link."""
        return -((-self.p * (a + b)) // (100 + self.p))


def part_hashes(grams: np.ndarray, bound: Bound, turn: int = 0, common: np.ndarray | None = None) -> np.ndarray:
    """Keys of the set, for its own band and the next: any two sets that link have one in common.

    Hashing deals the n-grams out to places, some to a part.  There are so many parts that in one of them a pair that links
    differs in no more than slack n-grams, so that all its places but slack agree: a key for each choice of places to
    leave out.  Keys of empty places say nothing and are left out.  SPARE_PARTS more parts make up for that, unless both
    sets of a pair have more parts with such keys than those; such sets are dealt out anew, in up to DEALS ways.  Each
    turn deals independently, and later turns allow for more differences in larger parts: more keys, of more n-grams.

    common: sorted n-grams that the first COMMON_DEALS ways leave out.  Without them no two sets differ in more n-grams than
    with them, so that the argument holds as it does for whole sets; sets of which too little is left are dealt out whole.
    """
    slack, places = TURNS[turn]
    leave = np.array(list(combinations(range(places), slack)))
    out = []
    whole, rare = grams, grams
    if common is not None and len(common):
        at = np.searchsorted(common, grams)
        rare = grams[common[np.minimum(at, len(common) - 1)] != grams]
    k = bound.band(len(whole))
    for band in (k, k + 1):
        most = bound.differences(band)
        if not most:
            out.append(mix(mix(whole).sum(dtype="u8", keepdims=True) + np.uint64(band)))
            continue
        needed = most // (slack + 1) + 1
        spare = needed // SPARE_PARTS
        m = needed + spare
        for deal in range(DEALS):
            grams = rare if deal < COMMON_DEALS else whole
            seed = np.uint64((turn * 4096 + band) * 64 + deal)
            place = ((mix(grams ^ mix(np.full(1, seed + np.uint64(1)))) >> np.uint64(32)) * np.uint64(places * m) >> np.uint64(32)).astype("i8")
            filled = np.bincount(place, minlength=places * m).reshape(m, places)
            order = np.argsort(place, kind="stable")
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mix(grams[order] + seed), dtype="u8")])
            ends = np.concatenate([[0], np.cumsum(filled.reshape(-1))])
            content = (sums[ends[1:]] - sums[ends[:-1]]).reshape(m, places)
            tag = mix(np.arange(m * len(leave), dtype="u8").reshape(m, len(leave)) * np.uint64(1 << 32) + seed)
            keys = mix((content.sum(1, dtype="u8", keepdims=True) - content[:, leave].sum(2, dtype="u8")) ^ tag)
            some = filled.sum(1, keepdims=True) > filled[:, leave].sum(2)
            poor = int((~some).any(1).sum()) > spare
            last = poor and deal == DEALS - 1
            out.append(keys.reshape(-1) if last else keys[some])
            if not poor:
                break
    return np.concatenate(out)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Node:
    """A stretch of the prefix tree: n-grams on the way to it from its parent, the sets that end here, the sizes below."""

    __slots__ = ("children", "grams", "least", "most", "sets", "under")

    def __init__(self, grams: np.ndarray):
        self.grams, self.children, self.sets = grams, [], []
        self.least = self.most = 0
        self.under: list[int] = []


def tree(sets: list[np.ndarray], numbers: list[int]) -> Node:
    """The prefix tree of sets of ordered places."""
    order = sorted(numbers, key=lambda i: sets[i].tolist())

    def grow(part: list[int], depth: int) -> Node:
        # how far all sets of the part agree: the first and last of the sorted do
        a, z = sets[part[0]], sets[part[-1]]
        m = min(len(a), len(z))
        differ = np.flatnonzero(a[depth:m] != z[depth:m])
        common = depth + int(differ[0]) if len(differ) else m
        node = Node(a[depth:common])
        node.under = part
        sizes = [len(sets[i]) for i in part]
        node.least, node.most = min(sizes), max(sizes)
        at = 0
        while at < len(part) and len(sets[part[at]]) == common:
            node.sets.append(part[at])
            at += 1
        while at < len(part):
            head, to = sets[part[at]][common], at
            while to < len(part) and sets[part[to]][common] == head:
                to += 1
            node.children.append((part[at:to], common))
            at = to
        return node

    root = Node(np.zeros(0, "i8"))
    if not order:
        return root
    root = grow(order, 0)
    open_ = [root]
    while open_:
        node = open_.pop()
        node.children = [grow(p, d) for p, d in node.children]
        open_ += node.children
    return root


def trie_links(sets: list[np.ndarray], left: list[int], right: list[int], bound: Bound, all_links: bool = False, known: list | None = None, exact: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links between sets of left (which are looked up) and right (which are stored).

    Enough of them that the components are right; with all_links every one.  Sets with equal entries in known (None: no
    entry) are of one component from the start.  exact has the last word on each link.
    """
    grams, where = np.unique(np.concatenate([sets[i] for i in {*left, *right}]), return_counts=True)
    # One order for the block: frequent n-grams first, so that near copies share long beginnings.
    rank = np.empty(len(grams), "i8")
    rank[np.argsort(-where, kind="stable")] = np.arange(len(grams))
    placed = {i: np.sort(rank[np.searchsorted(grams, sets[i])]) for i in {*left, *right}}
    size = {i: len(x) for i, x in placed.items()}
    root = tree(placed, list(dict.fromkeys(right)))
    found: list[tuple[int, int]] = []
    union = Union(max([*left, *right]) + 1)
    if known:
        first: dict = {}
        for i in {*left, *right}:
            if known[i] is not None:
                union.join(i, first.setdefault(known[i], i))
    step = max(1, 8_000_000 // max(1, len(grams)))
    for begin in range(0, len(left), step):
        asking = np.array(left[begin : begin + step])
        has = np.zeros((len(grams), len(asking)), "u1")
        for k, i in enumerate(asking):
            has[placed[i], k] = 1
        sizes = np.array([size[i] for i in asking])
        stack = [(root, np.arange(len(asking)), np.zeros(len(asking), "i8"), 0)]
        while stack:
            node, rows, overlap, depth = stack.pop()
            if len(node.grams):
                overlap = overlap + has[node.grams][:, rows].sum(0, dtype="i8")
            depth += len(node.grams)
            for j in node.sets:
                need = bound.overlap(sizes[rows], size[j])
                for k in np.flatnonzero(overlap >= need):
                    i = int(asking[rows[k]])
                    if i != j and (all_links or union.root(i) != union.root(j)) and (exact is None or exact(i, j)):
                        union.join(i, j)
                        found.append((i, j))
            for child in node.children:
                # the most that can still be met: the rest of the asking set, and the rest of the longest set below
                reach = overlap + np.minimum(sizes[rows] - overlap, child.most - depth)
                keep = reach >= bound.overlap(sizes[rows], child.least)
                if not all_links and len(child.under) <= 8:
                    roots = {union.root(j) for j in child.under}
                    if len(roots) == 1:
                        one = roots.pop()
                        keep &= np.array([union.root(int(i)) != one for i in asking[rows]])
                if keep.any():
                    stack.append((child, rows[keep], overlap[keep], depth))
    return found


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, node, n_shingles, digest) of each row; the digest is null for the empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingles(_bytes(batch), n)
                digest = [blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "node", "n_shingles", "digest"])

    return docs.mapInArrow(work, "doc_id long, node long, n_shingles long, digest binary")


def _common(rows: DataFrame, n: int, sets: int) -> np.ndarray:
    """Sorted n-grams that one in COMMON_SHARE of a table's sets has, by the sets whose text's hash picks them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for whole in batches for batch in slices(whole, "text") for x in shingles(_bytes(batch), n)]
        gram, many = np.unique(np.concatenate([*held, np.zeros(0, "u8")]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view("i8")), pa.array(many.astype("i8"))], names=["gram", "many"])

    every = max(1, sets // COMMON_SETS)
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(0)), F.lit(every)) == 0).select("text")
    least = max(COMMON_SETS // COMMON_SHARE, 1)
    found = picked.mapInArrow(work, "gram long, many long").groupBy("gram").agg(F.sum("many").alias("many")).where(F.col("many") >= least)
    got = found.orderBy(F.desc("many"), "gram").limit(COMMON_MOST).toArrow()  # COMMON_MOST rows at most
    return np.sort(got.column("gram").to_numpy().view("u8"))


def _stars(part: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct parts in order with the least document of each, and edges (packed in rows) of the others to it."""
    order = np.lexsort((doc, part))
    part, doc = part[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, "i8")
    least = np.repeat(doc[first], np.diff(np.append(first, len(part))))
    more = least != doc
    edges = np.unique(np.column_stack([least[more], doc[more]]), axis=0) if more.any() else np.zeros((0, 2), "i8")
    return part[first], doc[first], edges


_RUN = "bucket int, n long, parts binary, docs binary"
_RUN_TYPES = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("parts", pa.binary()), ("docs", pa.binary())])


def _near(docs: DataFrame, n: int, bound: Bound, buckets: int, turn: int = 0, common: Broadcast | None = None) -> DataFrame:
    """Edges (a, b) of (node, text, block), from the least node of a block that has a key to the others.

    Tasks combine first: of a part that several of a task's sets have only the least travels on, the others become
    edges on the spot.  So no part, however common, sends more than one entry a task; entries travel in packed runs.
    """

    def edge_rows(edges: np.ndarray) -> pa.RecordBatch:
        """Edges travel as one run too."""
        a, b = (pa.array([pack(np.ascontiguousarray(edges[:, k]))], pa.binary()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([int(edges[0, 1]) % buckets], pa.int32()), pa.array([-len(edges)], pa.int64()), a, b], schema=_RUN_TYPES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("ngram_join")
        parts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part, doc, edges = _stars(np.concatenate(parts), np.concatenate(ids))
            if len(edges):
                yield edge_rows(forest(edges))
            bounds = np.searchsorted(((part >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8"), np.arange(buckets + 1))
            for k in range(buckets):
                a, z = bounds[k], bounds[k + 1]
                if a < z:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([z - a], pa.int64()), pa.array([pack_sorted(part[a:z])], pa.binary()), pa.array([pack(doc[a:z])], pa.binary())], schema=_RUN_TYPES)
            parts.clear()
            ids.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, block, grams in zip(batch.column("node").to_pylist(), batch.column("block").to_pylist(), shingles(_bytes(batch), n), strict=True):
                    if len(grams):
                        p = mix(part_hashes(grams, bound, turn, common and common.value) + mix(np.full(1, block, "i8").view("u8")))
                        parts.append(p)
                        ids.append(np.full(len(p), doc))
                        size += len(p)
                if size > RUN_PARTS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, ids = None, [], []

        def edges() -> pa.RecordBatch:
            found = forest(_stars(np.concatenate(parts), np.concatenate(ids))[2]) if parts else np.zeros((0, 2), "i8")
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            for k, m, p, d in zip(*[batch.column(c).to_pylist() for c in ("bucket", "n", "parts", "docs")], strict=True):
                if m < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(p, -m)), pa.array(unpack(d, -m))], names=["a", "b"])
                    continue
                if k != bucket:
                    yield edges()
                    bucket, parts, ids = k, [], []
                parts.append(unpack_sorted(p, m))
                ids.append(unpack(d, m))
        yield edges()

    tasks = max(workers_of(docs.sparkSession), buckets // BUCKETS_A_TASK)
    return docs.mapInArrow(spread, _RUN).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")


def _block_links(rows: DataFrame, n: int, bound: Bound) -> DataFrame:
    """Links (a, b) of rows (task, side, node, known, text) that come sorted by task.

    side 0: looked up and stored; 1: looked up; 2: stored.  known: the component it is known to be of, or null.  Hashes
    find the links, and the words themselves decide on them.
    """

    def links(group: list[tuple[int, int, int | None, bytes]]) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        ids, texts = [g[1] for g in group], [g[3] for g in group]
        true = lru_cache(4)(lambda i: true_shingles(texts[i], n))

        def exact(i: int, j: int) -> bool:
            x, y = true(j), true(i)
            common = len(x & y)
            return 100 * common >= bound.p * (len(x) + len(y) - common)

        left = [i for i, g in enumerate(group) if g[0] != 2]
        right = [i for i, g in enumerate(group) if g[0] != 1]
        return [(ids[i], ids[j]) for i, j in trie_links(shingles(texts, n), left, right, bound, known=[g[2] for g in group], exact=exact)] if left and right else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("ngram_join")
        task, group, out = None, [], []

        def made() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
            out.clear()
            return b

        for batch in batches:
            for t, side, node, known, text in zip(*[batch.column(c).to_pylist() for c in ("task", "side", "node", "known")], batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if t != task:
                    out += links(group)
                    task, group = t, []
                group.append((side, node, known, text or b""))
            if out:
                yield made()
        out += links(group)
        yield made()

    tasks = rows.select("task", "side", "node", "known", "text").repartition(workers_of(rows.sparkSession), "task").sortWithinPartitions("task")
    return tasks.mapInArrow(work, "a long, b long")


def _salted(table: DataFrame, key: str, columns: list[Column]) -> DataFrame:
    """A row of a small table SALTS times, so that the rows of a large one that have one key meet it in SALTS places."""
    return table.select(key, *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _by_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


def _links(member: DataFrame, rows: DataFrame, n: int, bound: Bound) -> DataFrame:
    """(node, root) of the components that the links within blocks make, of member (node, root, n_shingles).

    Blocks are cut into portions.  First each portion is joined with itself and with the least set of its block.  Then
    the sets that are not of the largest component of their block so far meet all portions but their own, so that any two sets of
    different components have met; sets that are of one component already need no other link.
    """
    weight = member.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("w")).where("k > 1")
    weight = stage(weight.select("root", F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_GRAMS), F.lit(1)).cast("int").alias("portions")), "join-blocks")
    dealt = _by_salt(member).join(_salted(weight, "root", [F.col("portions")]).hint("merge"), ["root", "salt"])
    dealt = stage(dealt.select("node", "root", "portions", F.pmod(F.xxhash64("node"), F.col("portions")).cast("int").alias("portion")), "join-dealt")
    own = dealt.select("node", F.xxhash64("root", "portion").alias("task"), F.lit(0).alias("side"))
    first = weight.where("portions > 1").select(F.col("root").alias("node"), "root", F.pmod(F.xxhash64("root"), F.col("portions")).cast("int").alias("home"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    own = own.unionByName(first.where("portion <> home").select("node", F.xxhash64("root", "portion").alias("task"), F.lit(2).alias("side")))
    texts = lambda asked: asked.hint("merge").join(rows.select("node", "text"), "node")
    found = connected_components(_block_links(texts(own.withColumn("known", F.lit(None).cast("long"))), n, bound))
    wide = dealt.where("portions > 1")
    if wide.isEmpty():
        return found
    named = stage(wide.join(found.select("node", F.col("root").alias("known")).hint("merge"), "node", "left").withColumn("known", F.coalesce("known", "node")), "join-named")
    sizes = named.groupBy("root", "known").count()
    # of components of one size that of the least name
    main = sizes.groupBy("root").agg(F.max_by("known", F.struct("count", -F.col("known"))).alias("main"), F.sum("count").alias("k"), F.max("count").alias("most")).where("most < k")
    main = stage(main.select("root", "main", "k", (F.col("k") - F.col("most")).alias("rest"), F.ceil((F.col("k") - F.col("most")) / BLOCK_SETS).cast("int").alias("chunks")), "join-main")
    if main.isEmpty():
        return found
    open_ = _by_salt(named).join(_salted(main, "root", [F.col(c) for c in ("main", "chunks", "k", "rest")]).hint("merge"), ["root", "salt"])
    # Where most sets are outside the largest component, each two portions meet as they are: that sends fewer texts.
    open_ = open_.withColumn("plain", F.col("k") * (F.col("portions") - 1) <= F.col("rest") * (F.col("portions") - 1) + F.col("k") * F.col("chunks"))
    each = lambda many, name: F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias(name)
    pairs = open_.where("plain").select("node", "known", "root", "portion", each("portions", "q")).where("q <> portion")
    pairs = pairs.select("node", "known", F.xxhash64("root", F.least("portion", "q"), F.greatest("portion", "q")).alias("task"), F.when(F.col("portion") < F.col("q"), 1).otherwise(2).alias("side"))
    others = open_.where("known <> main and not plain").select("node", "root", "known", "portion", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), each("portions", "q"))
    asked = others.where("q <> portion").select("node", "known", F.xxhash64("root", "q", "chunk").alias("task"), F.lit(1).alias("side"))
    stored = open_.where("not plain").select("node", "root", "known", "portion", each("chunks", "chunk")).select("node", "known", F.xxhash64("root", "portion", "chunk").alias("task"), F.lit(2).alias("side"))
    asked = pairs.unionByName(asked)
    more = _block_links(texts(asked.unionByName(stored)), n, bound)
    return connected_components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def ngram_join(docs: DataFrame, n: int = 3, per_cent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id.

    Words are runs of bytes other than 09-0D and 20, A-Z in lower case; texts of any length are whole.  Null and empty
    texts have the empty set, which links with nothing.  Ids are whole numbers below 2^62 (others are an error).  Rows
    without an id take part in all links, but never name a component: component_id is null where none of its rows has an
    id.  Repeated rows are one class; rows that share an id but not a text are one document with the links of either.
    Other columns of docs, whatever their names, play no part.  An empty table gives an empty result.
    """
    bound, spark = Bound(per_cent), docs.sparkSession
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    checked = F.when(doc_id < NAMELESS, doc_id).when(doc_id.isNotNull(), F.raise_error(F.lit("ids of 2^62 and more")).cast("long"))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(checked, F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(NAMELESS))).alias("node"))
    sets = stage(_sets(rows, n), "join-sets")
    classes = stage(sets.where("n_shingles > 0").groupBy("digest").agg(F.min("node").alias("own"), F.first("n_shingles").alias("n_shingles")), "join-classes")
    # About 8 keys for each n-gram in which sets of one size may differ, in buckets of about BUCKET_KEYS.
    total = classes.agg(F.sum("n_shingles").alias("grams"), F.count(F.lit(1)).alias("sets")).first()
    keys = 8 * (total["grams"] or 0) * (100 - per_cent) // (100 + per_cent)
    common = spark.sparkContext.broadcast(_common(rows, n, total["sets"]))
    buckets = max(LEAST_BUCKETS, workers_of(spark), keys // BUCKET_KEYS)
    blocks = stage(connected_components(_near(rows.withColumn("block", F.lit(0).cast("long")), n, bound, buckets, common=common)), "join-first")
    # Chains of chance agreements end where those of an independent second turn do: large blocks fall apart.
    large = stage(blocks.groupBy("root").count().where(F.col("count") > BLOCK_SETS).select("root"), "join-large")
    if not large.isEmpty():
        marked = stage(_by_salt(blocks).join(_salted(large, "root", [F.lit(True).alias("large")]).hint("merge"), ["root", "salt"], "left").select("node", "root", "large"), "join-marked")
        again = rows.join(marked.where("large").select("node", F.col("root").alias("block")).hint("merge"), "node")
        blocks = marked.where("large is null").select("node", "root").unionByName(connected_components(_near(again, n, bound, buckets, turn=1, common=common)))
    # Of each class one set goes to its block's tasks.
    owners = classes.groupBy(F.col("own").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
    member = stage(blocks.join(owners.hint("merge"), "node"), "join-members")
    links = _links(member, rows, n, bound)

    named = classes.join(links.select(F.col("node").alias("own"), "root").hint("merge"), "own", "left").select("digest", F.coalesce("root", "own").alias("name"))
    out = sets.select("doc_id", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.when(F.col("name") < NAMELESS, F.col("name")), F.when(F.col("name").isNull(), F.col("doc_id"))).alias("component_id"))
