"""Near-duplicate join by Jaccard similarity of five-word shingles, by chosen paths.

A *class* is a set of shingles; documents with equal sets are copies and share one class. In each run every class samples a
few of its shingles by a hash of the run, so that similar sets sample alike, and sets that share a sampled shingle meet in a
bucket. Buckets of at most ``SMALL`` members are compared by brute force. Larger ones are split by shingles sampled anew for each
path, out of the class's ``pool``, up to ``len(RATES)`` levels deep; at level k a pair at the threshold shares ``RATES[k]``
samples at least, and a pair that is much less similar shares under one, so that its paths end. What is still large
at the last level is compared whole, in tiles. Runs are repeated until a pair at the threshold meets with probability ``recall``
even on the longest path (``runs_for``). Comparison is by sizes and 64 one-byte minhashes with a margin of over four standard
deviations, which links candidates to groups; within those, every pair of classes is verified by exact set intersection, in tiles.

Representatives. Only links between groups are looked for, so a large group must not cost its square: in each large bucket of the
first ``STARS`` runs every member is compared with one leader, and what these links and the small buckets join is
one label. From then on a bucket whose members have one label is done, and only pairs of different labels are compared. Each
task hands on a spanning forest of what it has found, never all links.

Result: one row per document with its class id and number of links, so that large groups cost rows, not pairs. Links of a
document: all other documents at or over the threshold, copies included.

Scale. Nothing is broadcast or collected. Path keys met only once are dropped before anything wide moves. A pair of tiles holds at
most 2 * ``TILE`` sets and about 2 * ``TILE_SHINGLES`` shingles (or two sets). Edges grow in proportion to a group. The number of links is exact, so
a group of n different texts is verified in time of n squared, and its sets are moved n / ``TILE`` times.

Defined cases. Texts of one to four words have one shingle, the whole text. Null or empty texts, or such without words: no links, a class of their own.
Repeated rows are copies. A null doc_id is joined like any other and never a class's id unless alone. Empty input: empty result.
Other columns are kept by ``one_of_each``, whatever their names, and not read by ``jaccard_join``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm.common import as_rows, delete_table, mixed, of_rows, rolled, row_key, stored
from corvida.llm.graph import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
RATES, POOL, STARS = (2.0, 1.25, 1.25, 1.25), 64.0, 3
SMALL, TILE, TILE_SHINGLES = 8192, 1024, 1 << 20
SKETCH = 64
PAIRWISE = 64  # larger buckets are compared one by one, smaller ones many at a time

_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_A, _B = (np.random.default_rng(s).integers(1, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1) for s in (5, 6))


def meets(pool: float = 1.0) -> float:
    """The least probability that a pair at the threshold meets in a run, on the longest path, if it shares ``pool`` * ``POOL`` of its pool.

    A pair shares ``RATES[k]`` samples of level k at least, which is where one text is a part of the other. It meets
    unless none of them leads to a bucket in which it meets.
    """
    p = 1.0
    for rate in reversed(RATES[1:]):
        p = 1 - math.exp(-rate * pool * p)
    return 1 - math.exp(-RATES[0] * p)


def runs_for(recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with the given probability, whatever the pool that it happens to share."""
    shared = range(int(POOL - 6 * math.sqrt(POOL)), int(POOL + 6 * math.sqrt(POOL)))
    chance = [math.exp(m * math.log(POOL) - POOL - math.lgamma(m + 1)) for m in shared]
    for runs in range(1, len(_SEEDS)):
        if sum(c * (1 - meets(m / POOL)) ** runs for m, c in zip(shared, chance)) + 1 - sum(chance) <= 1 - recall:
            return runs
    raise ValueError("no number of runs reaches this recall")


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(mixed(rolled(h, min(n, len(h)) or 1) + np.uint64(min(n, len(h)))))


def sketch(s: np.ndarray) -> bytes:
    low = np.full(SKETCH, 2**32 - 1, np.uint32)
    for at in range(0, len(s), 4096):
        x = (s[at : at + 4096] >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, ((x[:, None] ^ _B) * _A).min(axis=0))
    return ((low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(24)).astype(np.uint8).tobytes()


def _below(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def chosen(s: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that each run samples, and how many each has."""
    run, at = np.nonzero(s * _SEEDS[:runs, None] <= _below(RATES[0] / (threshold * len(s))))
    return s[at], np.bincount(run, minlength=runs)


def _paths(threshold: float, runs: int):
    names = ["doc_id", "key", "class", "size", "sketch", "first", "pool"]
    nested = lambda counts, values: pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            cls, sizes, sketches, first, counts, pools = [], [], [], [none], [np.zeros(0, np.int64)], [none]
            for text in batch.column("text"):
                s = shingles(text.as_py())
                sizes.append(len(s))
                if not len(s):
                    cls.append(None), sketches.append(None), counts.append(np.zeros(runs, np.int64)), pools.append(none)
                    continue
                folded = np.array([s.sum(), np.bitwise_xor.reduce(mixed(s)), len(s)], np.uint64)
                cls.append(int(mixed(mixed(folded) + np.arange(3, dtype=np.uint64)).sum().view(np.int64)))
                sketches.append(sketch(s))
                tokens, n = chosen(s, runs, threshold)
                first.append(tokens), counts.append(n)
                pools.append(s[s * _SEEDS[-1] <= _below(POOL / (threshold * len(s)))])
            tokens = nested(np.concatenate(counts), np.concatenate(first).view(np.int64))
            pool = nested([len(p) for p in pools[1:]], np.concatenate(pools).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), nested(np.full(len(cls), runs), tokens), pool], names=names)

    return run


def grouped(keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], most: int = 50_000):
    """For ``mapInArrow`` over rows sorted by ``keys``: calls ``work`` with whole groups and their starts (and the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def starts(table: pa.Table) -> np.ndarray:
            fresh = np.zeros(table.num_rows, bool)
            fresh[:1] = True
            for k in keys:
                x = table[k].to_numpy()
                fresh[1:] |= x[1:] != x[:-1]
            return np.flatnonzero(fresh)

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = pa.Table.from_batches([batch.slice(at, most)])
                held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
                begin = starts(held)
                if len(begin) > 1:
                    if (out := work(held.slice(0, begin[-1]), begin)) is not None:
                        yield out
                    held = held.slice(begin[-1])
        if held is not None and held.num_rows:
            if (out := work(held, np.r_[starts(held), held.num_rows])) is not None:
                yield out

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item of its component, given edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as join what the edges (a, b) join: each node but the roots with its root."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root = roots(len(nodes), at[: len(a)], at[len(a) :])
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    a, b = forest(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None


def _marks(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _least(threshold: float) -> int:
    """Equal minhashes that two sets at the threshold have but for over four standard deviations."""
    return int(SKETCH * threshold - 4.5 * math.sqrt(SKETCH * threshold * (1 - threshold)))


def _close(threshold: float):
    """Buckets to a forest of links between members of different labels whose sizes and sketches allow the threshold.

    A bucket is a tile (i = j) or a pair of tiles, of which only pairs of members of both are compared.
    """
    least = _least(threshold)

    def whole(label: np.ndarray, size: np.ndarray, tile: np.ndarray, across: bool, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A forest of one bucket. Rows meet all later ones, some at a time, one minhash after the other; what is joined by then is left out."""
        labels, own = np.unique(label, return_inverse=True)
        root, columns, lo, step = np.arange(len(labels)), np.ascontiguousarray(marks.T), 0, 16
        while lo < len(own):
            hi = min(lo + step, len(own))
            group = root[own]
            equal = np.zeros((hi - lo, len(own) - lo), np.uint8)
            for c in columns:
                equal += c[lo:hi, None] == c[None, lo:]
            x, y = (k + lo for k in np.nonzero((equal >= least) & (group[lo:hi, None] != group[None, lo:])))
            may = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            if across:
                may &= tile[x] != tile[y]
            if may.any():
                root = roots(len(labels), group[x[may]], group[y[may]])[root]
            lo, step = hi, min(2 * step, 256)
        rest = np.flatnonzero(root != np.arange(len(labels)))
        return labels[rest], labels[root[rest]]

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        label, size, tile = (table[c].to_numpy() for c in ("label", "size", "tile"))
        across = table["i"].to_numpy() != table["j"].to_numpy()
        marks = _marks(table["sketch"])
        starts = starts[starts < len(label)]
        stops = np.r_[starts[1:], len(label)]
        left, right = [], []
        for lo, hi in ((a, b) for a, b in zip(starts, stops) if b - a > PAIRWISE):
            a, b = whole(label[lo:hi], size[lo:hi], tile[lo:hi], across[lo], marks[lo:hi])
            left.append(a), right.append(b)
        ends = np.repeat(np.where(stops - starts > PAIRWISE, starts, stops), stops - starts)
        at = np.arange(len(label))
        d = 1
        while len(at := at[at + d < ends[at]]):
            for part in np.array_split(at, max(1, len(at) // 65536)):
                x, y = part, part + d
                may = (label[x] != label[y]) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])) & ~(across[x] & (tile[x] == tile[y]))
                x, y = x[may], y[may]
                ok = (marks[x] == marks[y]).sum(axis=1) >= least
                left.append(label[x[ok]]), right.append(label[y[ok]])
            d += 1
        return _edges(np.concatenate(left), np.concatenate(right)) if left else None

    return grouped(["bucket", "i", "j"], work)


def _near_leader(threshold: float):
    """Rows of a class and a leader (class, size, sketch and the leader's l_label, l_size, l_sketch) to a forest of the links."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                size, other = t["size"].to_numpy(), t["l_size"].to_numpy()
                ok = (np.minimum(size, other) >= threshold * np.maximum(size, other)) & ((_marks(t["sketch"]) == _marks(t["l_sketch"])).sum(axis=1) >= least)
                if (out := _edges(t["class"].to_numpy()[ok], t["leader"].to_numpy()[ok])) is not None:
                    yield out

    return run


def _linked(sizes: np.ndarray, flat: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets, given by their sizes and their shingles one after the other, are at or over the threshold with which."""
    n = len(sizes)
    codes, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.full(len(codes), -1)
    shared = np.flatnonzero(seen > 1)
    order[shared] = np.arange(len(shared))
    column, row = order[inverse], np.repeat(np.arange(n), sizes)
    row, column = row[column >= 0], column[column >= 0]
    common = np.zeros((n, n), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for c in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, (c, c + 4096))
        x = np.zeros((n, min(4096, len(shared) - c)), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        common += x @ x.T  # whole numbers below 2**24
    linked = common * np.float64(1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _verified(threshold: float):
    """Tiles of groups to (class, links, root): exact links, weighted by copies, and a forest of linked classes.

    In a pair of tiles the links across count; a class there has another root only if it stands for what its own tile joins.
    """

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        out = []
        starts = starts[starts < table.num_rows]
        cls_all, copies_all, tile_all = (table[c].to_numpy() for c in ("class", "copies", "tile"))
        sets_all, across = table["shingles"].combine_chunks(), table["i"].to_numpy() != table["j"].to_numpy()
        if isinstance(sets_all, pa.ChunkedArray):
            sets_all = sets_all.chunk(0)
        for lo, hi in zip(starts, np.r_[starts[1:], table.num_rows]):
            part, cls, tile = sets_all.slice(lo, hi - lo), cls_all[lo:hi], tile_all[lo:hi]
            linked = _linked(np.diff(part.offsets.to_numpy()), part.flatten().to_numpy(), threshold)
            root = np.arange(hi - lo)
            if across[lo]:
                other = tile[:, None] != tile[None, :]
                own = roots(hi - lo, *np.nonzero(linked & ~other))
                linked &= other
                x, y = np.nonzero(np.triu(linked))
                a, b = forest(own[x], own[y])
                root[a] = b
            else:
                root = roots(hi - lo, *np.nonzero(linked))
            links = linked @ copies_all[lo:hi]
            says = np.flatnonzero((links > 0) | (root != np.arange(hi - lo)))
            out.append(np.stack([cls[says], links[says], cls[root[says]]], axis=1))
        x = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(3)], names=["class", "links", "root"])

    return grouped(["group", "i", "j"], work, 512)


def tiled(rows: DataFrame, tiles: str, member: str) -> DataFrame:
    """Rows repeated for each pair of tiles (i <= j) that their own ``tile`` is in; ``tiles``: SQL, the number of them."""
    rows = rows.withColumn("tiles", F.expr(f"cast({tiles} as int)")).withColumn("tile", F.expr(f"cast(pmod(xxhash64({member}), tiles) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return rows.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("tiles", "other")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            sets = pa.array([shingles(t.as_py()).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("copies"), b.column("group"), b.column("members"), sets], names=["class", "copies", "group", "members", "shingles"])


def _candidates(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, root) of classes that may be near duplicates, and (class, size, sketch) of all classes."""
    facts = stored(rows.where("class is not null").select("class", "size", "sketch").dropDuplicates(["class"]), "jaccard-facts")

    # paths: (bucket, run, class); those met once lead nowhere. No table here has a bound, so joins are merges at every size.
    paths = rows.where("class is not null").select("class", F.posexplode("first").alias("run", "tokens")).select("class", "run", F.explode("tokens").alias("t"))
    paths = stored(paths.select(F.xxhash64("run", "t").alias("bucket"), "run", "class").distinct(), "jaccard-paths")
    counts = stored(paths.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bucket", "class").alias("h"), "class")).alias("x")).where("n > 1").select("bucket", "n", F.col("x.class").alias("leader")), "jaccard-counts")
    met = stored(paths.join(counts.hint("merge"), "bucket"), "jaccard-met")
    small = met.where(F.col("n") <= SMALL).select("bucket", "class").join(facts.hint("merge"), "class").select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tile"), F.col("class").alias("label"), "size", "sketch")
    edges = stored(small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_close(threshold), "a long, b long"), "jaccard-small")
    large = stored(met.where(F.col("n") > SMALL).select("bucket", "run", "class", "leader"), "jaccard-large")
    for done in (paths, counts, met):
        delete_table(done)
    if large.isEmpty():
        return components(edges), facts

    led = stored(large.where((F.col("run") < STARS) & (F.col("class") != F.col("leader"))).select("class", "leader").distinct(), "jaccard-led")
    leaders = facts.select(F.col("class").alias("leader"), F.col("size").alias("l_size"), F.col("sketch").alias("l_sketch"))
    near = led.join(leaders.hint("merge"), "leader").join(facts.hint("merge"), "class").mapInArrow(_near_leader(threshold), "a long, b long")
    labels = stored(components(edges.unionByName(near)), "jaccard-labels")

    paths = large.select("bucket", "class").join(labels.select(F.col("node").alias("class"), "root").hint("merge"), "class", "left").select("bucket", "class", F.coalesce("root", "class").alias("label"))
    pools = None
    leaves = None
    for level, rate in enumerate([*RATES[1:], None], 1):
        paths = stored(paths, f"jaccard-level{level}")
        counts = paths.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket", "n")
        paths, before = stored(paths.join(stored(counts, "jaccard-counts").hint("merge"), "bucket"), f"jaccard-met{level}"), paths
        delete_table(before)
        done = paths if rate is None else paths.where(F.col("n") <= SMALL)
        leaves = done if leaves is None else leaves.unionByName(done)
        more = paths.where(F.col("n") > SMALL)
        if rate is None or more.isEmpty():
            break
        if pools is None:
            wanted = more.select("class").distinct()
            pools = stored(rows.select("class", "pool", "size").join(wanted, "class", "left_semi").dropDuplicates(["class"]), "jaccard-pools")
        # of the pool, which has a share of the set, each path takes as much as makes ``rate`` of what a pair at the threshold shares
        taken = f"least(1D, {rate / threshold!r}D / size) / least(1D, {POOL / threshold!r}D / size)"
        deeper = more.join(pools, "class").select("class", "label", "bucket", F.explode(F.expr(f"filter(pool, t -> shiftrightunsigned(xxhash64(bucket, t), 11) < {taken} * {float(1 << 53)!r}D)")).alias("t"))
        paths = deeper.select(F.xxhash64("bucket", "t").alias("bucket"), "class", "label").distinct()
    leaves = leaves.select("bucket", "class", "label", "n").join(facts.hint("merge"), "class")
    leaves = tiled(leaves, f"ceil(n / {max(SMALL, TILE)}D)", "class").select("bucket", "i", "j", "tile", "label", "size", "sketch")
    more = stored(leaves.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_close(threshold), "a long, b long"), "jaccard-edges")
    if more.isEmpty():
        return labels, facts
    return components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), facts


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, key (content key of the row), group (internal id), class_id (smallest doc_id of its group), n_links, n_copies."""
    runs = runs_for(recall)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", row_key("doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, key long, class long, size long, sketch binary, first array<array<long>>, pool array<long>"
    rows = stored(docs.select("doc_id", "key", "text").mapInArrow(_paths(threshold, runs), ddl), "jaccard-rows")
    classes = stored(rows.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min("key").alias("key")), "jaccard-classes")
    candidates, facts = _candidates(rows, threshold)

    # groups of candidates, roots among them, each class by one of its documents
    groups = candidates.select(F.col("node").alias("class"), F.col("root").alias("group")).unionByName(candidates.select(F.col("root").alias("class"), F.col("root").alias("group")).distinct())
    groups = stored(groups.join(facts.select("class", "size").hint("merge"), "class"), "jaccard-groups")
    members = stored(groups.groupBy("group").agg(F.count("*").alias("members"), F.sum("size").alias("shingles_n")), "jaccard-members")
    chosen_docs = stored(classes.join(groups.drop("size").hint("merge"), "class").join(members.hint("merge"), "group").select("key", "class", "copies", "group", F.expr(f"greatest(ceil(members / {TILE}D), ceil(shingles_n / {float(TILE_SHINGLES)}D))").alias("members")), "jaccard-chosen")
    sets = docs.select("key", "text").join(chosen_docs.hint("merge"), "key").select("class", "copies", "group", "members", "text").mapInArrow(_sets, "class long, copies long, group long, members long, shingles array<long>").dropDuplicates(["class"])
    tiles = tiled(sets, "members", "class").select("group", "i", "j", "tile", "class", "copies", "shingles").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    checked = stored(tiles.mapInArrow(_verified(threshold), "class long, links long, root long"), "jaccard-verified")
    links = checked.groupBy("class").agg(F.sum("links").alias("links"))
    linked = components(checked.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b")))
    info = classes.select("class", "copies").join(links, "class", "left").join(linked.select(F.col("node").alias("class"), "root"), "class", "left")
    info = stored(info.select("class", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("group")), "jaccard-info")
    # texts without words are groups of their own
    out = stored(rows.select("doc_id", "key", "class").join(info.hint("merge"), "class", "left").withColumn("group", F.coalesce("group", F.xxhash64("key", F.lit("alone")))), "jaccard-out")
    delete_table(rows)
    smallest = stored(out.where("class is not null").groupBy("group").agg(F.min("doc_id").alias("class_id")), "jaccard-smallest")
    return out.join(smallest.hint("merge"), "group", "left").select("doc_id", "key", "group", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest doc_id, null last, then the smallest key; one row of it."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    joined = stored(jaccard_join(docs, **options), "jaccard-result")
    first = joined.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("x"))
    stays = first.select("x.key").distinct()
    keyed = as_rows(docs).withColumn("key", row_key(F.col("row").getField(id_col), F.col("row").getField(text_col)))
    return of_rows(keyed.join(stays, "key", "left_semi").dropDuplicates(["key"]), docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, five-word shingles, similarity 0.8 or more."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key", "group")
