"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the training words (A-Z in lower case), one end symbol per document, and one symbol for all unknown words.
A context of one to ``DEPTH`` symbols is a state of the tree if it has entries (next symbols that follow it ``LEAST`` times or more)
and its next-symbol distribution differs from that of its longest proper suffix (a G test and a least divergence in nats); suffixes
of states are states. A state's distribution is smoothed towards its suffix state's with weight ``PRIOR``; the root discounts
every word's count and gives what that frees to the unknown symbol. All distributions sum to one over the symbols. Each symbol
is scored in the longest suffix of its history that is a state; a document's history begins with an end symbol.

Scale. Counts cover all training documents, and ``LEAST`` is the same number for any corpus, so the tree grows with it. It is a
table, never collected: n-grams are counted in sorted packed runs (``_counted``), tested and valued by joins. What a state or an entry adds
to what its suffix says is one number per n-gram, so that a document's score is a sum over its words and n-grams. The
``HOT`` most frequent of these are broadcast, a fixed number, and summed where the text is read, so that no hot key is
ever shuffled; the others meet the blocks of documents part by part, both packed (``_met``). Bit filters of fixed size (``FILTER_BITS``)
keep n-grams that cannot be in the table out of a shuffle; they never drop one that is, and only save less as they fill up.
Words and n-grams are known by 64-bit hashes: of ten thousand million distinct ones some two or three pairs are taken for one.

Defined cases. Null or empty text: the end symbol only. A null doc_id counts as the empty text for the split, so it
trains. Repeated rows are scored and counted each. With nothing to train on every count is 0. Other columns are not read.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm.common import delete_table, mixed, rolled, stored

DEPTH, LEAST = 4, 16
MIN_DIVERGENCE, PRIOR = 0.005, 8.0
#: Symbols that a worker works on at once; n-grams that are counted in one group; values that are broadcast.
CHUNK, PART, HOT = 1 << 20, 1 << 21, 1 << 19
TOGETHER = 4  # groups that one task counts, one after the other, and writes to one file
FILTER_BITS = 27
FILTER_SHIFTS = 64 - FILTER_BITS, 64 - 2 * FILTER_BITS  # where a key's two places in a filter are read
HELD = 4  # chunks whose words and n-grams are counted together before they are sent; half as many make a block of documents
TEXTS = 1 << 22  # bytes of texts whose words are cut and hashed at once
SLICE, RANGES = 1 << 16, 3  # keys that are computed at once; top bits by which a worker's keys are worked on apart
#: Top bits at least by which values meet the documents; symbols and values of one such part.
VALUE_BITS, SYMBOLS_MET, VALUES_MET = 4, 1 << 23, 1 << 18
END = np.uint64(0x5851F42D4C957F2D)  # the end symbol among the words' hashes


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _give_back() -> None:
    """What is freed goes back to the system: a worker lives on, beside the other steps' memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, text), some ``TEXTS`` bytes of texts at a time; a longer text is a part of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, TEXTS + (sizes[at - 1] if at else 0), "right")))
            yield batch.slice(at, to - at)
            at = to


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' numbers of words, and the hashes of these (as ``words_of`` gives them), each distinct word's computed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary())
    # no word has a space: they are joined and cut again, which is quicker than to make Python objects of them one by one
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(b" ", pa.large_binary()))[0].as_py()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined.split(b" ")), np.uint64, len(distinct))
    place = coded.indices.to_numpy()
    real = (pc.binary_length(distinct).to_numpy() > 0)[place]  # white space at a text's ends leaves an empty piece
    edge = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    before = np.r_[0, np.cumsum(real)]
    return before[edge[1:]] - before[edge[:-1]], hashes[place[real]]


def _chunks(batches: Iterator[pa.RecordBatch], size: int, train: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents (doc_id, text), at least ``size`` symbols at a time: ids, numbers of words, and symbols, an end before and after each text's."""
    ids, lengths = [], []
    symbols, used = np.empty(size + (size >> 3), np.uint64), 0  # filled anew for each chunk
    for part in _parts(batches):
        if train:
            part = part.filter(pa.array([not held_out(x) for x in part.column(0).to_pylist()], pa.bool_()))
        part_ids = part.column(0).to_pylist()
        n_words, words = _hashed(part.column(1))
        ends, word_ends = np.cumsum(n_words + 2), np.cumsum(n_words)
        at = 0
        while at < len(part_ids):
            begin, word = (ends[at - 1], word_ends[at - 1]) if at else (0, 0)
            to = min(int(np.searchsorted(ends, size - used + begin)) + 1, len(part_ids))
            if (after := used + int(ends[to - 1] - begin)) > len(symbols):
                symbols = np.concatenate([symbols[:used], np.empty(after - used + (size >> 3), np.uint64)])
            inner = np.ones(after - used, bool)
            inner[ends[at:to] - begin - 1] = inner[ends[at:to] - begin - n_words[at:to] - 2] = False
            mine = symbols[used:after]
            mine[:] = END
            mine[inner] = words[word : word_ends[to - 1]]
            ids += part_ids[at:to]
            lengths.append(n_words[at:to])
            at, used = to, after
            if used >= size:
                yield ids, np.concatenate(lengths), symbols[:used]
                ids, lengths, used = [], [], 0
                _give_back()
    if ids:
        yield ids, np.concatenate(lengths), symbols[:used]
    _give_back()


def _word_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, symbols in _chunks(batches, size, True):
            ends = np.cumsum(n + 2)
            inner = np.ones(len(symbols), bool)
            inner[ends - 1] = inner[ends - n - 2] = False
            for of_range in _ranges(RANGES):
                w, c = np.unique(symbols[inner & of_range(symbols)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["k", "c"])

    return run


def _filter(keys: DataFrame):
    """A broadcast bit filter of the column ``k``, two bits a key: at most 2**FILTER_BITS / 64 rows reach the driver."""
    slots = keys.select(F.explode(F.array(*[F.shiftrightunsigned("k", shift).bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long")) for shift in FILTER_SHIFTS])).alias("slot"))
    rows = slots.select(F.shiftrightunsigned("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def gram_keys(symbols: np.ndarray, n: int) -> np.ndarray:
    """Keys of all n-grams along a text, apart by n; those of single symbols are their hashes."""
    keys = np.empty((max(0, len(symbols) - n + 1), *symbols.shape[1:]), np.uint64)
    for at in range(0, len(keys), SLICE):
        keys[at : at + SLICE] = rolled(symbols[at : at + SLICE + n - 1], n)
    keys += np.uint64((n - 1) * 0x9E3779B97F4A7C15 % 2**64)
    return keys


def _maybe(bits: np.ndarray, symbols: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams along a text may be in a filter."""
    may = np.empty(max(0, len(symbols) - n + 1), bool)
    for at in range(0, len(may), SLICE):
        keys, both = gram_keys(symbols[at : at + SLICE + n - 1], n), np.uint64(1)
        for shift in FILTER_SHIFTS:
            slot = (keys >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
            both = both & (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)))
        may[at : at + SLICE] = both > 0
    return may


def _within(n_words: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams along a chunk's texts lie in one text."""
    ends = np.cumsum(n_words + 2)
    within = np.ones(max(0, int(ends[-1]) - n + 1), bool)
    for k in range(1, n):
        at = ends - k
        within[at[(at >= 0) & (at < len(within))]] = False
    return within


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams from the columns of their symbols."""
    keys = np.empty(len(columns[0]), np.uint64)
    for at in range(0, len(keys), SLICE):
        keys[at : at + SLICE] = gram_keys(np.stack([c[at : at + SLICE] for c in columns]), len(columns))[0]
    return keys


def _runs(order: np.ndarray) -> np.ndarray:
    """Where equal values begin among sorted ones."""
    return np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, np.int64)


def _ranges(bits: int):
    """Tests for keys by their top ``bits``, so that not all of a worker's keys are sorted at once."""
    for r in range(1 << bits):
        low, high = (np.uint64(x) for x in (r << (64 - bits), ((r + 1) << (64 - bits)) - 1))
        yield lambda keys, low=low, high=high: (keys >= low) & (keys <= high)


_PACKED = "part int, n int, rows int, blob binary"


def _distinct(key: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one of each, and how often each stands there, or the sums of its counts."""
    order = np.argsort(key)
    key = key[order]
    first = _runs(key)
    if counts is None:
        sums = np.diff(np.r_[first, len(key)])
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else counts
    return key[first], order[first], sums


def _zipped(*raw: bytes) -> bytes:
    raw = b"".join(raw)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzipped(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: equal high bytes compress away."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _of_planes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences; ``np.cumsum`` gives them back."""
    return np.diff(x, prepend=x.dtype.type(0))


class _Codes:
    """Symbols as small numbers: ranks of the most frequent ones, then places among the others that a blob has."""

    def __init__(self, by_rank: np.ndarray):
        self.by_rank = by_rank
        self.rank = np.argsort(by_rank)
        self.known = by_rank[self.rank]

    def of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of distinct sorted symbols, and those that have no rank."""
        at = np.minimum(np.searchsorted(self.known, symbols), max(len(self.known) - 1, 0))
        other = self.known[at] != symbols if len(self.known) else np.ones(len(symbols), bool)
        codes = np.empty(len(symbols), np.int64)
        codes[~other] = self.rank[at[~other]]
        codes[other] = len(self.by_rank) + np.arange(np.count_nonzero(other))
        return codes, symbols[other]


def _to_blob(columns: list[np.ndarray], codes: _Codes) -> bytes:
    """The distinct symbols without a rank, then each row's symbols as codes, by the first two, then the counts."""
    words, place = np.unique(np.concatenate(columns[:-1]), return_inverse=True)
    code, others = codes.of(words)
    place = code[place].reshape(len(columns) - 1, -1)
    order = np.argsort(place[0] << 32 | place[1])
    place = place[:, order].astype(np.uint32)
    place[0] = _steps(place[0])
    return _zipped(len(others).to_bytes(8, "little"), _planes(_steps(others)), *map(_planes, place), _planes(columns[-1][order].astype(np.uint32)))


def _of_blob(blob: bytes, n: int, rows: int, codes: _Codes) -> list[np.ndarray]:
    raw = _unzipped(blob)
    n_others = int.from_bytes(raw[:8], "little")
    words = np.concatenate([codes.by_rank, np.cumsum(_of_planes(raw, "u8", n_others, 8), dtype=np.uint64)])
    first, *rest, counts = (_of_planes(raw, "u4", rows, 8 + 8 * n_others + 4 * rows * k) for k in range(n + 1))
    return [words[np.cumsum(first)], *(words[x] for x in rest), counts.astype(np.int64)]


def _packed(sizes: tuple[int, ...], inner: int, parts, bits: int, chunk: int, frequent=None):
    """N-grams of the training texts, counted by ``HELD`` chunks at a time, sorted by key and cut by its top ``bits``.

    Taken are those whose ``inner``-grams may all be among ``parts``. An n-gram is held by its key and a place where it stands,
    whatever n; its symbols are looked up for one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(n: int, symbols: np.ndarray, ok: np.ndarray, good: np.ndarray, codes: _Codes) -> Iterator[pa.RecordBatch]:
            for k in range(n - inner + 1):
                ok &= good[k : k + len(ok)]
            keys = gram_keys(symbols, n)
            for of_range in _ranges(min(bits, RANGES)):
                at = np.flatnonzero(ok & of_range(keys))
                key, first, counts = _distinct(keys[at])
                at = at[first]
                part = (key >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
                edge = [*_runs(part).tolist(), len(part)]
                rows = [(part[a], n, b - a, _to_blob([*(symbols[at[a:b] + k] for k in range(n)), counts[a:b]], codes)) for a, b in zip(edge, edge[1:])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "n", "rows", "blob"])

        codes = _Codes(frequent.value if frequent else np.zeros(0, np.uint64))
        for _, n_words, symbols in _chunks(batches, HELD * chunk, True):
            good = _maybe(parts.value, symbols, inner)
            for n in sizes:
                yield from counted(n, symbols, _within(n_words, n), good, codes)

    return run


def _merged(least: int, frequent=None):
    """Packed parts, sorted by (part, n), to the n-grams that occur ``least`` times: n, k, pre, suf (keys of all but the last and all but the first symbol), last, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, codes = [], None, _Codes(frequent.value if frequent else np.zeros(0, np.uint64))

        def out() -> pa.RecordBatch:
            *columns, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            key, row, counts = _distinct(gram_key(columns), counts)
            keep = counts >= least
            counts, symbols = counts[keep], [c[row[keep]] for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), at[1], np.int32)), *(pa.array(x.view(np.int64)) for x in (key[keep], gram_key(symbols[:-1]), gram_key(symbols[1:]), symbols[-1])), pa.array(counts)], names=["n", "k", "pre", "suf", "last", "c"])

        for batch in batches:
            for part, n, rows, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if at not in (None, (part, n)):
                    yield out()
                at = part, n
                held.append(_of_blob(blob, n, rows, codes))
        if held:
            yield out()
        _give_back()

    return run


def _counted(docs: DataFrame, sizes: tuple[int, ...], inner: int, parts, symbols: int, least: int, frequent=None) -> DataFrame:
    """All n-grams of the given sizes that occur ``least`` times or more in training, stored. ``frequent``: words by rank, for shorter rows only."""
    bits = max(0, math.ceil(math.log2(max(1, symbols / PART))))
    packed = docs.mapInArrow(_packed(sizes, inner, parts, bits, CHUNK, frequent), _PACKED)
    rows = packed.repartition(max(1, (1 << bits) // TOGETHER), "part", "n").sortWithinPartitions("part", "n").mapInArrow(_merged(least, frequent), "n int, k long, pre long, suf long, last long, c long")
    return stored(rows, f"lm-grams-{sizes[0]}")


def _is_state(cc: Column) -> Column:
    free = F.greatest(F.col("entries") - 1, F.lit(1))
    return (F.col("gain") >= MIN_DIVERGENCE) & (2 * cc * F.col("gain") > free + 3 * F.sqrt(2.0 * free))


def _named(df: DataFrame, **names: str) -> DataFrame:
    """Renamed columns of a table that has no bound: whatever is joined with it, is merged with it at every size."""
    return df.select(*[F.col(old).alias(new) for new, old in names.items()]).hint("merge")


def _tree(grams: dict[int, DataFrame], words: DataFrame, total: int, discount: float, depth: int) -> tuple[DataFrame, DataFrame]:
    """What each n-gram adds to a score, (k, adds, c), and the states of one symbol, (k, back). ``words``: (k, c), the end included."""
    back = (F.col("cc") - F.col("kept") + PRIOR) / (F.col("cc") + PRIOR)
    # nodes of d symbols: key, key of the suffix, count, count of the suffix
    nodes = words.select("k", F.lit(0).cast("long").alias("suf"), "c", F.lit(total).cast("long").alias("sc"))
    entries, tests = {}, {}
    for d in range(1, depth + 1):
        found = grams[d + 1].join(_named(nodes, pre="k", below="suf", cc="c", csc="sc"), "pre").join(_named(nodes, suf="k", down="c"), "suf")
        entries[d] = stored(found.join(_named(words, last="k", lc="c"), "last").select("k", "pre", "suf", "below", "c", "cc", "csc", "down", "lc"), f"lm-entries-{d}")
        p = F.col("c") / F.col("cc")
        gain = F.sum(p * F.log(F.greatest(p * F.col("csc") / F.col("down"), F.lit(1e-12))))
        tests[d] = entries[d].groupBy("pre").agg(F.first("below").alias("below"), F.first("cc").alias("cc"), gain.alias("gain"), F.count("*").alias("entries"), F.sum("c").alias("kept"))
        nodes = _named(entries[d], k="k", suf="suf", c="c", sc="down")
    states: dict[int, DataFrame] = {}
    for d in range(depth, 0, -1):  # suffixes of states are states
        if d == depth:
            mine = tests[d].where(_is_state(F.col("cc")))
        else:
            mine = tests[d].join(states[d + 1].select(F.col("below").alias("pre"), F.lit(True).alias("held")).distinct(), "pre", "left").where(_is_state(F.col("cc")) | F.col("held"))
        states[d] = stored(mine.select("pre", "below", "cc", back.alias("back")), f"lm-states-{d}")
    root = F.greatest(F.col("lc") - discount, F.lit(1e-9)) / total
    adds, lower = None, None
    for d in range(1, depth + 1):
        mine = entries[d].join(states[d].select("pre", "back"), "pre")
        mine = mine.withColumn("low", root) if lower is None else mine.join(_named(lower, suf="k", low="p"), "suf")
        mine = mine.select("k", "c", "low", "back", (F.col("c") / (F.col("cc") + PRIOR) + F.col("back") * F.col("low")).alias("p"))
        lower = stored(mine.select("k", "c", "p", (F.log10("p") - F.log10("low") - F.log10("back")).alias("adds")), f"lm-adds-{d}")
        part = lower.select("k", "c", "adds")
        adds = part if adds is None else adds.unionByName(part)
        if d > 1:
            adds = adds.unionByName(states[d].select(F.col("pre").alias("k"), F.col("cc").alias("c"), F.log10("back").alias("adds")))
    tree = stored(adds.groupBy("k").agg(F.sum("adds").alias("adds"), F.max("c").alias("c")), "lm-tree")
    for table in entries.values():
        delete_table(table)
    return tree, _named(states[1], k="pre", back="back")


def _hottest(values: DataFrame, most: int) -> int:
    """The least count from which on at most ``most`` values are counted: an eighth of an octave is taken whole or not at all."""
    octave = F.floor(8 * F.log2("c")).cast("int")
    left, least = most, 2**62
    for r in sorted(values.groupBy(octave.alias("o")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True):
        if r["n"] > left:
            break
        left, least = left - r["n"], r["c"]
    return least


_FACTS = "rows array<int>, doc_ids array<{id}>, a array<long>, lg array<double>, over array<double>, known array<long>"


def _facts_schema(*first: tuple[str, pa.DataType], id_type: pa.DataType) -> pa.Schema:
    return pa.schema([*first, ("rows", pa.list_(pa.int32())), ("doc_ids", pa.list_(id_type)), ("a", pa.list_(pa.int64())), ("lg", pa.list_(pa.float64())), ("over", pa.list_(pa.float64())), ("known", pa.list_(pa.int64()))])


def _by_part(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Sorted keys cut by their top ``bits``: part, from, to."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = _runs(part)
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))


def _packed_values(bits: int, size: int = 1 << 20):
    """Values (k, lg, over, known) to packed parts: they stand before all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out() -> Iterator[pa.RecordBatch]:
            k, *values = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(4))
            held.clear()
            order = np.argsort(k.view(np.uint64))
            k, values = k.view(np.uint64)[order], [v[order] for v in values]
            rows = [(part, -1, _zipped((b - a).to_bytes(8, "little"), _planes(_steps(k[a:b])), *(v[a:b].tobytes() for v in values))) for part, a, b in _by_part(k, bits)]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.int64(), pa.binary()))], names=["part", "block", "blob"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from out()
        if held:
            yield from out()

    return run


def _blocks(depth: int, tree, hot, chunk: int, id_type: pa.DataType, bits: int = RANGES):
    """Per block of documents its distinct words and n-grams that may have a value, hot ones aside, with where they stand, packed in parts.

    One more row has the block's documents: ids, tokens, and what their hot words and n-grams sum to.
    """
    schema = _facts_schema(("part", pa.int32()), ("block", pa.int64()), ("blob", pa.binary()), id_type=id_type)

    def grams(n_words: np.ndarray, symbols: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
        """Words, then n-grams of each size, a range of keys at a time: keys by place, the places to be taken, the range."""
        for n in range(1, depth + 2):
            ok = _within(n_words, n)
            if n == 1:
                ends = np.cumsum(n_words + 2)
                ok[ends - 1] = ok[ends - n_words - 2] = False
            else:
                ok &= _maybe(known, symbols, n)
            keys = gram_keys(symbols, n)
            for of_range in _ranges(RANGES):
                yield keys, ok, of_range

    def of_block(block: int, ids: list, n_words: np.ndarray, symbols: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, (hot_k, *hot_v) = tree.value, hot.value
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), n_words + 2)
        sums = [np.zeros(len(ids)) for _ in hot_v]
        for keys, ok, of_range in grams(n_words, symbols, known):
            at = np.flatnonzero(ok & of_range(keys))
            key = keys[at]
            order = np.argsort(key, kind="stable")
            key, row = key[order], doc[at[order]]
            first = _runs(key)
            times = np.diff(np.r_[first, len(key)])
            own = key[first]
            at = np.minimum(np.searchsorted(hot_k, own), max(len(hot_k) - 1, 0))
            is_hot = hot_k[at] == own if len(hot_k) else np.zeros(len(own), bool)
            every, of = np.repeat(is_hot, times), np.repeat(at, times)
            for s, v in zip(sums, hot_v):
                s += np.bincount(row[every], v[of[every]], len(ids))
            rare, times, row = own[~is_hot], times[~is_hot], row[~every]
            edge = np.r_[0, np.cumsum(times)]
            rows = [(part, block, _zipped((b - a).to_bytes(8, "little"), _planes(_steps(rare[a:b])), _planes(times[a:b].astype(np.uint32)), _planes(row[edge[a] : edge[b]]))) for part, a, b in _by_part(rare, bits)]
            for a in range(0, len(rows), 64):
                mine = [pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 64]), schema)]
                yield pa.RecordBatch.from_arrays([*mine, *(pa.nulls(len(mine[0]), f.type) for f in list(schema)[3:])], schema=schema)
        part = int(mixed(np.array([block], np.uint64))[0] >> np.uint64(64 - bits))
        facts = [pa.array([part], pa.int32()), pa.array([block]), pa.nulls(1, pa.binary()), pa.array([list(range(len(ids)))], schema.field("rows").type)]
        facts += [pa.array([ids], schema.field("doc_ids").type), pa.array([n_words + 1], schema.field("a").type), *(pa.array([s], pa.list_(pa.float64())) for s in sums[:2]), pa.array([sums[2].astype(np.int64)], schema.field("known").type)]
        yield pa.RecordBatch.from_arrays(facts, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in enumerate(_chunks(batches, chunk, False), TaskContext.get().partitionId() << 24):
            yield from of_block(block, *found)

    return run


def _met(id_type: pa.DataType):
    """Packed parts, sorted by (part, block): what each block's documents get from a part's values, and the blocks' own rows as they are."""
    schema = _facts_schema(("block", pa.int64()), id_type=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packed, values, docs, of = None, [], None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if not docs:
                return
            doc, place = np.unique(np.concatenate(docs), return_inverse=True)
            which = np.concatenate(of)
            docs.clear(), of.clear()
            lg, over, known = (np.bincount(place, v[which], len(doc)) for v in values[1:])
            columns = [pa.array([at[1]]), pa.array([doc], schema.field("rows").type), pa.nulls(1, schema.field("doc_ids").type), pa.nulls(1, schema.field("a").type)]
            columns += [pa.array([lg]), pa.array([over]), pa.array([known.astype(np.int64)])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            facts = batch.filter(pc.is_null(batch.column(2)))
            if facts.num_rows:
                yield pa.RecordBatch.from_arrays([facts.column(1), *facts.columns[3:]], schema=schema)
            for part, block, blob in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if blob is None:
                    continue
                if at != (part, block):
                    yield from out()
                if at is None or at[0] != part:
                    packed, values = [], None
                at = part, block
                raw = _unzipped(blob)
                n = int.from_bytes(raw[:8], "little")
                keys = np.cumsum(_of_planes(raw, "u8", n, 8), dtype=np.uint64)
                if block < 0:
                    packed.append([keys, *np.frombuffer(raw, np.float64, 3 * n, 8 + 8 * n).reshape(3, n)])
                    continue
                if values is None and packed:  # once for a part; equal keys are summed
                    key, *columns = (np.concatenate(x) for x in zip(*packed))
                    order = np.argsort(key)
                    key, first = key[order], _runs(key[order])
                    values, packed = [key[first], *(np.add.reduceat(c[order], first) for c in columns)], []
                if values is None:
                    continue
                place = np.minimum(np.searchsorted(values[0], keys), len(values[0]) - 1)
                hit = values[0][place] == keys
                times = _of_planes(raw, "u4", n, 8 + 8 * n).astype(np.int64)
                rows = _of_planes(raw, "i4", int(times.sum()), 8 + 12 * n)
                docs.append(rows[np.repeat(hit, times)]), of.append(np.repeat(place[hit], times[hit]))
        yield from out()
        _give_back()

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    remainder = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7")
    words = stored(docs.mapInArrow(_word_counts(HELD * CHUNK), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")), "lm-words")
    n_words, distinct, once, twice = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = docs.where(remainder != 2).count()
    n, v = n_words + ends, distinct + (ends > 0)
    discount = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.1))

    frequent = words.where(F.col("c") >= least).unionByName(spark.range(1 if ends else 0).select(F.lit(int(END.view(np.int64))).alias("k"), F.lit(ends).cast("long").alias("c")))
    ranked = frequent.where(F.col("c") >= _hottest(frequent, HOT)).toArrow()  # at most ``HOT`` rows
    ranked = spark.sparkContext.broadcast(ranked.column("k").to_numpy().view(np.uint64)[np.argsort(-ranked.column("c").to_numpy(), kind="stable")])
    grams = {2: _counted(docs, (2,), 1, _filter(frequent), n, least, ranked)}
    for sizes in ((3,), tuple(range(4, depth + 2))):  # what is longer than three is looked for among frequent n-grams of three
        if sizes and sizes[0] <= depth + 1:
            found = _counted(docs, sizes, sizes[0] - 1, _filter(grams[sizes[0] - 1]), n, least, ranked)
            grams |= {k: found.where(F.col("n") == k) for k in sizes}
    tree, states = _tree(grams, frequent, max(n, 1), discount, depth)

    # the root: discounted counts; what the discounts free is the unknown symbol's; each word is a context once
    unknown = math.log10(discount * v / n) if n else 0.0
    over = F.log10((F.col("c") - discount) / max(n, 1)) - unknown + F.coalesce(F.log10("back"), F.lit(0.0))
    values = words.join(states, "k", "left").select("k", "c", F.log10(F.col("c") + 1).alias("lg"), over.alias("over"), F.lit(1.0).alias("known"))
    values = stored(values.unionByName(tree.select("k", "c", F.lit(0.0).alias("lg"), F.col("adds").alias("over"), F.lit(0.0).alias("known"))), "lm-values")
    from_count = _hottest(values, hot)
    top = values.where(F.col("c") >= from_count).select("k", "lg", "over", "known").toArrow()  # at most ``hot`` rows
    top_k = top.column("k").to_numpy().view(np.uint64)
    order = np.argsort(top_k)
    inline = spark.sparkContext.broadcast([top_k[order], *(top.column(c).to_numpy()[order] for c in ("lg", "over", "known"))])

    id_type = docs.schema["doc_id"].dataType
    arrow_id, facts = to_arrow_type(id_type), _FACTS.format(id=id_type.simpleString())
    rest = values.where(F.col("c") < from_count)
    bits = max(VALUE_BITS, math.ceil(math.log2(max(1, n / SYMBOLS_MET, rest.count() / VALUES_MET))))
    packed = rest.select("k", "lg", "over", "known").mapInArrow(_packed_values(bits), "part int, block long, blob binary")
    blocks = docs.mapInArrow(_blocks(depth, _filter(tree), inline, HELD // 2 * CHUNK, arrow_id, bits), f"part int, block long, blob binary, {facts}")
    met = blocks.unionByName(packed, allowMissingColumns=True).repartition(1 << bits, "part").sortWithinPartitions("part", "block").mapInArrow(_met(arrow_id), f"block long, {facts}")
    at = lambda c: F.expr(f"get({c}, i)").alias(c)
    flat = met.select("*", F.posexplode("rows").alias("i", "doc")).select("block", "doc", F.expr("get(doc_ids, i)").alias("doc_id"), *map(at, ("a", "lg", "over", "known")))
    sums = flat.groupBy("block", "doc").agg(F.max("doc_id").alias("doc_id"), F.max("a").alias("a"), *[F.sum(c).alias(c) for c in ("lg", "over", "known")])
    start = states.where(F.col("k") == int(END.view(np.int64))).first()
    end = (math.log10((ends - discount) / n) if ends else 0.0) + (math.log10(start["back"]) if start else 0.0)
    base = F.col("lg") + math.log10(ends + 1) - F.col("a") * math.log10(n + v + 1)
    score = F.col("over") + (F.col("a") - 1) * unknown + end
    return sums.select("doc_id", (remainder == 2).alias("held_out"), F.col("a").alias("n_tokens"), (F.col("known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, learning from those whose crc32 remainder is not 2."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
