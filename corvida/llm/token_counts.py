"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A text is cut into pre-tokens at spaces, where no piece of the vocabulary can cross (checked when the model is loaded;
a vocabulary with such pieces makes whole texts pre-tokens). One pass emits, per block of documents, one row per distinct
pre-token with its documents and frequencies, packed. These rows meet sorted by pre-token, so that a pre-token is encoded
once where its run begins and joined to all of the run; what the products sum to is combined per block and document,
and shuffled once more to the block's ids.

Scale. One scan, two shuffles, nothing broadcast or collected. The most frequent pre-token costs one row per block, and rows of
pre-tokens in over ``HOT`` of a block's documents are dealt over ``SALTS`` runs by their block. A worker holds one block
(``BLOCK`` characters, or one longer document) or ``PAIRS`` products.

Defined cases. Null and empty texts have 0 bytes and 0 tokens. Repeated rows, null and repeated doc_ids are rows of
their own (rows are told apart by their place in the scan). Empty input gives an empty result; other columns are not
read. Special strings inside texts are plain text, as is the library's default.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

BLOCK, BLOCK_DOCS = 16 << 20, 30_000
HOT, SALTS, PAIRS = 256, 16, 2_000_000
LIMIT = 4096
MOST = 65_535


def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(model) -> bool:
    """Whether no piece has a space mark after another character, and spaces are kept as they are."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any("▁" in p.lstrip("▁") for p in pieces) and len(model.encode("a  b ")) > len(model.encode("a b"))


_UNIT = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Cut so that the counts of the parts, each encoded as a text of its own, add up to the text's.

    Encoding puts one space before a text; a part gives up the first space of its run for that one. A lone last space
    has no text of its own and is the part "", counted by difference.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    parts = [u[1:] for u in _UNIT.findall(" " + text)]
    return parts  # "" can only be the last


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose items are the values between consecutive ends."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _items(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all items of a binary column, and their ends."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, int(ends[-1]))[ends[0] :], ends - ends[0]


def _no_lists(n: int, kind: pa.ListType) -> pa.Array:
    """Empty lists; null ones would cost Spark's Arrow writer a pass over the batch each."""
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind.value_type))


def packed_frequencies(codes: np.ndarray, docs: np.ndarray, times: np.ndarray) -> pa.Array:
    """For each code (from 0, sorted, none missing) 16-bit numbers: how many documents have it more than once, those that have it once, then those others, each with its times."""
    if (times > MOST).any():  # as several entries
        parts = (times + MOST - 1) // MOST
        last = times - (parts - 1) * MOST
        codes, docs = np.repeat(codes, parts), np.repeat(docs, parts)
        times = np.full(len(codes), MOST)
        times[np.cumsum(parts) - 1] = last
    order = np.argsort(codes * 2 + (times > 1), kind="stable")
    codes, docs, times = codes[order], docs[order], times[order]
    more = times > 1
    width = 1 + more
    at = np.cumsum(width) - width + codes + 1
    ends = np.r_[0, np.cumsum(1 + np.bincount(codes, width))].astype(np.int64)
    flat = np.empty(ends[-1], "<u2")
    flat[ends[:-1]] = np.bincount(codes, more)
    flat[at] = docs
    flat[at[more] + 1] = times[more]
    return _binary(flat, ends)


def unpacked_frequencies(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and times of every entry of such a column."""
    flat, ends = _items(column, "<u2")
    length = np.diff(ends)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(flat)) - ends[:-1][row]
    once = (length - 1 - 2 * flat[ends[:-1]].astype(np.int64))[row]
    beyond = place - 1 - once
    at = np.flatnonzero((place > 0) & ((beyond < 0) | (beyond % 2 == 0)))
    more = beyond[at] >= 0
    times = np.ones(len(at), np.int64)
    times[more] = flat[at[more] + 1]
    return row[at], flat[at], times


def _blocks(cutter: Callable[[], Callable[[str], list[str]]], id_type: pa.DataType):
    """(doc_id, text) to rows (term, block, entries) for pre-tokens and (term, block, doc_ids, n_bytes), entries null, for the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, block = cutter(), TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            nonlocal block
            mine, salt = part << 24 | block, (part + block) % SALTS
            block += 1
            keys = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            codes, n = keys[first] >> 16, len(number)
            held = np.bincount(codes, minlength=n).tolist()
            terms = [("t" if k <= HOT else f"h{salt:x}") + t for t, k in zip(number, held)]
            entries = packed_frequencies(codes, keys[first] & MOST, np.diff(np.r_[first, len(keys)])) if n else pa.array([], pa.binary())
            both = lambda a, x: pa.concat_arrays([a, x])
            ids, sizes = pa.list_(id_type), pa.list_(pa.int64())
            columns = [pa.array([*terms, f"m{mine}"], pa.string()), pa.array(np.full(n + 1, mine)), both(entries, pa.nulls(1, pa.binary())), both(_no_lists(n, ids), pa.array([doc_ids], ids)), both(_no_lists(n, sizes), pa.array([n_bytes], sizes))]
            return pa.RecordBatch.from_arrays(columns, names=["term", "block", "entries", "doc_ids", "n_bytes"])

        def fresh():
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            return number, [np.zeros(0, np.int64)], [], [], 0

        number, found, doc_ids, n_bytes, held = fresh()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for doc_id, text, size in zip(batch.column(0).to_pylist(), batch.column(1), sizes):
                parts = cut(text.as_py() or "")
                found.append(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)) << 16 | len(doc_ids))
                doc_ids.append(doc_id), n_bytes.append(size)
                held += size
                if held >= BLOCK or len(doc_ids) >= BLOCK_DOCS:
                    yield out()
                    number, found, doc_ids, n_bytes, held = fresh()
        if doc_ids:
            yield out()

    return run


def _joined(counter: Callable[[], Callable[[list[str]], list[int]]], id_type: pa.DataType):
    """Rows sorted by term to (block, docs, sums): the pieces of the terms, summed per document of a block; blocks' own rows pass."""
    names = ["block", "docs", "sums", "doc_ids", "n_bytes"]
    ids, sizes = pa.list_(id_type), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(), (None, 0)
        keys, values, held = [], [], 0

        def out() -> pa.RecordBatch:
            key, value = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums, key = np.add.reduceat(value, first), key[first]
            block = key >> 16
            begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends, n = np.r_[begin, len(key)], len(begin)
            return pa.RecordBatch.from_arrays([pa.array(block[begin]), _binary((key & MOST).astype("<u2"), ends), _binary(sums.astype("<u4"), ends), _no_lists(n, ids), _no_lists(n, sizes)], names=names)

        for batch in batches:
            own = batch.column("entries").is_null()
            if (facts := batch.filter(own)).num_rows:
                n = facts.num_rows
                yield pa.RecordBatch.from_arrays([facts.column("block"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), facts.column("doc_ids").cast(ids), facts.column("n_bytes").cast(sizes)], names=names)
            rows = batch.filter(pc.invert(own))
            for at in range(0, rows.num_rows, 20_000):
                some = rows.slice(at, 20_000)
                terms = some.column("term").dictionary_encode()
                texts = [t[1:] if t[0] == "t" else t[2:] for t in terms.dictionary.to_pylist()]
                known = texts[0] == last[0]
                n = [last[1]] * known + count(texts[known:])
                last = texts[-1], n[-1]
                row, doc, times = unpacked_frequencies(some.column("entries"))
                keys.append(some.column("block").to_numpy()[row] << 16 | doc)
                values.append(np.array(n, np.int64)[terms.indices.to_numpy()][row] * times)
                held += len(row)
                if held >= PAIRS:
                    yield out()
                    keys, values, held = [], [], 0
        if held:
            yield out()

    return run


def _totals(id_type: pa.DataType):
    """Rows sorted by block to doc_id, n_bytes, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, facts, total = None, None, np.zeros(BLOCK_DOCS, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(facts[0], id_type), pa.array(facts[1], pa.int64()), pa.array(total[: len(facts[0])])], names=["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            for block, docs, sums, doc_ids, n_bytes in zip(*batch.columns):
                if block.as_py() != current:
                    if current is not None:
                        yield out()
                        total[:] = 0
                    current = block.as_py()
                if not docs.is_valid:
                    facts = doc_ids.as_py(), n_bytes.as_py()
                else:
                    total[np.frombuffer(docs.as_py(), "<u2")] += np.frombuffer(sums.as_py(), "<u4")
        if current is not None:
            yield out()

    return run


def _arrow_type(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""

    def cutter() -> Callable[[str], list[str]]:
        return pre_tokens if splits_at_spaces(piece_model(model_path)) else lambda t: [t] if t else []

    def counter() -> Callable[[list[str]], list[int]]:
        model = piece_model(model_path)
        lone = len(model.encode("a ")) - len(model.encode("a"))
        whole = not splits_at_spaces(model)
        return lambda texts: [len(ids) if t or whole else lone for t, ids in zip(texts, model.encode(texts, num_threads=1))]

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    name, kind = docs.schema["doc_id"].dataType.simpleString(), _arrow_type(docs.schema["doc_id"].dataType)
    blocks = docs.mapInArrow(_blocks(cutter, kind), f"term string, block long, entries binary, doc_ids array<{name}>, n_bytes array<long>")
    sums = blocks.repartition("term").sortWithinPartitions("term").mapInArrow(_joined(counter, kind), f"block long, docs binary, sums binary, doc_ids array<{name}>, n_bytes array<long>")
    counted = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_totals(kind), f"doc_id {name}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the 32k piece vocabulary."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
