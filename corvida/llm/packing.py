"""Order-preserving packing into fixed windows by dynamic programming.

Documents are encoded and laid end to end in their order. Allowed cuts are document ends and sentence ends; only a
sentence longer than a window may be cut within, every ``GRID`` tokens. Among all ways to cut the stream into windows of at most
``window`` tokens, dynamic programming finds the cheapest: what is left empty, plus ``CUT_SENTENCE`` for a cut within a
document and ``CUT_WORD`` for one within a sentence. A window that starts at i and ends at j leaves window - (j - i) empty,
so the best i for j minimises cost(i) + i over a sliding range, which a monotone queue gives in amortised constant time.
A sentence ends with the token of ``.``, ``!`` or ``?``, but not within a number.

Scale. No shuffle, broadcast or collect: each scan partition packs its own documents, ``BLOCK`` tokens at a time, so a worker
holds one block (or one longer document). What is left at a block's end goes on with the next one, so that only a partition's
end is forced: its last window may be dealt out as powers of two, which need no padding. A window never spans partitions.

Defined cases. Null and empty texts are one token, the end id. Repeated rows and null ids are packed each. An empty table gives an
empty result. Other columns are not read. Ids are the library's for whole texts: its splitting drops white space, so words and their
pre-tokens are encoded once each (the tests hold this against whole texts); special strings in texts are what the library makes of them.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW, END_ID, GRID, BLOCK = 4096, 2, 64, 1 << 20
CUT_SENTENCE, CUT_WORD = 2.0, 8.0
MEMO, TURN, JOINED = 1_000_000, 1 << 20, 256


def best_cuts(ends: np.ndarray, penalty: np.ndarray, window: int, tail: bool = True) -> list[int]:
    """Token positions where windows end, at least total cost. ``ends``: allowed cuts, increasing, the last one being the end.

    ``penalty[k]`` is the price of a cut at ``ends[k]``; no two neighbours (nor 0 and the first) may be over ``window`` apart.
    What the end forces, a short last window, may also be dealt out as powers of two, at ``CUT_WORD`` for each cut. Unless this
    is the ``tail``, the end forces nothing: the cheapest cuts up to anywhere in the last window are given, and what is after them goes on.
    """
    pos = [0, *ends.tolist()]
    cost, come = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost(i) + i, i's place, i
    for j, (p, price) in enumerate(zip(pos[1:], penalty.tolist()), 1):
        while queue[0][1] < p - window:
            queue.popleft()
        least, _, i = queue[0]
        c = least + window - p + price
        cost[j], come[j] = c, i
        c += p
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, p, j))
    out, j, i = [], len(pos) - 1, len(pos) - 2
    if not tail:
        j = min((k for k in range(j, -1, -1) if pos[k] > pos[-1] - window), key=cost.__getitem__)
    while tail and i >= 0 and (n := pos[j] - pos[i]) <= window:
        if (c := cost[i] + CUT_WORD * (n.bit_count() - 1)) < cost[j]:
            cost[j], come[j] = c, i
            out = [pos[j] - sum(1 << b for b in range(k) if n >> b & 1) for k in range(1, n.bit_length()) if n >> k - 1 & 1]
        i -= 1
    while j:
        out.append(pos[j])
        j = come[j]
    return sorted(out)


#: Pre-tokens of a folded word of ASCII and Latin-1 letters, ASCII digits and marks, as the tokenizer's own expression cuts it.
_LETTERS = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++")
_PIECE = re.compile(_LETTERS.pattern + rb"|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]++")

#: Lower case of such letters, byte by byte: A to Z, and what follows \xc3 in U+00C0 to U+00DE without the multiplication sign.
_FOLD = bytes(b + 32 if 65 <= b <= 90 or 128 <= b <= 158 and b != 151 else b for b in range(256))

#: The normalizer and the splitting that ``_PIECE`` and ``_FOLD`` stand for; words meet any other tokenizer whole.
_KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

#: Loaded tokenizers, what is read from their vocabularies, and their words' ids, which the tasks of one Python worker share.
_SHARED: dict[str, tuple] = {}


def _byte_level() -> str:
    """The character that the byte-level alphabet has for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(256 + hidden.index(b) if b in hidden else b) for b in range(256))


class Encoder:
    """Ids of a text as little-endian bytes.

    Words are encoded once while the memo of at most ``MEMO`` words and pre-tokens lasts. A new word that ``_PIECE`` covers is made
    of its pre-tokens' ids; new pre-tokens go to the library's model ``JOINED`` at a time, already lower-cased and cut, so that only
    its merges run. Other words take the library's whole way, with a mark between them that is a pre-token of its own.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        if path not in _SHARED:
            _SHARED[path] = (*self._load(tokenizers, path), {})
        (self.model, self.merges, self.alphabet, self.last, self.digits, ids, self.memo), self.end = _SHARED[path], end_id.to_bytes(4, "little")
        self.stops, self.bar = [i[-1] for i in ids[:3]], ids[3]

    @staticmethod
    def _load(tokenizers, path: str) -> tuple:
        model, merges, alphabet = tokenizers.Tokenizer.from_file(path), None, _byte_level()
        vocabulary = model.get_vocab()
        last, digits = np.zeros((2, model.get_vocab_size()), bool)  # tokens that end a pre-token, and that begin with a digit
        last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        digits[[i for w, i in vocabulary.items() if w[:1].isdigit()]] = True
        bpe = model.model
        parts = [json.loads(p.__getstate__()) if p else None for p in (model.normalizer, model.pre_tokenizer)]
        whole = all(c + end in vocabulary for c in alphabet for end in ("", "</w>"))
        if parts == [*_KNOWN] and isinstance(bpe, tokenizers.models.BPE) and (bpe.end_of_word_suffix, bpe.continuing_subword_prefix, bpe.dropout) == ("</w>", None, None) and whole:
            merges = tokenizers.Tokenizer(bpe)
            merges.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(alphabet[32])
        return model, merges, alphabet, last, digits, [e.ids for e in model.encode_batch_fast([".", "!", "?", "|"], add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Put all of these distinct words, which are not in the memo, into it. It is cleared first if it would get too long."""
        memo, cut, others = self.memo, {}, []  # cut: words and their pre-tokens in one string (many lists would keep the garbage collector busy)
        for w in words:
            folded = w.translate(_FOLD)
            if not self.merges or b"<|" in w:
                others.append(w)
            elif folded.isalpha() or _LETTERS.fullmatch(folded):
                cut[w] = folded
            elif (pieces := _PIECE.findall(folded)) and len(spaced := b" ".join(pieces)) == len(w) + len(pieces) - 1:
                cut[w] = spaced
            else:
                others.append(w)
        new = list(set(b" ".join(cut.values()).split()).difference(memo))
        if memo and len(memo) + len(cut) + len(others) + len(new) > MEMO:
            memo.clear()
            return self.learn(words)
        for at in range(0, len(new), JOINED):
            part = new[at : at + JOINED]
            text = codecs.charmap_decode(b" ".join(part), "strict", self.alphabet)[0]
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends, raw = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist(), ids.tobytes()
            for piece, begin, end in zip(part, [0, *ends[:-1]], ends, strict=True):
                memo[piece] = raw[begin:end]
        joined = [w for w in others if b"|" not in w] if len(self.bar) == 1 else []
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = np.array(self.model.encode_batch_fast([b" | ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            bars, raw, begin = (np.flatnonzero(ids == self.bar[0]) * 4).tolist(), ids.tobytes(), 0
            for w, end in zip(part, [*bars, len(raw)], strict=True):
                memo[w] = raw[begin:end]
                begin = end + 4
        others = [w for w in others if b"|" in w] if len(self.bar) == 1 else others
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            for w, e in zip(part, self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                memo[w] = array("I", e.ids).tobytes()
        for w, pieces in cut.items():
            memo[w] = memo[pieces] if pieces in memo else b"".join(map(memo.__getitem__, pieces.split()))

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # where there is "<|", lower case might make a special string
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), b" ")[0].as_py().split(b" ") if len(distinct) else []
        ids = list(map(self.memo.get, words))
        new = [k for k, i in enumerate(ids) if i is None]
        self.learn([words[k] for k in new])
        for k in new:
            ids[k] = self.memo[words[k]]
        ids.append(self.end)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        places = np.insert(coded.indices.to_numpy(), ends, len(words))  # the end id after each text
        sizes = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(sizes), pa.py_buffer(b"".join(ids))])
        _, at, raw = values.take(pa.array(places)).buffers()
        stops = np.frombuffer(at, np.int64)[ends + 1 + np.arange(len(ends))].tolist()
        raw = memoryview(raw)
        return [bytes(raw[a:b]) for a, b in zip([0, *stops], stops)]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, stops: list[int], digits: np.ndarray, window: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts within the documents of a block, and their prices; those at documents' ends are free."""
    stop = np.flatnonzero(np.isin(ids, stops) if len(stops) > 3 else np.logical_or.reduce([ids == i for i in stops]))
    number = digits[ids[np.maximum(stop - 1, 0)]] & digits[ids[np.minimum(stop + 1, len(ids) - 1)]]
    kind = np.zeros(len(ids) + 1, np.uint8)
    kind[stop[~number] + 1] = 2
    kind[doc_ends] = 3
    soft = np.flatnonzero(kind)
    begins = np.r_[0, soft[:-1]]
    more = np.where(soft - begins > window, (soft - begins - 1) // grid, 0)
    kind[np.repeat(begins, more) + grid * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))] = 1
    ends = np.flatnonzero(kind)
    return ends, np.array([0.0, CUT_WORD, CUT_SENTENCE, 0.0])[kind[ends]]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if ``with_ids``)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sequence = Encoder(tokenizer, end_id), TaskContext.get().partitionId() << 40, 0
        kind = None

        def out(held: list[tuple[object, bytes, int]], last: bool) -> tuple[pa.RecordBatch, list[tuple[object, bytes, int]]]:
            """Pieces of the windows that are fixed, and what is left over: documents (id, ids, how many have gone)."""
            nonlocal sequence
            sizes = np.array([len(raw) >> 2 for _, raw, _ in held])
            ends, prices = boundaries(np.frombuffer(b"".join(raw for _, raw, _ in held), "<u4"), np.cumsum(sizes), encode.stops, encode.digits, window, GRID)
            stop = best_cuts(ends, prices, window, last)
            rows, rest, at, begin, k = [], [], 0, 0, 0
            for (doc_id, raw, gone), n in zip(held, sizes.tolist()):
                start = 0
                while start < n and k < len(stop):
                    length = min(n - start, stop[k] - at)
                    ids = raw[4 * start : 4 * (start + length)]
                    rows.append((doc_id, gone + start, length, zlib.crc32(ids), gone + n, part + sequence, at - begin) + (np.frombuffer(ids, "<u4").tolist(),) * with_ids)
                    start, at = start + length, at + length
                    if at == stop[k]:
                        begin, k, sequence = at, k + 1, sequence + 1
                if start < n:
                    rest.append((doc_id, raw[4 * start :], gone + start))
            types = [kind] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names), rest

        held, tokens = [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            turns = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TURN
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                turn = batch.slice(at, end - at)
                for doc_id, raw in zip(turn.column(0).to_pylist(), encode(turn.column(1))):
                    held.append((doc_id, raw, 0))
                    tokens += len(raw) >> 2
                    if tokens >= block:
                        pieces, held = out(held, False)
                        tokens = sum(len(raw) >> 2 for _, raw, _ in held)
                        yield pieces
        if held:
            yield out(held, True)[0]

    ddl = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into windows of 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
