"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Documents are encoded, given the end id, and cut only if they are longer than a sequence. Packing needs no more than
how many pieces have each length, at most 4,096 numbers whatever the corpus; the driver packs this histogram and
gives out ranges of (length, rank), and each piece finds its place by its rank among the pieces of its length.

A bin is filled with the longest piece that still fits, again and again; then its smallest piece gives way to two
unpacked ones if these fit the widened gap more tightly. A filled pattern is repeated as often as the counts allow.

Cases: a null text counts as empty, and an empty text is the end id alone; repeated rows are packed each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, trim, utf8

CAPACITY, END = 4096, 1
_END = struct.pack("<I", END)
#: The pre-tokenizer's pattern for lower-cased printable ASCII.
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_PRINTABLE = re.compile(rb"[!-~]+").fullmatch
#: Chunks, and pieces, whose ids a worker remembers; each memory is emptied when it is full.
REMEMBERED = 1_000_000
_state: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Pieces(dict):
    """Ids, as bytes, of the pieces that the tokenizer's pattern cuts texts into, by their normalized text."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.cut = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, piece: str) -> bytes:
        letters = [piece] if piece.isascii() else [p for p, _ in self.cut(piece)]  # the model's byte alphabet
        ids = [t.id for p in letters for t in self.model.tokenize(p)]
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder(dict):
    """Ids of whole texts. The tokenizer drops white space and never looks across it, so a text's ids are those of its
    chunks between ASCII white space, one after another; each chunk is remembered with its ids. A new chunk of Latin
    letters is put together from its pieces, as the tokenizer's own pattern cuts it, so that the tokenizer's model sees
    a piece once for all its cases and punctuation; other chunks go through the whole tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)
        with open(path) as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern).findall

    def __missing__(self, chunk: bytes) -> bytes:
        low = chunk.lower()
        if low.isalpha():
            ids = self.pieces[low.decode()]
        elif b"<|" not in low and _PRINTABLE(low):
            ids = b"".join([self.pieces[p.decode()] for p in _ASCII_PIECES(low)])
        else:
            text = chunk.decode("utf-8", "replace")
            if max(text) < "\u0250" and "\u0130" not in text and text.isprintable() and "<|" not in text:
                ids = b"".join([self.pieces[p] for p in self.cut(text.lower())])  # composed already; one letter for one
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        self[chunk] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        for memory in (self, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        return [np.frombuffer(b"".join([*map(self.__getitem__, utf8(t).split()), _END]), "<u4") for t in texts]


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document."""
    path = path or vocabulary()

    def run(batches):
        import pyarrow as pa

        trim()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            size = max(1, min(len(ids), 256))
            for i in range(0, len(ids), size):
                rows = []
                for key, x in zip(ids[i : i + size], encoder(path)(batch.column(1)[i : i + size].to_pylist())):
                    for k, at in enumerate(range(0, len(x), capacity)):
                        part = x[at : at + capacity]
                        rows.append((key, k, at, len(part), zlib.crc32(part.tobytes()), part))
                kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                if with_ids:
                    kinds.append(("ids", pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many in a bin)], how many bins) that use up all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        free = left.copy()
        use: dict[int, int] = {}
        gap = capacity
        fits = np.flatnonzero(free)
        while gap and (k := np.searchsorted(fits, gap, "right")):
            length = int(fits[k - 1])
            n = int(min(free[length], gap // length))
            use[length] = use.get(length, 0) + n
            free[length] -= n
            gap -= n * length
            fits = fits[: k - 1] if free[length] else fits[: k - 1]
        small = min(use)
        room = gap + small
        if gap:
            a = np.flatnonzero(free[: room + 1])
            if len(a):
                b = a[np.maximum(np.searchsorted(a, room - a, "right") - 1, 0)]
                twice = (a == b) & (free[a] < 2)
                b = np.where(twice, np.concatenate([[0], a])[np.searchsorted(a, b)], b)
                total = np.where((b > 0) & (a + b <= room), a + b, 0)
                best = int(total.argmax())
                if total[best] > small:
                    use[small] -= 1
                    for x in (int(a[best]), int(b[best])):
                        use[x] = use.get(x, 0) + 1
        use = {k: n for k, n in use.items() if n}
        times = min(int(left[k]) // n for k, n in use.items())
        for k, n in use.items():
            left[k] -= n * times
        out.append((sorted(use.items(), reverse=True), times))
    return out


def ranges(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, pieces in a bin, first sequence, offset of the first such piece in a bin."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, n in pattern:
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(parts: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """parts (a written table) with sequence_id and offset."""
    spark = scratch.spark
    salt = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)).cast("int"))
    counts = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most one row for each length
    held = spark.sparkContext.broadcast(ranges(pack_histogram({r["length"]: r["n"] for r in total}, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("at", F.row_number().over(order)).join(first, ["length", "salt"])
    names = [c for c in parts.columns]
    ranked = ranked.select(*names, (F.col("first") + F.col("at") - 1).alias("rank"))

    def place(batches):
        import pyarrow as pa

        known = held.value
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                of, r = np.flatnonzero(lengths == length), known[int(length)]
                row = r[np.searchsorted(r[:, 0], rank[of], "right") - 1]
                t = rank[of] - row[:, 0]
                sequence[of], offset[of] = row[:, 2] + t // row[:, 1], row[:, 3] + t % row[:, 1] * length
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(place, schema + ", sequence_id long, `offset` long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return pack(scratch.save(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces"), scratch)
