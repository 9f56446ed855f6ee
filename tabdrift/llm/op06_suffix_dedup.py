"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A 50-byte string that also starts in a document with a smaller id is removed, wherever it stands in other documents.

1. Equal texts are one text of their smallest id; later copies go as a whole.
2. Every 50-byte window has one anchor, the least hash among the 20-byte strings in it. Equal windows have equal
   anchors, so anchors that only one text has can be dropped, and a window only has to meet windows of its anchor.
3. Windows of shared anchors go, as one stretch of bytes per anchor and text, to the tile of the anchor. A tile joins its
   distinct stretches to one string and builds its suffix array and transform. From the interval of all suffixes, a
   breadth-first backward extension makes the intervals of strings of 1, 2, 3, ... 50 bytes, only of those that end where
   50 bytes fit before, and drops intervals of a single stretch on the way; it stops at 50, where the intervals are the classes of equal windows.
4. Each class's smallest id decides which windows go; a last pass cuts them out.

Cases: a null text counts as empty; texts below 50 bytes lose nothing; rows that repeat a document have equal ids and
don't remove each other; rows without an id lose nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, utf8
from .op05_jaccard import _batches, _power, mix

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of stretches in one transform, unless one anchor has more.
TILE = 1 << 20
_BYTES = np.random.default_rng(6).integers(0, 1 << 64, 256, np.uint64)
_ENTRY = np.dtype([("t", "<u4"), ("o", "<u4"), ("p", "<u2")])
_STRETCH = np.dtype([("h", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("size", "u1")])  # one anchor has 31 windows at most
#: Stretches are compressed closer than shuffle files are.
_ZSTD = "zstd"


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-byte window the position of its anchor, and the hashes of all 20-byte strings."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], dtype=np.uint64)])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    m = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)  # ties go to the first
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    m = np.minimum(m[: n - LENGTH + 1], m[SPAN - 16 : SPAN - 16 + n - LENGTH + 1])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _deal(parts: int):
    """Anchors of each text, packed by partition: 32 more bits of the anchor, 48 bits of the text's hash."""

    def run(batches):
        import pyarrow as pa

        for batch in _batches(batches, 4096):
            hashes, owners = [], []
            for t, node in zip(batch.column(0), batch.column(1).to_pylist()):
                at, h = anchors(utf8(t.as_py()))
                if len(at):
                    hashes.append(np.unique(h[at[np.concatenate([[True], at[1:] != at[:-1]])]]))
                    owners.append(np.full(len(hashes[-1]), node, np.int64))
            if hashes:
                h, o = np.concatenate(hashes), np.concatenate(owners).view(np.uint64)
                part = _part(h, parts)
                order = np.argsort(part, kind="stable")
                rows = np.empty(len(h), _ENTRY)
                rows["t"], rows["o"], rows["p"] = (h & np.uint64(0xFFFFFFFF))[order], (o & np.uint64(0xFFFFFFFF))[order], (o >> np.uint64(32) & np.uint64(0xFFFF))[order]
                which, first = np.unique(part[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, first[1:])], pa.binary())], ["part", "rows"])

    return run


def _shared(batches):
    """For each text, by partition, the anchors that other texts have too."""
    import pyarrow as pa

    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for p, r in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(p, []).append(r.as_py())
    for p, blobs in held.items():
        rows = np.frombuffer(b"".join(blobs), _ENTRY)
        t = rows["t"].astype(np.int64)
        o = rows["o"].astype(np.int64) | rows["p"].astype(np.int64) << 32
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        same = t[1:] == t[:-1]
        keep = np.zeros(len(t), bool)
        keep[1:] |= same
        keep[:-1] |= same
        t, o = t[keep], o[keep]
        order = np.argsort(o, kind="stable")
        t, o = t[order].astype("<u4"), o[order]
        which, first = np.unique(o, return_index=True)
        lists = [x.tobytes() for x in np.split(t, first[1:])] if len(t) else []
        for i in range(0, len(lists), 10_000):
            part = lists[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(which[i : i + 10_000]), pa.array([p] * len(part), pa.int32()), pa.array(part, pa.binary())], ["node48", "part", "anchors"])


def _pack(meta: np.ndarray, data: bytes) -> bytes:
    """Count and length, then the fields one after another and the bytes of all stretches, compressed."""
    import pyarrow as pa

    raw = b"".join([meta[f].tobytes() for f in _STRETCH.names]) + data
    return np.array([len(meta), len(raw)], "<i8").tobytes() + pa.Codec(_ZSTD, 1).compress(raw, asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    import pyarrow as pa

    count, length = np.frombuffer(packed, "<i8", 2).tolist()
    raw = pa.Codec(_ZSTD).decompress(packed[16:], length, asbytes=True)
    meta, at = np.empty(count, _STRETCH), 0
    for f in _STRETCH.names:
        meta[f] = np.frombuffer(raw, _STRETCH[f], count, at)
        at += count * _STRETCH[f].itemsize
    return meta, raw[at:]


def _stretches(parts: int):
    """For each shared anchor of a text, the bytes of the windows that it stands for, packed by the anchor's tile."""

    def run(batches):
        import pyarrow as pa

        for batch in _batches(batches, 256):
            metas, chunks = [], []
            for doc, t, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = utf8(t.as_py())
                at, h = anchors(data)
                if not len(at):
                    continue
                keys = np.concatenate([np.frombuffer(x["anchors"], "<u4").astype(np.int64) | x["part"] << 32 for x in known])
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                last = np.append(first[1:], len(at)) - 1
                own = h[at[first]]
                hit = np.isin((own & np.uint64(0xFFFFFFFF)).astype(np.int64) | _part(own, parts) << 32, keys)
                first, last, own = first[hit], last[hit], own[hit]
                meta = np.empty(len(own), _STRETCH)
                meta["h"], meta["doc"], meta["at"], meta["size"] = own, doc, first, last + LENGTH - first
                metas.append(meta)
                chunks += [data[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
            if not chunks:
                continue
            meta = np.concatenate(metas)
            part = _part(meta["h"], parts)
            rows = []
            for p in np.unique(part):
                of = np.flatnonzero(part == p)
                rows.append((int(p), _pack(meta[of], b"".join([chunks[i] for i in of]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "packed"])

    return run


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order; zeros are ends, each smaller than any byte and than later ends. No run without an end is
    longer than longest, so doubling stops there."""
    n = len(text)
    rank = text.astype(np.int64)
    ends = np.flatnonzero(text == 0)
    rank += len(ends)
    rank[ends] = np.arange(len(ends))
    width, top = 1, len(ends) + 257
    if top < 46_000:  # four bytes fit one number
        step = np.concatenate([rank, np.zeros(3, np.int64)])
        key = ((rank * top + step[1 : n + 1]) * top + step[2 : n + 2]) * top + step[3 : n + 3]
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        width, top = 4, n
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        key = rank * (top + 1) + follow
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        width *= 2
        top = n
        if width > longest or rank[order[-1]] == n - 1:
            return order


def classes(stretches: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in the stretches joined with an end after each, where a string of this length starts that another
    stretch has too, and the class of equal strings that each belongs to."""
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, np.uint16(0)) for s in stretches])
    n = len(text)
    owner = np.repeat(np.arange(len(stretches), dtype=np.int32), [len(s) + 1 for s in stretches])
    order = suffix_array(text, max(map(len, stretches)) + 1)
    bwt = text[order - 1]  # of the first suffix: the last end
    by_char = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int32)  # from the row of a suffix to the row of the one that starts a byte before
    back[by_char] = np.arange(n, dtype=np.int32)
    own = owner[order]
    # rows of the suffixes that a string of this length can end before: so many bytes of their stretch go before them
    begin = np.cumsum([0] + [len(s) + 1 for s in stretches[:-1]])
    rows = np.flatnonzero(order - begin[own] >= length).astype(np.int32)
    which, parent = np.zeros(len(rows), np.int32), np.empty(n, np.int32)
    for _ in range(length):
        if not len(rows):
            break
        to = back[rows]
        parent[to] = which
        rows = np.sort(to)
        up = parent[rows]
        first_byte = text[order[rows]]
        new = np.ones(len(rows), bool)
        new[1:] = (up[1:] != up[:-1]) | (first_byte[1:] != first_byte[:-1])
        which = np.cumsum(new, dtype=np.int32) - 1
        # intervals of a single stretch can't grow into shared ones
        starts = np.flatnonzero(new)
        shared = np.minimum.reduceat(own[rows], starts) != np.maximum.reduceat(own[rows], starts)
        keep = shared[which]
        rows, which = rows[keep], which[keep]
    return order[rows].astype(np.int64), which.astype(np.int64)


def _windows(meta: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end of the removed parts among some stretches."""
    number: dict[bytes, int] = {}
    ctx = np.fromiter((number.setdefault(c, len(number)) for c in chunks), np.int64, len(chunks))
    distinct = list(number)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, ctx, meta["doc"])
    sizes = np.array([len(s) for s in distinct])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    best = np.repeat(least, sizes + 1)
    if len(distinct) > 1:
        at, which = classes(distinct)
        if len(at):
            smallest = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, which, best[at])
            best[at] = np.minimum(best[at], smallest[which])
    count = sizes[ctx] - LENGTH + 1
    entry = np.repeat(np.arange(len(ctx)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    gone = best[base[ctx][entry] + inside] < meta["doc"][entry]
    entry, inside = entry[gone], inside[gone]
    if not len(entry):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (inside[1:] != inside[:-1] + 1)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(entry)) - 1
    doc, at = meta["doc"][entry[start]], meta["at"][entry[start]].astype(np.int64)
    return doc, at + inside[start], at + inside[stop] + LENGTH


def _tiles(batches):
    import pyarrow as pa

    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for p, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(p, []).append(packed.as_py())
    while held:
        _, blobs = held.popitem()
        pairs = [_unpack(x) for x in blobs]
        del blobs
        meta = np.concatenate([m for m, _ in pairs])
        data = b"".join([d for _, d in pairs])
        del pairs
        offset = np.cumsum(meta["size"], dtype=np.int64) - meta["size"]
        order = np.argsort(meta["h"], kind="stable")
        size = np.cumsum(meta["size"][order], dtype=np.int64)
        new = np.flatnonzero(np.concatenate([[True], meta["h"][order][1:] != meta["h"][order][:-1]]))
        tile = (size[new] - meta["size"][order][new]) // TILE
        cuts = [*new[np.concatenate([[True], tile[1:] != tile[:-1]])].tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:]):
            of = order[a:b]
            chunks = [data[i : i + n] for i, n in zip(offset[of].tolist(), meta["size"][of].tolist())]
            doc, start, end = _windows(meta[of], chunks)
            if len(doc):
                by = np.argsort(doc, kind="stable")
                spans = np.stack([start[by], end[by]], 1).astype("<i8")
                which, first = np.unique(doc[by], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array([x.tobytes() for x in np.split(spans, first[1:])], pa.binary())], ["doc_id", "spans"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, t, copy, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                data = utf8(t.as_py())
                spans = spans.as_py()
                if copy and len(data) >= LENGTH:
                    cut = [(0, len(data))]
                elif spans:
                    s = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    far = np.maximum.accumulate(s[:, 1])
                    new = np.flatnonzero(np.concatenate([[True], s[1:, 0] > far[:-1]]))
                    cut = list(zip(s[new, 0].tolist(), far[np.append(new[1:], len(s)) - 1].tolist()))
                else:
                    cut = []
                kept, at = [], 0
                for a, b in cut:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                row = (doc, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                rows.append(row + (kept.decode("utf-8", "ignore"),) * with_text)
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"][: 5 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def deduplicate(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of the rest, and the rest if asked for."""
    spark = scratch.spark
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"coalesce(`{text_col}`, '') as text").withColumn("node", F.xxhash64("text"))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (24 << 20) + 1)
    dealt = docs.select("text", "node").mapInArrow(_deal(parts), "part int, rows binary")
    lists = dealt.repartition(parts, "part").mapInArrow(_shared, "node48 long, part int, anchors binary")
    lists = lists.groupBy("node48").agg(F.collect_list(F.struct("part", "anchors")).alias("known"))
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("rep"))
    low = F.col("node").bitwiseAND(F.lit(0xFFFFFFFFFFFF))
    lists = nodes.withColumn("node48", low).join(lists, "node48").select("node", F.col("rep").alias("doc_id"), "known")
    lists = scratch.save(lists, "lists")
    del dealt
    scratch.release()

    held = docs.join(lists.hint("merge"), ["doc_id", "node"]).select("doc_id", "text", "known")
    dealt = held.mapInArrow(_stretches(parts), "part int, packed binary")
    spans = dealt.repartition(parts, "part").mapInArrow(_tiles, "doc_id long, spans binary")
    spans = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    reps = nodes.select("node", "rep")
    fate = docs.select("doc_id", "node").join(reps, "node").where("doc_id > rep").select("doc_id", "node", F.lit(True).alias("copy")).distinct()
    fate = fate.withColumn("spans", F.lit(None).cast("array<binary>")).unionByName(
        lists.select("doc_id", "node").join(spans, "doc_id").select("doc_id", "node", F.lit(False).alias("copy"), "spans")
    )
    fate = scratch.save(fate, "fate")
    del lists, held, dealt, spans
    scratch.release()
    out = docs.join(fate.hint("merge"), ["doc_id", "node"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)), "spans")
    return out.mapInArrow(_cut(with_text), RESULT + ", text string" * with_text)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
