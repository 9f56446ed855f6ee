"""N-gram Jaccard join over distinct 5-word shingles.

Sets are joined exactly, up to 64-bit hashes of shingles and of whole sets:

1. Equal sets become one class, represented by their hash; copies never meet each other again.
2. A set's prefix, its rarest shingles under one fixed order, must meet the prefix of every set it links with. The
   order comes from a counting sketch of fixed size over all documents, so shingles of common passages come last.
   Prefix shingles that only one class has are dropped where they meet; the rest form tiles (shingle, size band). Sets
   of similar size lie in the same band or in the next one.
   A pair needs a common shingle even in the shorter prefix that its two sizes ask for, so each keeps its place.
3. In a tile every set first meets the tile's pivot only. A parity bitmap of each set bounds overlap from above: the
   bits in which two bitmaps differ can't outnumber the shingles in which the sets do. What passes is intersected
   exactly, as sorted arrays. Connected components merge what is linked.
4. Pairs of a tile's sets that still lie in different components, other than inside its largest one, are compared the
   same way. Pairs inside a component needn't be: they couldn't change it. So a group of n near copies costs n
   comparisons, not n squared, and no link between components is lost.

Cases: null and empty texts, and texts without words, have no shingles and link with nothing; texts of fewer than five
words are one shingle; repeated rows and equal texts share a component; the smallest id names it, a null id never; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, fresh, spread_join, trim, utf8

WORDS = 5
#: Counters of the sketch that orders shingles, and how it is cut for summing.
COUNTERS, SLICES = 1 << 18, 16
#: Bits of the shortest parity bitmap of a set.
LEAST_BITS = 512
#: Active sets and their pairs that are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Partners that one row of a set carries, about.
MEETS = 500
#: Bytes of text hashed at once, unless one text is longer.
CHUNK = 1 << 20
_MUL, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict = {}
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_PREFIX = np.dtype([("t", "<u8"), ("o", "<i8"), ("p", "<i4")])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK * 2)
        for name, base in (("up", _MUL), ("down", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    up, down = _power(len(data) + 1)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    first, last = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    word = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(first, ends_of)])
    rolled = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * _MUL + word[k : len(rolled) + k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _MUL + w
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out, held, size = [], [], 0
    for t in texts:
        data = utf8(t)
        if held and size + len(data) > CHUNK:
            out += _sets(held)
            held, size = [], 0
        held.append(data)
        size += len(data)
    return out + (_sets(held) if held else [])


def _set_hash(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _parity(s: np.ndarray) -> bytes:
    """One bit for each hash bucket: whether the set has an odd number of shingles there. About a bit a shingle, so
    that large sets don't fill it up; the upper halves of a longer bitmap fold onto a shorter one by exclusive or."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ: no more than the shingles in which their sets do."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(x), len(y))
    fold = lambda v: np.bitwise_xor.reduce(v.reshape(-1, size), axis=0)
    return int(np.bitwise_count(fold(x) ^ fold(y)).sum())


def _bound(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [
            (a, b)
            for a, b, n, m, x, y in zip(*[batch.column(k).to_pylist() for k in range(6)])
            if 4 * min(n, m) >= 3 * max(n, m) and 7 * differing(x, y) <= n + m
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def _batches(batches, size: int = 512):
    trim()
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, min(size, batch.num_rows - i))


def _measure(batches):
    """Per document: number of shingles, set hash, bitmap; last, what the partition counted for the sketch."""
    import pyarrow as pa

    counted = np.zeros(COUNTERS, np.int64)
    names = ["doc_id", "n", "node", "bits", "slice", "counts"]
    for batch in _batches(batches):
        sets = shingle_sets(batch.column(1).to_pylist())
        for s in sets:
            counted[(s & np.uint64(COUNTERS - 1)).astype(np.int64)] += 1
        nothing = pa.nulls(len(sets), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_hash(s) for s in sets], pa.int64()), pa.array([_parity(s) for s in sets], pa.binary()), nothing, pa.nulls(len(sets), pa.binary())],
            names,
        )
    parts = counted.reshape(SLICES, -1)
    nothing = pa.nulls(SLICES, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [nothing] * 3 + [pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names
    )


MEASURED = "doc_id long, n long, node long, bits binary, slice int, counts binary"


def _add(key, table):
    import pyarrow as pa

    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(measured: DataFrame) -> np.ndarray:
    """Sum of the partitions' counters: in two steps, 256 partitions at a time, to a sketch of fixed size."""
    rows = measured.where("slice is not null").select("slice", "counts")
    salts = max(1, measured.rdd.getNumPartitions() // 256)
    some = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    some = some.groupBy("slice", "salt").applyInArrow(_add, "slice int, counts binary")
    total = some.groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect() if salts > 1 else some.collect()
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in total:
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def prefix(s: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set, as many as any set that links with it must share one of, and their counts."""
    n = len(s)
    count = sketch[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
    of = np.lexsort((s, count))[: n - -(-3 * n // 4) + 1]
    return s[of], count[of]


def _deal(sketch, hot: float, parts: int):
    """Prefix shingles packed by partition; those too common to be anyone's alone go on as they are."""

    def run(batches):
        import pyarrow as pa

        for batch in _batches(batches, 2048):
            tokens, owners, places, common = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                if len(s):
                    t, c = prefix(s, sketch.value)
                    tokens.append(t)
                    owners.append(np.full(len(t), _set_hash(s), np.int64))
                    places.append(np.arange(len(t), dtype=np.int32))
                    common.append(c > hot)
            if not tokens:
                continue
            token, owner, place, is_hot = np.concatenate(tokens), np.concatenate(owners), np.concatenate(places), np.concatenate(common)
            part = np.where(is_hot, owner.view(np.uint64), token >> np.uint64(8)) % np.uint64(parts)
            pack = np.rec.fromarrays([token, owner, place], dtype=_PREFIX)
            rows = []
            for p in np.unique(part):
                mine = part == p
                rows.append((int(p), pack[mine & ~is_hot].tobytes(), np.unique(pack[mine & is_hot]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "cold", "hot"])

    return run


def _shared(batches):
    """(token, node, place) for tokens that more than one node has; place counts rarer shingles of the node."""
    import pyarrow as pa

    cold: list[bytes] = []

    def out(t, o, p):
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(o), pa.array(p)], ["token", "node", "place"])

    parts = lambda rows: [np.ascontiguousarray(rows[k]) for k in "top"]
    for batch in batches:
        for c, h in zip(batch.column(1), batch.column(2)):
            cold.append(c.as_py())
            if rows := h.as_py():
                yield out(*parts(np.frombuffer(rows, _PREFIX)))
    t, o, p = parts(np.frombuffer(b"".join(cold), _PREFIX))
    order = np.lexsort((o, t))
    t, o, p = t[order], o[order], p[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    t, o, p = t[new], o[new], p[new]
    same = t[1:] == t[:-1]
    keep = np.zeros(len(t), bool)
    keep[1:] |= same
    keep[:-1] |= same
    t, o, p = t[keep], o[keep], p[keep]
    for i in range(0, len(t), 100_000):
        yield out(t[i : i + 100_000], o[i : i + 100_000], p[i : i + 100_000])


def _carry(batches):
    """Each set once as a pivot, and once for every pair in which it meets another one."""
    import pyarrow as pa

    for batch in _batches(batches, 64):
        sets = shingle_sets(batch.column(1).to_pylist())
        rows = []
        for s, is_pivot, meets, node in zip(sets, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if _set_hash(s) == node:  # another row can have the same id
                data = s.tobytes()
                rows += [(node, None, data)] * is_pivot + [(a, node, data) for a in meets]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["a", "b", "set"])


def _intersect(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for a, b, x, y in zip(*[batch.column(k) for k in range(4)]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * both >= 75 * (len(x) + len(y) - both):
                rows.append((a.as_py(), b.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


class _Join:
    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.scratch, self.spark = docs, scratch, scratch.spark

    def bounded(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) that size and bitmap don't rule out."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(_bound, "a long, b long")

    def linked(self, pairs: DataFrame, nodes: DataFrame, tag: str) -> DataFrame:
        """Pairs (a, b) whose sets meet the threshold, by exact intersection. A set travels once for each pair in which
        it is b, and once if it is any pair's a."""
        many = pairs.groupBy("b").agg(F.floor(F.count("*") / MEETS).alias("salts"))  # a set with many partners gets several rows
        salted = pairs.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts") + 1))
        meets = salted.groupBy(F.col("b").alias("node"), "salt").agg(F.collect_list("a").alias("meets")).drop("salt")
        pivots = pairs.select(F.col("a").alias("node"), F.lit(1).alias("pivot")).distinct()
        active = nodes.select("node", F.col("rep").alias("doc_id")).join(meets.join(pivots, "node", "full"), "node")
        active = active.select("doc_id", F.coalesce("pivot", F.lit(0)).alias("pivot"), F.coalesce("meets", F.array().cast("array<long>")).alias("meets"), "node")
        active = self.scratch.save(active, f"active_{tag}")
        size = active.agg(F.count("*"), F.sum(F.size("meets"))).first()
        few = size[0] + (size[1] or 0) <= BROADCAST_IDS
        held = self.docs.join(F.broadcast(active) if few else active, "doc_id").select("doc_id", "text", "pivot", "meets", "node")
        carried = self.scratch.save(held.mapInArrow(_carry, "a long, b long, set binary"), f"sets_{tag}")
        one = carried.where("b is not null").select("a", "b", F.col("set").alias("y"))
        other = carried.where("b is null").select("a", F.col("set").alias("x"))
        links = one.join(other, "a").select("a", "b", "x", "y").mapInArrow(_intersect, "a long, b long").distinct()
        links = self.scratch.save(links, f"links_{tag}")
        self.scratch.drop(f"sets_{tag}")
        return links


def components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = scratch.spark
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    join = _Join(docs, scratch)
    measured = scratch.save(docs.mapInArrow(_measure, MEASURED), "measured")
    rows = measured.where("slice is null").select("doc_id", "n", "node")
    sketch = _sketch(measured)
    mean = float(sketch.mean())
    hot = mean + 12 * mean**0.5 + 64
    nodes = measured.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    nodes = scratch.save(nodes, "nodes")
    packed = int(sketch.sum()) * 4  # bytes: a quarter of the shingles, 16 each
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packed // (32 << 20) + 1)
    dealt = docs.mapInArrow(_deal(spark.sparkContext.broadcast(sketch), hot, parts), "part int, cold binary, hot binary")
    shared = scratch.save(dealt.repartition(parts, "part").mapInArrow(_shared, "token long, node long, place int").distinct(), "shared")
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    tiles = scratch.save(shared.join(nodes.select("node", "n"), "node").select("token", "node", "place", "n", band.alias("band")), "tiles")
    scratch.drop("shared")
    # each set meets the pivots of its own band and of the next; a pivot has few shingles rarer than the tile's, as a
    # text has from which the others were copied
    pivots = tiles.groupBy("token", "band").agg(F.min_by(F.struct("node", "n", "place"), F.struct(F.col("place") / F.col("n"), F.xxhash64("node"))).alias("p"))
    near = pivots.select("token", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "p")
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def meet(n, place, m, other):
        """Sizes within the threshold, and the shingle within the prefix that sets of just these sizes need."""
        free = lambda size: size - F.ceil((F.col(n) + F.col(m)) * F.lit(3) / F.lit(7))
        sizes = F.least(n, m) * 4 >= F.greatest(n, m) * 3
        return sizes & (F.col(place) <= free(F.col(n))) & (F.col(other) <= free(F.col(m)))

    first = tiles.join(near, ["token", "band"]).select("node", "n", "place", F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("p.place").alias("px"))
    first = first.where((F.col("node") != F.col("x")) & meet("n", "place", "nx", "px")).select(F.col("x").alias("a"), F.col("node").alias("b")).distinct()
    first = scratch.save(join.bounded(first, nodes), "first")
    links = join.linked(first, nodes, "first")
    classes = connected_components(links, scratch, "cc")
    # what the pivots left apart
    own = tiles.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = scratch.save(own, "own")
    sizes = own.groupBy("token", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("k")).where("k > 1")
    apart = own.join(largest.select("token", "largest"), "token")
    minor = apart.where("component <> largest").select("token", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    rest = minor.join(apart.select("token", "node", "component", "n", "place"), "token")
    rest = rest.where((F.col("cx") != F.col("component")) & meet("n", "place", "nx", "px")).select(*pair("x", "node")).distinct()
    rest = scratch.save(join.bounded(rest.join(first.select(*pair("a", "b")), ["a", "b"], "left_anti"), nodes), "rest")
    if not rest.isEmpty():
        more = join.linked(rest, nodes, "rest")
        classes = connected_components(links.union(more), scratch, "cc_all")
    # a component may have a large share of all sets; sets without a link are their own
    named = scratch.save(nodes.select("node", "rep").join(classes, "node", "left"), "named")
    linked = named.where("component is not null")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = spread_join(linked, smallest, "component", "node").select("node", "component_id")
    ids = scratch.save(ids.unionByName(named.where("component is null").select("node", F.col("rep").alias("component_id"))), "ids")
    out = rows.join(ids, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns; rows without shingles stay. Rows are
    known by a written key of their own, so ids may be null (those come last) or repeated: rows that share an id and
    differ in text are judged apart."""
    row = fresh("__row", docs.columns)
    keyed = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = scratch.save(components(keyed, scratch, row).select(F.col("doc_id").alias("row"), "component_id"), "found")
    shared = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    ids = keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    held = spread_join(found, shared, "component_id", "row").join(ids, "row")
    first = held.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("first"))
    copies = scratch.save(spread_join(found, first, "component_id", "row").where("row <> first").select(F.col("row").alias(row)), "copies")
    return keyed.join(copies, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
