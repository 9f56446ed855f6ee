"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every passage of every document (windows of words, half of each shared with the next, and wide enough that an item
lies whole in one of them) is a query; all items above the threshold come back, not a top few. Scores are divided by
the item's score against itself, so one threshold means the same for long and short items. A hit counts when its
question (the first half of the item) and its answer (the rest) both overlap with the words around the passage.

The index is held by every worker, so it is built for at most SHARD_ITEMS items at a time; more items are searched
shard by shard, each over all documents, and the results are merged by a written row key. Document frequencies, the
number of items, their mean length and the longest item are those of the whole benchmark in every shard, so results
don't depend on the number of shards.

Cases: null and empty texts have no passages and aren't contaminated; items without words are left out; an item shorter
than five words, or half of one, is looked for as a whole; equal items each come back; repeated documents each get a row
per row; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words_of

THRESHOLD = 0.6
#: Least share of the 5-word shingles of question and of answer that must occur around the passage.
OVERLAP = 0.5
SHINGLE = 5
SHARD_ITEMS = 20_000
#: Share of an item's score that its most common terms may give without being looked at first.
COMMON = 0.3
K1, B, BLOCK = 1.2, 0.75, 32


class Index:
    """Postings by term: item numbers in order, impacts, and the largest impact of each block and of the term.

    For a shard, whole describes all items: their number, the sum of their lengths, the longest, and df by word."""

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, int, int, dict[bytes, int]] | None = None):
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        n = len(kept)
        lengths = [len(w) for w in self.words]
        every, total, self.longest, df = whole or (n, sum(lengths), max(lengths, default=0), None)
        mean = total / every if every else 1.0
        lists: dict[bytes, dict[int, int]] = {}
        for k, words in enumerate(self.words):
            for w in words:
                lists.setdefault(w, {}).setdefault(k, 0)
                lists[w][k] += 1
        own = np.zeros(n)
        self.number = {w: t for t, w in enumerate(lists)}
        self.docs, self.impacts = [], []
        for w, found in lists.items():
            held = len(found) if df is None else df[w]
            idf = math.log(1 + (every - held + 0.5) / (held + 0.5))
            at, tf = np.fromiter(found, np.int64), np.fromiter(found.values(), np.float64)
            length = np.array([len(self.words[k]) for k in at])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            own[at] += impact
            self.docs.append(at)
            self.impacts.append(impact)
        self.impacts = [x / own[d] for d, x in zip(self.docs, self.impacts)]
        self.most = np.array([x.max() for x in self.impacts] + [0.0])  # the last: terms of no item
        self.blocks = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impacts]
        self._essential(own)
        self.shingles = [self._halves(w) for w in self.words]

    def _essential(self, own: np.ndarray) -> None:
        """Splits each item's terms: common ones, which together give less than COMMON of its score, and the rest.
        A passage that reaches the threshold gets at least the difference from the rest, whose postings are short."""
        n = len(self.ids)
        term = np.repeat(np.arange(len(self.docs)), [len(d) for d in self.docs])
        doc = np.concatenate([*self.docs, np.zeros(0, np.int64)])
        impact = np.concatenate([*self.impacts, np.zeros(0)])
        df = np.array([len(d) for d in self.docs] + [0])
        order = np.lexsort((term, -df[term], doc))
        term, doc, impact = term[order], doc[order], impact[order]
        total = np.cumsum(impact)
        first = np.searchsorted(doc, np.arange(n))
        before = np.concatenate([[0.0], total])[first]
        common = total - before[doc] < COMMON
        self.need = THRESHOLD - np.bincount(doc[common], impact[common], n) - 1e-9
        order = np.argsort(term[~common], kind="stable")
        self.rare_doc, self.rare_impact = doc[~common][order], impact[~common][order]
        self.rare_at = np.searchsorted(term[~common][order], np.arange(len(self.docs) + 2))

    def promising(self, terms: np.ndarray) -> np.ndarray:
        """Passages (numbers of their first half) that some item's rarer terms don't rule out."""
        n, end = len(self.ids), len(self.number)
        half = np.arange(len(terms)) // self.longest
        pairs = np.unique((half * (end + 1) + terms)[self.rare_at[terms + 1] > self.rare_at[terms]])
        half, term = np.divmod(pairs, end + 1)
        count = self.rare_at[term + 1] - self.rare_at[term]
        at = np.repeat(self.rare_at[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        key, inverse = np.unique(np.repeat(half, count) * n + self.rare_doc[at], return_inverse=True)
        if not len(key):
            return key
        score = np.bincount(inverse, self.rare_impact[at])
        follows = np.minimum(np.searchsorted(key, key + n), len(key) - 1)
        before = np.maximum(np.searchsorted(key, key - n), 0)
        after = np.where(key[follows] == key + n, score[follows], 0.0)
        ahead = np.where(key[np.minimum(before, len(key) - 1)] == key - n, 0.0, score)  # the passage that ends with this half
        need = self.need[key % n]
        found = np.concatenate([key[score + after >= need] // n, key[(ahead >= need) & (key >= n)] // n - 1])
        return np.unique(found)

    @staticmethod
    def _halves(words: list[bytes]) -> list[set]:
        middle = (len(words) + 1) // 2
        return [shingles(part) for part in (words[:middle], words[middle:]) if part]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for these distinct terms is at least the threshold: block-max WAND."""
        lists = [[self.docs[t], self.impacts[t], self.blocks[t], self.most[t], 0] for t in terms]
        out, end = [], len(self.ids)
        slack = threshold - 1e-9
        while True:
            lists = [x for x in lists if x[4] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= slack:
                    pivot = k
                    break
            if pivot is None:
                return out
            doc = int(lists[pivot][0][lists[pivot][4]])
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == doc:
                pivot += 1
            # the blocks where the pivot would lie
            tight, until = 0.0, end
            for x in lists[: pivot + 1]:
                k = x[4] // BLOCK
                while (k + 1) * BLOCK < len(x[0]) and x[0][(k + 1) * BLOCK - 1] < doc:
                    k += 1
                tight += x[2][k]
                last = min((k + 1) * BLOCK, len(x[0])) - 1
                until = min(until, int(x[0][last]) + 1)
            if tight >= slack:
                if lists[0][0][lists[0][4]] == doc:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += x[1][x[4]]
                        x[4] += 1
                    if score >= slack:
                        out.append((doc, float(score)))
                else:
                    for x in lists[:pivot]:
                        x[4] += int(np.searchsorted(x[0][x[4] :], doc))
            else:
                after = max(doc + 1, until)
                if pivot + 1 < len(lists):
                    after = min(after, int(lists[pivot + 1][0][lists[pivot + 1][4]]))
                after = max(after, doc + 1)
                for x in lists[: pivot + 1]:
                    x[4] += int(np.searchsorted(x[0][x[4] :], after))

    def hits(self, text: str | None) -> dict[int, float]:
        """Items that a text holds, with their best score."""
        words = words_of(text)
        if not words or not self.ids:
            return {}
        none = len(self.number)
        terms = np.fromiter((self.number.get(w, none) for w in words), np.int64, len(words))
        step = self.longest
        found: dict[int, float] = {}
        for half in self.promising(terms).tolist():
            a = half * step
            b = min(len(words), a + 2 * step)
            own = np.unique(terms[a:b])
            own = own[own < none]
            if self.most[own].sum() < THRESHOLD - 1e-6:
                continue
            around = None
            for k, score in self.search(own.tolist(), THRESHOLD):
                if around is None:
                    near = words[max(0, a - step) : b + step]
                    around = shingles(near)
                    text_ = b" ".join([b"", *near, b""])
                if all(_share(s, around, text_) >= OVERLAP for s in self.shingles[k]):
                    found[k] = max(found.get(k, 0.0), score)
        return {self.ids[k]: s for k, s in found.items()}


def shingles(words: list[bytes]) -> set:
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def _share(part: set, around: set, text: bytes) -> float:
    if len(part) == 1:  # may be shorter than a shingle
        return float(b" " + next(iter(part)) + b" " in text)
    return len(part & around) / len(part)


SCHEMA = "doc_id long, items array<long>, scores array<double>"


def _indexes(spark, benchmark: DataFrame, scratch: Scratch):
    """Yields the broadcast index of each shard in turn, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    if shards == 1:
        yield spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()])), True
        return

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            held = [words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, held), pa.int64()), pa.array([sorted(set(w)) for w in held], pa.list_(pa.binary()))], ["shard", "n", "words"])

    items = scratch.save(items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))), "items")
    known = scratch.save(items.select("shard", "text").mapInArrow(words, "shard long, n long, words array<binary>").where("n > 0"), "item_words")
    every, total, longest = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    each = known.select("shard", F.explode("words").alias("word")).groupBy("shard", "word").agg(F.count("*").alias("n"))
    each = scratch.save(each, "item_words_by_shard")
    df = scratch.save(each.groupBy("word").agg(F.sum("n").alias("df")), "item_df")
    for k in range(shards):
        of = {bytes(r[0]): r[1] for r in df.join(each.where(F.col("shard") == k), "word", "left_semi").select("word", "df").collect()}
        some = items.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in some], (every, total, longest, of)))
        yield held, False
        held.destroy()


def find(spark, docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, items, scores): a row per document row, with the items that it holds."""
    scratch = Scratch(spark)
    base = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    keyed, parts = None, []
    for k, (held, only) in enumerate(_indexes(spark, benchmark, scratch)):

        def run(batches, held=held):
            import pyarrow as pa

            for batch in batches:
                found = [sorted(held.value.hits(t.as_py()).items()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())), pa.array([[s for _, s in f] for f in found], pa.list_(pa.float64()))],
                    ["doc_id", "items", "scores"],
                )

        if only:
            return base.mapInArrow(run, SCHEMA)
        if keyed is None:  # ids may be null or repeated, so rows get a key of their own
            keyed = scratch.save(base.withColumn("row", F.monotonically_increasing_id()), "rows")
        hits = keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(run, SCHEMA).where("size(items) > 0")
        parts.append(scratch.save(hits.withColumnRenamed("doc_id", "row"), f"hits_{k}"))
    each = reduce(DataFrame.union, parts).select("row", F.explode(F.arrays_zip("items", "scores")).alias("hit"))
    merged = each.groupBy("row").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    of = lambda name, kind: F.coalesce(F.col(f"hits.{name}"), F.array().cast(kind)).alias(name)
    return keyed.select("row", "doc_id").join(merged, "row", "left").select("doc_id", of("items", "array<long>"), of("scores", "array<double>"))


def clean(spark, docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows that hold no item, with all their columns. Each row is judged by its own text, whatever its id. With
    more than one shard, what a shard leaves is written before the next one."""
    scratch, at = Scratch(spark), docs.columns.index(text_col)
    for k, (held, only) in enumerate(_indexes(spark, benchmark, scratch)):

        def run(batches, held=held):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([not held.value.hits(t.as_py()) for t in batch.column(at)], pa.bool_()))

        left = docs.mapInArrow(run, docs.schema)
        if only:
            return left
        docs = scratch.save(left, f"left_{k}")
        scratch.drop(f"left_{k - 1}")
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    hits = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
        F.array_distinct("items").alias("item_ids"), F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("best_score"),
    )
