"""Secret scans with corpus-wide ownership frequency (native).

Candidates are found by patterns; each candidate's hash is then counted over the whole corpus by distinct repositories
and distinct owners. A value that many owners carry is an example that was copied around; one that a single owner
carries, and that doesn't look like a placeholder, is live-looking.

A value is known by 64 bits of its hash. max_owners is the most owners that a live value may have.

Cases: a null text counts as empty; a null owner counts as an owner of its own; repeated rows of a document count once
as a repository; each row gets the result of its own text, also where ids are null or repeated; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key from its header to its END line; where that is missing, header lines and the lines of base64 after it.
PEM = (
    r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:[\r\n]+[A-Za-z-]+: [^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:[\r\n]+[A-Za-z0-9+/=]+(?=[\r\n]|\z))?))"
)
#: kind, pattern, group that holds the value, least length of the value. The first three are the base.
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]+)", 1, 32),
    ("pem", PEM, 1, 0),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 0),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 0),
    ("jwt", r"((?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 1, 0),
)
BASE = 3
#: A text that matches nothing here has no candidate of any kind: one scan for nearly all documents.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|PRIVATE KEY-----|gh[pousr]_|xox[abprs]-|eyJ"
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]|^(.)\1+$|^x{4,}|^0+$|^1234"
#: A header without base64 after it is a mention of a key, not one.
NO_KEY = r"^-----BEGIN (?![\s\S]*[A-Za-z0-9+/=]{16})"
_SPANS = "array<struct<start:int,kind_no:int,end:int,value:string>>"


def _of_kind(text: Column, k: int) -> Column:
    """Spans of one kind. Pieces between matches and matches alternate, so their lengths give the positions."""
    _, pattern, group, least = KINDS[k]
    # runs of one class are maximal: short ones can be left out of the search without moving any other match
    searched = {"access": r"(AKIA[A-Z0-9]{12,})", "hex": r"([0-9a-f]{32,})"}.get(KINDS[k][0], pattern)

    def placed(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPANS).alias("out"))

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["p"])
            end = start + F.length(p["m"])
            one = F.struct(start.alias("start"), F.lit(k).alias("kind_no"), end.alias("end"), p["v"].alias("value"))
            return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(_SPANS)), F.array(one)).alias("out"))

        return F.coalesce(F.aggregate(x, zero, step)["out"], F.array().cast(_SPANS))

    matches = F.regexp_extract_all(text, F.lit(searched), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(searched), F.lit(group))
    pieces = F.slice(F.split(text, searched, -1), F.lit(1), F.size(matches))
    zipped = F.arrays_zip(pieces.alias("p"), matches.alias("m"), values.alias("v"))
    spans = let(zipped, placed)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def spans_of(text: Column) -> Column:
    """All spans of a text by start, then kind: start and end in code points (end exclusive), kind number, value."""
    found = F.sort_array(F.concat(*[F.when(text.rlike(KINDS[k][1]), _of_kind(text, k)).otherwise(F.array().cast(_SPANS)) for k in range(len(KINDS))]))
    return F.when(text.rlike(ANY), found).otherwise(F.array().cast(_SPANS))


def _name(no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), no + 1)


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["kind_no"]), s["start"], s["end"])), ",")


def ownership(found: DataFrame, max_owners: int = 1) -> DataFrame:
    """found(repo, owner, spans) to (hash, n_repos, n_owners, live): distinct repositories and owners of each value.

    Distinct (hash, owner) and (hash, repo) pairs come first, with map-side combining, so a value that a third of the
    corpus carries is merged before it is shuffled, and no task holds a value's whole list."""
    each = found.select("repo", F.coalesce("owner", F.lit("\u0000")).alias("owner"), F.explode("spans").alias("s")).select(
        F.xxhash64("s.value").alias("hash"), "repo", "owner", (F.col("s.value").rlike(PLACEHOLDER) | F.col("s.value").rlike(NO_KEY)).alias("dummy")
    )
    pairs = each.groupBy("hash", "repo").agg(F.max("dummy").alias("dummy"))
    repos = pairs.groupBy("hash").agg(F.count("*").alias("n_repos"), F.max("dummy").alias("dummy"))
    owners = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash").select("hash", "n_repos", "n_owners", ((F.col("n_owners") <= max_owners) & ~F.col("dummy")).alias("live"))


def scan(docs: DataFrame, scratch: Scratch, id_col="doc_id", text_col="text", owner_col="source") -> tuple[DataFrame, DataFrame]:
    """(spans of every row as row, doc_id, repo, owner, spans; values by row, see judged). row is a written unique key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), text.alias("t"))
    found = scratch.save(d.select("row", "doc_id", F.col("doc_id").alias("repo"), "owner", spans_of(F.col("t")).alias("spans")), "spans")
    return found, judged(found)


def judged(found: DataFrame) -> DataFrame:
    """Values of each row that carries any: row, doc_id, live and example as arrays of distinct values."""
    held = found.where(F.size("spans") > 0)
    each = held.select("row", "doc_id", F.explode("spans").alias("s")).select("row", "doc_id", F.col("s.value").alias("value")).distinct()
    stats = ownership(held)
    named = each.withColumn("hash", F.xxhash64("value")).join(stats, "hash")
    return named.groupBy("row", "doc_id").agg(
        F.collect_list(F.when(F.col("live"), F.col("value"))).alias("live"),
        F.collect_list(F.when(~F.col("live"), F.col("value"))).alias("example"),
    )


def redact(docs: DataFrame, scratch: Scratch, mark: str = "<secret>") -> DataFrame:
    """docs with each live value replaced in text; n_chars follows. Longer values go first, so none is cut by another.

    Only rows that may hold a candidate are written, with a key of their own, and joined by it; all others, with or
    without an id, pass as they are."""
    names, some = docs.columns, F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    row, mine = fresh("__row", names), fresh("__live", names)
    keyed = scratch.save(docs.where(some).withColumn(row, F.monotonically_increasing_id()), "candidates")
    of = keyed.select(F.col(row).alias("row"), "doc_id", F.col("doc_id").alias("repo"), F.col("source").cast("string").alias("owner"), spans_of(F.col("text")).alias("spans"))
    live = judged(scratch.save(of, "spans"))
    values = F.array_sort(F.col(mine), lambda a, b: F.length(b) - F.length(a))
    held = keyed.join(live.select(F.col("row").alias(row), F.col("live").alias(mine)).where(F.size(mine) > 0), row, "left")
    text = F.when(F.col(mine).isNull(), F.col("text")).otherwise(F.aggregate(values, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark))))
    out = held.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(mine).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.where(~some).unionByName(out.select(*[F.col(f"`{c}`") for c in names]))


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    found, live = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    rows = found.select(
        "row", "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"), F.col("spans").alias("all"),
    )
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"n_{c}")
    of = lambda c: F.coalesce(render(F.filter("all", lambda s: F.array_contains(c, s["value"]))), F.lit("")).alias(f"{c}_spans")
    out = rows.join(live.drop("doc_id"), "row", "left")
    return out.select(*rows.columns[1:-1], n("live"), n("example"), of("live"), of("example"))
