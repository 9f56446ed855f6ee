"""Diffs of named objects: names, charts, macro modules, query scripts, model tables, columns, measures, relationships.

All are matched by one aggregation of both sides by key, so a key that is there many times is merged before it moves.
Inputs have pair_id and side (old or new); extra columns are ignored, rows without a side or a key aren't objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DiffConfig
from ..functions import dax, mquery
from ..functions.batch import batched
from ..schema import ops


def sides(df: DataFrame, keys: dict[str, Column], values: list[str], first: bool = False, at: str | None = None) -> DataFrame:
    """pair_id, keys, and the old and new values as structs. Of duplicates the last one by at counts, or the first."""
    it = F.struct(*[F.col(v) for v in values])
    order = F.col(at) if at else F.lit(0)
    ranked = F.struct((-order if first else order).alias("at"), it.alias("it"))
    of = lambda s: F.max(F.when(F.col("side") == s, ranked))["it"].alias(s)
    named = df.select("*", *[c.alias(f"__{k}") for k, c in keys.items()])
    kept = named.where(F.col("side").isin("old", "new") & F.greatest(*[F.col(f"__{k}").isNotNull().cast("int") for k in keys], F.lit(0)).cast("boolean"))
    return kept.groupBy("pair_id", *[F.col(f"__{k}").alias(k) for k in keys]).agg(of("old"), of("new"))


def kind_of(prefix: str, changed: Column) -> Column:
    return F.when(F.col("old").isNull(), f"{prefix}Added").when(F.col("new").isNull(), f"{prefix}Removed").when(changed, f"{prefix}Changed")


def either(field: str) -> Column:
    return F.coalesce(F.col(f"new.{field}"), F.col(f"old.{field}"))


def named_diff(old: DataFrame, new: DataFrame, key: Column, value: str, prefix: str) -> DataFrame:
    """(name, kind) of two plain tables, kind being prefix + Added, Removed or Changed."""
    side = lambda d, s: d.select(F.lit("").alias("pair_id"), F.lit(s).alias("side"), key.alias("name"), F.col(value).alias("value"))
    both = sides(side(old, "old").unionByName(side(new, "new")), {"name": F.col("name")}, ["value"])
    return both.select("name", kind_of(prefix, ~F.col("old.value").eqNullSafe(F.col("new.value"))).alias("kind")).where("kind is not null")


def named_ranges(names: DataFrame) -> DataFrame:
    """names(pair_id, side, name, refers_to, position): by name in lower case; the last duplicate counts."""
    both = sides(names, {"key": F.lower("name")}, ["name", "refers_to"], at="position")
    found = both.withColumn("kind", kind_of("NamedRange", ~F.col("old.refers_to").eqNullSafe(F.col("new.refers_to")))).where("kind is not null")
    return ops(found, phase=F.lit(1), sheet_ord=F.lit(0), grp=F.lit(0), name=either("name"), old=F.col("old.refers_to"), new=F.col("new.refers_to"))


def charts(charts_: DataFrame) -> DataFrame:
    """charts(pair_id, side, sheet, sheet_id, name, hash, position): by sheet id and name where the id means one sheet on
    both sides, else by the names of sheet and chart."""
    c = charts_.withColumn("lower", F.lower("sheet"))
    w = Window.partitionBy("pair_id", "side", "sheet_id")
    c = c.withColumn("clear", F.col("sheet_id").isNotNull() & (F.min("lower").over(w) == F.max("lower").over(w)))
    c = c.withColumn("clear", F.bool_and("clear").over(Window.partitionBy("pair_id", "sheet_id")))
    values = ["sheet", "name", "hash", "position"]
    by_id = sides(c.where("clear"), {"at": F.col("sheet_id").cast("string"), "key": F.lower("name")}, values, at="position")
    by_name = sides(c.where("not clear"), {"at": F.col("lower"), "key": F.lower("name")}, values, at="position")
    both = by_id.unionByName(by_name)
    found = both.withColumn("kind", kind_of("Chart", ~F.col("old.hash").eqNullSafe(F.col("new.hash")))).where("kind is not null")
    return ops(found, phase=F.lit(2), sheet_ord=F.lit(0), grp=F.lit(0), sheet=either("sheet"), name=either("name"), old=F.col("old.hash"), new=F.col("new.hash"))


def modules(modules_: DataFrame) -> DataFrame:
    """modules(pair_id, side, name, code, position): by name in lower case; line ends don't matter."""
    same_ends = lambda c: F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    both = sides(modules_.withColumn("code", same_ends(F.col("code"))), {"key": F.lower("name")}, ["name", "code"], at="position")
    found = both.withColumn("kind", kind_of("VbaModule", ~F.col("old.code").eqNullSafe(F.col("new.code")))).where("kind is not null")
    return ops(found, phase=F.lit(3), sheet_ord=F.lit(0), grp=F.lit(0), name=either("name"))


# ---- query scripts


def with_metadata(members: DataFrame, metadata: DataFrame) -> DataFrame:
    """Members of sections with their load settings, defaults where there are none; the last duplicate of a name counts.

    members(pair_id, side, section, member, expression, position), metadata(pair_id, side, section, member, load_to_sheet,
    load_to_model, group_path)."""
    on = ["pair_id", "side", "section", "member"]
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    one = metadata.groupBy(*on).agg(*[F.max(c).alias(c) for c in ("load_to_sheet", "load_to_model", "group_path")])
    both = members.select(*on, "expression", "position").join(one, on, "left")
    both = both.select(*on, "expression", "position", F.concat_ws("/", "section", "member").alias("name"), false("load_to_sheet"), false("load_to_model"), "group_path")
    both = both.withColumn("connection_only", ~(F.col("load_to_sheet") | F.col("load_to_model")))
    last = Window.partitionBy("pair_id", "side", "name").orderBy(F.col("position").desc())
    return both.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


_SETTINGS = (("LoadToSheet", "load_to_sheet"), ("LoadToModel", "load_to_model"), ("ConnectionOnly", "connection_only"), ("GroupPath", "group_path"))


def rename_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of left-only and right-only queries that are alike enough.

    Likeness is the mean of two parts, equal canonical scripts (1 or 0) and the likeness of step kinds, or the first part
    alone. Above one half it needs equal scripts, so pairs meet by the script's hash, not all with all; up to one half,
    equal steps alone can do, so pairs with the same counts of steps meet as well."""
    sig = batched(lambda t: mquery.semantic_hash(t) or mquery.digest(t), "string")
    counts = batched(lambda t: (lambda c: None if c is None else ",".join(f"{k}={n}" for k, n in sorted(c.items())))(mquery.step_counts(t)), "string")
    likeness = batched(lambda a, b: mquery.similarity(a or "", b or ""), "double")
    side = lambda d, s: d.select("pair_id", F.col("name").alias(f"name_{s}"), F.col("expression").alias(f"text_{s}"), sig("expression").alias("sig"), counts("expression").alias(f"counts_{s}"))
    a, b = side(left, "old"), side(right, "new")
    both = a.join(b, ["pair_id", "sig"]).drop("sig")
    if threshold <= 0.5:
        more = a.drop("sig").withColumn("c", F.col("counts_old")).join(b.drop("sig").withColumn("c", F.col("counts_new")), ["pair_id", "c"]).drop("c")
        both = both.unionByName(more).distinct()
    return both.withColumn("likeness", likeness("text_old", "text_new")).where(F.col("likeness") >= threshold).select("pair_id", "name_old", "name_new", "likeness")


def _choose(df):
    """Renames of one pair of packages: the assignment of least cost, earlier names first where costs are equal."""
    import numpy as np
    import pandas as pd

    from .align import assign

    old, new = sorted(df["name_old"].unique()), sorted(df["name_new"].unique())
    size = max(len(old), len(new))
    scale = size * size + 1
    cost = np.full((len(old), len(new)), 10_000.0 * scale)
    for a, b, s in zip(df["name_old"], df["name_new"], df["likeness"]):
        i, j = old.index(a), new.index(b)
        cost[i, j] = round((1 - s) * 1000) * scale + i * size + j
    found = [(old[i], new[j]) for i, j in enumerate(assign(cost)) if j >= 0 and cost[i, j] < 10_000 * scale]
    return pd.DataFrame({"pair_id": [df["pair_id"].iloc[0]] * len(found), "name_old": [f[0] for f in found], "name_new": [f[1] for f in found]})


def queries(q: DataFrame, cfg: DiffConfig | None = None) -> DataFrame:
    """q(pair_id, side, name, expression, load_to_sheet, load_to_model, connection_only, group_path): by name, which is
    case-sensitive, after renames among those that only one side has."""
    cfg = cfg or DiffConfig()
    settings = [c for _, c in _SETTINGS]
    both = sides(q, {"name": F.col("name")}, ["name", "expression", *settings])
    alone = lambda s, o: both.where(f"{s} is not null and {o} is null").select("pair_id", "name", F.col(f"{s}.expression").alias("expression"))
    pairs = rename_candidates(alone("old", "new"), alone("new", "old"), cfg.fuzzy_similarity_threshold)
    renamed = pairs.groupBy("pair_id").applyInPandas(_choose, "pair_id string, name_old string, name_new string")
    old = both.where("old is not null").select("pair_id", F.col("name").alias("name_old"), "old")
    new = both.where("new is not null").select("pair_id", F.col("name").alias("name_new"), "new")
    moved = renamed.join(old, ["pair_id", "name_old"]).join(new, ["pair_id", "name_new"])
    gone = renamed.select("pair_id", F.explode(F.array("name_old", "name_new")).alias("name"))
    rest = both.join(gone, ["pair_id", "name"], "left_anti")
    all_ = rest.select("pair_id", "name", "old", "new", F.lit(None).cast("string").alias("was")).unionByName(
        moved.select("pair_id", F.col("name_new").alias("name"), "old", "new", F.col("name_old").alias("was"))
    )
    all_ = all_.withColumn("grp", F.when(F.col("was").isNotNull(), 0).otherwise(1)).withColumn("at", F.coalesce("was", "name"))
    all_ = all_.withColumn("s1", F.dense_rank().over(Window.partitionBy("pair_id", "grp").orderBy("at")))
    base = {"phase": F.lit(4), "sheet_ord": F.lit(0)}
    whole = all_.withColumn("kind", F.when(F.col("was").isNotNull(), "QueryRenamed").when(F.col("old").isNull(), "QueryAdded").when(F.col("new").isNull(), "QueryRemoved")).where("kind is not null")
    renames = F.col("kind") == "QueryRenamed"
    out = ops(whole, **base, s2=F.lit(0), name=F.coalesce("was", "name"), name_to=F.when(renames, F.col("name")))
    change = mquery.change_column(cfg.enable_m_semantic_diff, cfg.semantic_noise_policy == "SuppressFormattingOnly")
    differing = all_.where("old is not null and new is not null and not (old.expression <=> new.expression)")
    texts = differing.select(F.coalesce("old.expression", F.lit("")).alias("a"), F.coalesce("new.expression", F.lit("")).alias("b")).distinct()
    judged = texts.withColumn("c", change("a", "b")).where("c.kind is not null")
    defined = differing.withColumn("a", F.coalesce("old.expression", F.lit(""))).withColumn("b", F.coalesce("new.expression", F.lit(""))).join(judged, ["a", "b"])
    out = out.unionByName(
        ops(defined.drop("old", "new"), **base, s2=F.lit(1), kind=F.lit("QueryDefinitionChanged"), change_kind=F.col("c.kind"), old=F.col("c.old"), new=F.col("c.new"), detail=F.col("c.detail"))
    )
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("field"), F.col(f"old.{c}").cast("string").alias("a"), F.col(f"new.{c}").cast("string").alias("b")) for k, (f, c) in enumerate(_SETTINGS)])
    set_ = all_.where("old is not null and new is not null").withColumn("m", F.explode(each)).where("not (m.a <=> m.b)")
    return out.unionByName(ops(set_.drop("old", "new"), **base, s2=F.col("m.k") + 2, kind=F.lit("QueryMetadataChanged"), field=F.col("m.field"), old=F.col("m.a"), new=F.col("m.b")))


# ---- tabular models


def expression_change(df: DataFrame, cfg: DiffConfig) -> DataFrame:
    """df(old_text, new_text) whose texts differ, with change_kind and hashes: Unknown unless measures are compared by
    meaning and both texts can be read; formatting alone may be suppressed."""
    h = batched(dax.semantic_hash, "string") if cfg.enable_dax_semantic_diff else (lambda c: F.lit(None).cast("string"))
    texts = df.where("not (old_text <=> new_text)")
    out = texts.withColumn("a", h("old_text")).withColumn("b", h("new_text"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    kind = F.when(~known, "Unknown").when(F.col("a") == F.col("b"), "FormattingOnly").otherwise("Semantic")
    plain = lambda c: F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 16)
    out = out.withColumn("change_kind", kind).withColumn("old", F.when(known, F.col("a")).otherwise(plain("old_text"))).withColumn("new", F.when(known, F.col("b")).otherwise(plain("new_text")))
    return out.where("change_kind <> 'FormattingOnly'") if cfg.semantic_noise_policy == "SuppressFormattingOnly" else out


_PROPERTIES = (("Hidden", "is_hidden"), ("FormatString", "format_string"), ("SortBy", "sort_by"), ("SummarizeBy", "summarize_by"))
_RELATION = (("CrossFilteringBehavior", "cross_filtering_behavior"), ("Cardinality", "cardinality"), ("IsActive", "is_active"))


def _properties(both: DataFrame, fields: tuple, first: int) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k + first).alias("k"), F.lit(f).alias("field"), F.col(f"old.{c}").cast("string").alias("a"), F.col(f"new.{c}").cast("string").alias("b")) for k, (f, c) in enumerate(fields)])
    return both.where("old is not null and new is not null").withColumn("p", F.explode(each)).where("not (p.a <=> p.b)")


def model(tables: DataFrame, columns: DataFrame, measures: DataFrame, relationships: DataFrame, cfg: DiffConfig | None = None) -> DataFrame:
    """Diff of tabular models: names in lower case, the first duplicate counts. Columns of tables that only one side has
    aren't told one by one."""
    cfg = cfg or DiffConfig()
    base = {"phase": F.lit(5), "sheet_ord": F.lit(0)}
    rank = lambda df, *by: df.withColumn("s1", F.dense_rank().over(Window.partitionBy("pair_id").orderBy(*by)))
    t = sides(tables, {"key": F.lower("name")}, ["name"], first=True, at="position")
    added = t.withColumn("kind", F.when(F.col("old").isNull(), "TableAdded").when(F.col("new").isNull(), "TableRemoved")).where("kind is not null")
    out = ops(rank(added, "key"), **base, grp=F.lit(0), s2=F.lit(0), name=either("name"))
    shared = t.where("old is not null and new is not null").select("pair_id", F.col("key").alias("tkey"), F.col("new.name").alias("tbl"))
    values = ["name", "data_type", *[c for _, c in _PROPERTIES], "expression"]
    c = sides(columns, {"tkey": F.lower("table"), "key": F.lower("name")}, values, first=True, at="position").join(shared, ["pair_id", "tkey"])
    c = rank(c, "tkey", "key").withColumn("grp", F.lit(1))
    whole = c.withColumn("kind", F.when(F.col("old").isNull(), "ModelColumnAdded").when(F.col("new").isNull(), "ModelColumnRemoved")).where("kind is not null")
    out = out.unionByName(ops(whole, **base, s2=F.lit(0), name=either("name"), old=F.lit(None), new=F.col("new.data_type")))
    typed = c.where("old is not null and new is not null and not (old.data_type <=> new.data_type)")
    out = out.unionByName(ops(typed, **base, s2=F.lit(1), kind=F.lit("ModelColumnTypeChanged"), name=F.col("new.name"), old=F.col("old.data_type"), new=F.col("new.data_type")))
    p = _properties(c, _PROPERTIES, 2)
    out = out.unionByName(ops(p, **base, s2=F.col("p.k"), kind=F.lit("ModelColumnPropertyChanged"), name=F.col("new.name"), field=F.col("p.field"), old=F.col("p.a"), new=F.col("p.b")))
    e = c.where("old is not null and new is not null").select("pair_id", "tbl", "s1", "grp", F.col("new.name").alias("name"), F.col("old.expression").alias("old_text"), F.col("new.expression").alias("new_text"))
    out = out.unionByName(ops(expression_change(e, cfg), **base, s2=F.lit(9), kind=F.lit("CalculatedColumnDefinitionChanged")))
    ends = ["from_table", "from_column", "to_table", "to_column"]
    r = sides(relationships, {f"k{k}": F.lower(x) for k, x in enumerate(ends)}, [*ends, *[x for _, x in _RELATION]], first=True, at="position")
    r = rank(r, "k0", "k1", "k2", "k3").withColumn("grp", F.lit(2))
    name = F.format_string("%s[%s] -> %s[%s]", *[F.coalesce(f"new.{x}", f"old.{x}") for x in ends])
    whole = r.withColumn("kind", F.when(F.col("old").isNull(), "RelationshipAdded").when(F.col("new").isNull(), "RelationshipRemoved")).where("kind is not null")
    out = out.unionByName(ops(whole, **base, s2=F.lit(0), name=name, old=F.lit(None), new=F.lit(None)))
    p = _properties(r, _RELATION, 1)
    out = out.unionByName(ops(p, **base, s2=F.col("p.k"), kind=F.lit("RelationshipPropertyChanged"), name=name, field=F.col("p.field"), old=F.col("p.a"), new=F.col("p.b")))
    m = rank(sides(measures, {"key": F.lower("name")}, ["name", "expression"], first=True, at="position"), "key").withColumn("grp", F.lit(3))
    whole = m.withColumn("kind", F.when(F.col("old").isNull(), "MeasureAdded").when(F.col("new").isNull(), "MeasureRemoved")).where("kind is not null")
    out = out.unionByName(ops(whole, **base, s2=F.lit(0), name=either("name"), old=F.lit(None), new=F.lit(None)))
    e = m.where("old is not null and new is not null").select("pair_id", "s1", "grp", F.col("new.name").alias("name"), F.col("old.expression").alias("old_text"), F.col("new.expression").alias("new_text"))
    return out.unionByName(ops(expression_change(e, cfg), **base, s2=F.lit(1), kind=F.lit("MeasureDefinitionChanged")))


# ---- files


def pairing(files: DataFrame, key: str, side: str) -> DataFrame:
    """How files on two sides pair up by key: pending, missing_old, missing_new or duplicate."""
    n = files.groupBy(key).agg(F.count(F.when(F.col(side) == 0, 1)).alias("n_old"), F.count(F.when(F.col(side) == 1, 1)).alias("n_new"))
    status = (
        F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), "duplicate").when(F.col("n_old") == 0, "missing_old").when(F.col("n_new") == 0, "missing_new").otherwise("pending")
    )
    return n.select(key, "n_old", "n_new", status.alias("status"))
