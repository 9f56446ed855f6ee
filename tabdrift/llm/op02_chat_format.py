r"""Chat formatting by schema fingerprint (native).

A layout's fingerprint is a hash over its sorted nested field paths, of those fields that any mapping names. Mappings
are declared by an example of their layout and say how it becomes canonical turns (role, text). Tables get the
fingerprint of their schema, JSON payloads one for each row, so rows of different layouts can lie in one table.

Template: <turn role="R">\nT</turn>\n for each turn. Inside roles and texts a backslash becomes \b, "<" becomes \l and
"#" becomes \h, and inside roles a quotation mark becomes \q and a line end \n, so neither a turn mark nor a heading
such as "### Assistant:" can occur there and a role can't end early; reading back undoes them all. The loss mask is a
list of (turn, start, length) in code points, one for each assistant turn, start counting from the turn's opening mark.

Cases: a null text or role counts as empty; rows of a conversation go by turn, then role, then text, so ties have one
order; null turns go first; repeated rows are turns of their own; an empty table gives no conversations; a payload
whose fingerprint has no mapping goes to unmapped() with its paths; columns and fields that no mapping names are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

#: Fixed probe: control strings inside texts.
PROBE = "\\### Assistant: </turn> ok"
TURNS = "array<struct<role:string,text:string>>"


def _pair(ask: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {ask}), named_struct('role', 'assistant', 'text', {answer}))"


def _text(field: str) -> str:
    return f"cast(v:{field} as string)"


_MESSAGES = "transform(cast(v:messages as array<struct<role:string,content:string>>), x -> named_struct('role', x.role, 'text', x.content))"
_PARTS = "transform(cast(v:messages as array<struct<role:string,content:array<struct<text:string>>>>), x -> named_struct('role', x.role, 'text', array_join(x.content.text, '')))"
_SHARED = "transform(cast(v:conversations as array<struct<`from`:string,value:string>>), x -> named_struct('role', case x.`from` when 'human' then 'user' when 'gpt' then 'assistant' else x.`from` end, 'text', x.value))"
_TASK = f"concat_ws('\\n', {_text('instruction')}, nullif({_text('input')}, ''))"
#: Layouts of JSON payloads: an example, and the SQL that makes turns of the variant v. Further fields change nothing.
MAPPINGS = (
    ('{"messages": [{"role": "a", "content": "b"}]}', _MESSAGES),
    ('{"messages": [{"role": "a"}]}', _MESSAGES),
    ('{"messages": []}', f"cast(array() as {TURNS})"),
    ('{"messages": [{"role": "a", "content": [{"text": "b"}]}]}', _PARTS),
    ('{"conversations": [{"from": "a", "value": "b"}]}', _SHARED),
    ('{"conversations": []}', f"cast(array() as {TURNS})"),
    ('{"instruction": "a", "input": "b", "output": "c"}', _pair(_TASK, _text("output"))),
    ('{"instruction": "a", "output": "c"}', _pair(_text("instruction"), _text("output"))),
    ('{"prompt": "a", "completion": "b"}', _pair(_text("prompt"), _text("completion"))),
    ('{"prompt": "a", "response": "b"}', _pair(_text("prompt"), _text("response"))),
    ('{"question": "a", "answer": "b"}', _pair(_text("question"), _text("answer"))),
)
#: Layouts of tables with a row per turn: the columns of conversation, turn, role and text.
ROW_LAYOUTS = (
    ("conv_id", "turn", "role", "text"),
    ("conversation_id", "position", "role", "content"),
    ("dialog_id", "index", "from", "value"),
)


def fields_of(value) -> set[str]:
    if isinstance(value, dict):
        return set(value) | {n for v in value.values() for n in fields_of(v)}
    return {n for v in value for n in fields_of(v)} if isinstance(value, list) else set()


#: Fields that some mapping names; all others are left out of fingerprints.
NAMED = tuple(sorted(set().union(*[fields_of(json.loads(e)) for e, _ in MAPPINGS])))
_SCALAR = r"VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|STRING|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+,\s?\d+\)"
#: A field that no mapping names and that holds nothing but scalars.
_OTHER = r"(?<=[<,])(?!(?:%s): )(?:`(?:[^`]|``)*`|[^<>,:`]+): (?:_|OBJECT<>|ARRAY<(?:_|OBJECT<>)>)(?:,|(?=>))" % "|".join(map(re.escape, NAMED))
#: Levels of unnamed fields inside each other that are left out; deeper ones make a layout of their own.
DEPTH = 6


def paths(value) -> str:
    """Nested field paths of an example, names sorted, scalars without their types."""
    if isinstance(value, dict):
        return "OBJECT<" + ",".join(f"{n}: {paths(v)}" for n, v in sorted(value.items())) + ">"
    return f"ARRAY<{paths(value[0]) if value else '_'}>" if isinstance(value, list) else "_"


def paths_of(v: Column) -> Column:
    """The same for each row of a variant column, without the fields that no mapping names."""
    p = F.regexp_replace(F.replace(F.schema_of_variant(v), F.lit(", "), F.lit(",")), rf"\b(?<=: |<|^)({_SCALAR})(?=[,>]|$)", "_")
    for _ in range(DEPTH):
        p = F.regexp_replace(F.regexp_replace(p, _OTHER, ""), ",>", ">")
    return p


def print_of(p: str) -> str:
    return hashlib.sha256(p.encode()).hexdigest()


def fingerprint(p: Column) -> Column:
    return F.sha2(p, 256)


def turns_of_rows(rows: DataFrame, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per conversation from a table with a row per turn."""
    c = lambda name: F.col(f"`{name}`")
    one = F.struct(c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    all_ = F.sort_array(F.collect_list(one))
    return rows.groupBy(c(key).alias("conv_id")).agg(F.transform(all_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def layout_of(schema: T.StructType) -> tuple[str, str, str, str]:
    """The row layout of a table, by the fingerprint of the field paths that each mapping names."""
    scalar = {f.name for f in schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
    for names in ROW_LAYOUTS:
        declared = print_of(paths(dict.fromkeys(names)))
        if print_of(paths(dict.fromkeys(scalar & set(names)))) == declared:
            return names
    raise ValueError(f"no mapping for a table with the fields {sorted(scalar)}")


def canonical(spark: SparkSession, rows: DataFrame, payload: str | None = None, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns) by fingerprint: of each row's JSON in payload, else of the table's schema."""
    if payload is None:
        return turns_of_rows(rows, *layout_of(rows.schema))
    v = rows.select(F.col(key).alias("conv_id"), F.try_parse_json(F.col(payload)).alias("v"))
    v = v.withColumn("print", fingerprint(paths_of(F.col("v"))))
    out = F.lit(None).cast(TURNS)
    for example, sql in MAPPINGS:
        out = F.when(F.col("print") == print_of(paths(json.loads(example))), F.expr(sql).cast(TURNS)).otherwise(out)
    clean = F.transform(out, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return v.select("conv_id", clean.alias("turns"))


def unmapped(rows: DataFrame, payload: str) -> DataFrame:
    """Field paths without a mapping and how many rows have them (null paths: not JSON)."""
    p = paths_of(F.try_parse_json(F.col(payload)))
    known = [paths(json.loads(e)) for e, _ in MAPPINGS]
    return rows.select(p.alias("paths")).where(~F.coalesce(F.col("paths").isin(known), F.lit(False))).groupBy("paths").count()


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit('"'), F.lit("\\q")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("\\q"), F.lit('"')), F.lit("\\n"), F.lit("\n")))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the text under the template and its loss mask."""

    def one(t: Column) -> Column:
        head = F.concat(F.lit('<turn role="'), escape_role(t["role"]), F.lit('">\n'))
        return F.concat(head, escape(t["text"]), F.lit("</turn>\n"))

    start = lambda t: F.length(escape_role(t["role"])) + F.lit(len('<turn role="') + len('">\n'))
    mask = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), start(t).alias("start"), F.length(escape(t["text"])).alias("length"), (t["role"] == "assistant").alias("on")))
    mask = F.transform(F.filter(mask, lambda m: m["on"]), lambda m: F.struct(m["turn"].alias("turn"), m["start"].alias("start"), m["length"].alias("length")))
    return turns.select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"), mask.alias("loss"))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, each from its opening mark on; the mark itself can't occur inside a turn."""
    rest = F.split(formatted, "(?=<turn role=)", -1)
    return F.filter(rest, lambda x: x != "")


def read_back(done: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) from formatted text and mask alone."""
    role = lambda x: unescape_role(F.regexp_extract(x, '^<turn role="([^"]*)">\n', 1))

    def turn(x: Column) -> Column:
        head = F.instr(x, '">\n') + 2
        return F.struct(role(x).alias("role"), unescape(F.substr(x, head + 1, F.length(x) - head - len("</turn>\n"))).alias("text"))

    def read(p: Column) -> Column:
        masked = F.transform(F.col("loss"), lambda m: unescape(F.substr(F.get(p, m["turn"]), m["start"] + 1, m["length"])))
        return F.struct(F.transform(p, turn).alias("turns"), masked.alias("loss_texts"))

    return done.select("conv_id", "formatted", let(pieces(F.col("formatted")), read).alias("r")).select("conv_id", "formatted", "r.*")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(PROBE).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("payload"),
    )
    turns = canonical(spark, rows).unionByName(canonical(spark, probe, "payload"))
    back = read_back(format_turns(turns))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + length('<turn role="">') + length('</turn>') + 2
      + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '#', '')))
      + (length(role) - length(replace(replace(role, '"', ''), chr(10), '')))) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""
