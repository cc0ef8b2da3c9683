"""Tool-call linking for chat data.

``calls(conv_id, call_id, seq, name, arguments, needs)`` and ``results(conv_id,
call_id, seq, content)`` are linked by identifier, ordered, checked and
serialised:

1. results are hash-joined to calls on (conversation, identifier); of several
   results of one call the first by ``seq`` counts, then the least content;
   repeated calls of one identifier are told apart the same way, and the first
   one counts; the others come back as rows of their own, with status
   ``repeated_call`` or ``repeated_result``;
2. calls are ordered topologically: the level of a call is one more than the
   highest level among the calls it needs. Chains of calls with one need each
   are resolved by pointer doubling, so rounds grow with the logarithm of a
   chain; only calls that need several others add rounds of their own. Calls in
   or behind a cycle get no level;
3. arguments are validated against the schema of the tool: required names,
   types and least and greatest values or lengths;
4. the linked call is serialised as canonical JSON: names in order, no blanks,
   nulls left out.

A conversation is never gathered: one row per call comes back, with its level;
``(conv_id, level, seq, call_id)`` is the order of the conversation. All joins
are on (conversation, identifier), so a long conversation spreads over tasks.
Only DataFrame functions are used.

Defined results: calls without identifier or conversation are dropped into
status ``no_id`` and link with nothing; a need that names no call is ignored
for the level and reported in ``missing_needs``; results without a call come
back as rows of status ``no_call``; empty tables give empty results; other
columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare


@dataclass(frozen=True)
class Field:
    name: str
    kind: str                  # string, long, double or boolean
    required: bool = True
    least: int | None = None   # of a number, or of the length of a string
    most: int | None = None


BARE = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false)$"
Schemas = dict[str, tuple[Field, ...]]


def _problems(arguments: Column, tool: Column, schemas: Schemas) -> Column:
    """Sorted list of what is wrong with a map of argument strings."""
    out: Column = F.array(F.lit("unknown tool"))
    for name, fields in sorted(schemas.items()):
        found = []
        for f in fields:
            v = F.element_at(arguments, F.lit(f.name))
            if f.kind == "string":
                typed, measure = F.lit(True), F.char_length(v)
            elif f.kind == "boolean":
                typed, measure = v.isin("true", "false"), F.lit(None).cast("long")
            else:
                expr = r"^-?(0|[1-9][0-9]{0,17})$" if f.kind == "long" else r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
                typed = v.rlike(expr)
                measure = F.when(typed, v).cast(f.kind)
            wrong = F.when(v.isNull(), F.lit(f"{f.name}: missing") if f.required else F.lit(None)).when(
                ~typed, F.lit(f"{f.name}: not a {f.kind}"))
            if f.least is not None:
                wrong = wrong.when(measure < f.least, F.lit(f"{f.name}: below {f.least}"))
            if f.most is not None:
                wrong = wrong.when(measure > f.most, F.lit(f"{f.name}: above {f.most}"))
            found.append(wrong)
        names = F.array(*[F.lit(f.name) for f in fields]) if fields else F.array().cast("array<string>")
        more = F.transform(F.array_except(F.map_keys(arguments), names), lambda k: F.concat(k, F.lit(": not in the schema")))
        listed = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        out = F.when(tool == name, F.array_sort(F.concat(listed, more))).otherwise(out)
    return F.when(arguments.isNull(), F.array(F.lit("no arguments"))).otherwise(out)


def _typed_json(arguments: Column, tool: Column, schemas: Schemas) -> Column:
    """Arguments as a JSON object, names in order; numbers and booleans stand
    bare (values that are none stay strings)."""
    def quoted(x: Column) -> Column:
        # a one-element JSON array without its brackets is the quoted string
        text = F.to_json(F.array(x))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    bare = F.array(F.lit(""))
    for name, fields in sorted(schemas.items()):
        plain = [F.lit(f.name) for f in fields if f.kind != "string"]
        bare = F.when(tool == name, F.array(*plain) if plain else F.array(F.lit(""))).otherwise(bare)
    pair = F.transform(F.array_sort(F.map_keys(arguments)), lambda k: F.concat(
        quoted(k), F.lit(":"), F.when(F.array_contains(bare, k) & F.element_at(arguments, k).rlike(BARE), F.element_at(arguments, k))
        .otherwise(quoted(F.element_at(arguments, k)))))
    return F.concat(F.lit("{"), F.array_join(pair, ","), F.lit("}"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Topological level of ``nodes(conv_id, call_id)`` by ``edges(conv_id,
    call_id, need)``; null in or behind a cycle."""
    key = ["conv_id", "call_id"]
    e = cut(edges.distinct(), "calls-edges")
    several = e.groupBy(*key).agg(F.count("*").alias("k"), F.min("need").alias("need"))
    # state: every node stands so many steps above another; roots stand above themselves
    state = cut(nodes.select(*key).distinct().join(several, key, "left").select(
        *key, F.when(F.col("k") == 1, F.col("need")).otherwise(F.col("call_id")).alias("up"),
        F.when(F.col("k") == 1, 1).otherwise(0).cast("long").alias("steps"),
        (F.coalesce("k", F.lit(0)) > 1).alias("joins")), "calls-up")
    n = state.where("steps > 0").count()
    moved, rounds = n, 0
    while moved and 2 ** rounds <= 2 * n:
        nxt = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        state = cut(state.join(nxt, ["conv_id", "up"]).select(
            *key, F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "joins",
            (F.col("more") > 0).alias("moved")), "calls-up")
        moved = state.where("moved").limit(1).count()
        state = state.drop("moved")
        rounds += 1
    # a chain that still moves after so many doublings runs in a circle
    tops = state.where("steps = 0").select("conv_id", F.col("call_id").alias("up"), F.col("joins").alias("open"))
    state = cut(state.join(tops, ["conv_id", "up"], "left"), "calls-top")
    level = state.select("conv_id", F.col("up"), "call_id", "steps",
                         F.when(F.col("open") == F.lit(False), F.lit(0).cast("long")).alias("base"))
    joint = e.join(several.where("k > 1").select(*key), key)
    if not joint.isEmpty():
        joint = cut(joint, "calls-joint")
        solved = level.where("base IS NOT NULL").select(*key, (F.col("base") + F.col("steps")).alias("level"))
        done = -1
        while True:
            # a joining call is ready when all its needs have a level
            ready = (joint.join(solved.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"], "left")
                     .groupBy(*key).agg((F.max("level") + 1).alias("at"), F.count("*").alias("k"), F.count("level").alias("known"))
                     .where("k = known").select("conv_id", F.col("call_id").alias("up"), "at"))
            ready = cut(ready, "calls-ready")
            now = ready.count()
            if now == done:
                break
            done = now
            solved = cut(level.join(ready, ["conv_id", "up"], "left").withColumn("base", F.coalesce("base", "at"))
                         .where("base IS NOT NULL").select(*key, (F.col("base") + F.col("steps")).alias("level")), "calls-level")
        return state.select(*key).join(solved, key, "left")
    return level.select(*key, (F.col("base") + F.col("steps")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call (and per result without a call): ``conv_id, call_id,
    seq, name, level, status, problems, missing_needs, json``."""
    prepare(calls.sparkSession)
    key = ["conv_id", "call_id"]
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = (calls.where(has_id).groupBy(*key)
             .agg(F.count("*").alias("copies"),
                  F.min_by(F.struct("seq", "name", "arguments", "needs"),
                           F.struct("seq", "name", F.map_entries("arguments").alias("a"), "needs")).alias("c"))
             .select(*key, "copies", "c.*"))
    first = cut(first, "calls-first")
    answer = (results.where(has_id).groupBy(*key)
              .agg(F.count("*").alias("answers"), F.min(F.struct("seq", "content")).alias("r"))
              .select(*key, "answers", F.col("r.seq").alias("result_seq"), F.col("r.content").alias("content")))
    again = _repeated(calls.where(has_id).select(*key, "seq", "name", "arguments", "needs"), first, "call").unionByName(_repeated(
        results.where(has_id).select(*key, "seq", "content"), answer.where("answers > 1").select(
            *key, F.col("answers").alias("copies"), F.col("result_seq").alias("seq"), "content"), "result"))
    needs = first.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need")).where("need IS NOT NULL")
    there = first.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("there"))
    checked = cut(needs.join(there, ["conv_id", "need"], "left"), "calls-needs")
    missing = (checked.where("there IS NULL").groupBy(*key).agg(F.count("*").alias("missing_needs")))
    level = levels(checked.where("there").select(*key, "need"), first)
    rows = (first.join(answer, key, "left").join(level, key, "left").join(missing, key, "left"))
    problems = _problems(F.col("arguments"), F.col("name"), schemas)
    rows = rows.withColumns({"problems": problems, "missing_needs": F.coalesce("missing_needs", F.lit(0).cast("long"))})
    rows = rows.withColumn("status", F.when(F.col("level").isNull(), "cycle").when(F.size("problems") > 0, "invalid")
                           .when(F.col("answers").isNull(), "no_result").otherwise("ok"))
    text = F.substring(F.to_json(F.struct(F.col("content"))), 12, 2_147_483_647)
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(_typed_json(F.col("arguments"), F.col("name"), schemas), F.lit("{}")),
        F.lit(',"id":'), _json_text("call_id"), F.lit(',"name":'), F.coalesce(_json_text("name"), F.lit('""')),
        F.when(F.col("content").isNotNull(), F.concat(F.lit(',"result":'), text)).otherwise(F.lit("}")))
    linked = rows.select(*key, "seq", "name", "level", "status", "problems", "missing_needs", body.alias("json"))
    lost = (answer.join(first.select(*key), key, "left_anti")
            .select(*key, F.col("result_seq").alias("seq"), F.lit(None).cast("string").alias("name"),
                    F.lit(None).cast("long").alias("level"), F.lit("no_call").alias("status"),
                    F.array().cast("array<string>").alias("problems"), F.lit(0).cast("long").alias("missing_needs"),
                    F.to_json(F.struct("content", F.col("call_id").cast("string").alias("id"))).alias("json")))
    nameless = calls.where(~has_id).select(
        *key, "seq", "name", F.lit(None).cast("long").alias("level"), F.lit("no_id").alias("status"),
        F.array().cast("array<string>").alias("problems"), F.lit(0).cast("long").alias("missing_needs"),
        F.lit(None).cast("string").alias("json"))
    return linked.unionByName(lost).unionByName(nameless).unionByName(again)


def _repeated(rows: DataFrame, first: DataFrame, what: str) -> DataFrame:
    """Rows of an identifier beside its ``first``: one each, with status
    ``repeated_call`` or ``repeated_result``."""
    key = ["conv_id", "call_id"]
    comparable = [c for c in rows.columns if c not in key]

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if dict(df.dtypes)[c].startswith("map") else F.col(c)
                                          for c in comparable]).alias(name))
    met = parts(rows, "own").join(parts(first.where("copies > 1"), "kept"), key)
    same = F.col("own").eqNullSafe(F.col("kept"))
    # of rows equal to the first, all but one
    more = (met.where(same).groupBy(*key, "own").agg(F.count("*").alias("k")).where("k > 1")
            .select(*key, "own", F.explode(F.sequence(F.lit(2), F.col("k")))).drop("col"))
    name = F.col("own.name") if "name" in comparable else F.lit(None).cast("string")
    return met.where(~same).select(*key, "own").union(more).select(
        *key, F.col("own.seq").alias("seq"), name.alias("name"), F.lit(None).cast("long").alias("level"),
        F.lit(f"repeated_{what}").alias("status"), F.array().cast("array<string>").alias("problems"),
        F.lit(0).cast("long").alias("missing_needs"),
        (F.lit(None).cast("string") if what == "call" else F.to_json(F.struct(
            F.col("own.content").alias("content"), F.col("call_id").cast("string").alias("id")))).alias("json"))


def _json_text(column: str) -> Column:
    text = F.to_json(F.array(F.col(column).cast("string")))
    return F.when(F.col(column).isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


#: tools of the query; a user turn is a call, its assistant turn the result
TOOLS: Schemas = {
    "ask": (Field("chars", "long", least=1, most=100_000), Field("first", "boolean"), Field("text", "string", least=1, most=100_000)),
    "system": (Field("chars", "long", least=1), Field("text", "string", least=1)),
}


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand in a table of chat turns: every turn that is
    not the assistant's is a call with its turn as identifier, answered by the
    assistant's next turn; it needs the call two turns before and, if there is
    one, the system turn 0."""
    t = conversations.select("conv_id", "turn", "role", "text")
    calls = t.where("role IS NULL OR role <> 'assistant'").select(
        "conv_id", F.col("turn").alias("call_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "ask").otherwise(F.col("role")).alias("name"),
        F.when(F.col("role") == "system", F.map_from_arrays(
            F.array(F.lit("chars"), F.lit("text")),
            F.array(F.char_length(F.coalesce("text", F.lit(""))).cast("string"), F.coalesce("text", F.lit("")))))
        .otherwise(F.map_from_arrays(
            F.array(F.lit("chars"), F.lit("first"), F.lit("text")),
            F.array(F.char_length(F.coalesce("text", F.lit(""))).cast("string"),
                    F.when(F.col("turn") < 2, "true").otherwise("false"), F.coalesce("text", F.lit(""))))).alias("arguments"),
        F.when(F.col("turn") == 0, F.array().cast("array<long>")).otherwise(
            F.array_distinct(F.array(F.col("turn") - F.least(F.col("turn"), F.lit(2))))).alias("needs"))
    results = t.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    linked = link_calls(calls, results, TOOLS)
    return linked.withColumn("problems", F.array_join("problems", "; "))


SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn AS call_id, turn AS seq, CASE role WHEN 'user' THEN 'ask' ELSE role END AS name,
         coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id, turn) AS copies,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE role WHEN 'user' THEN 'ask' ELSE role END NULLS FIRST,
                            length(coalesce(text, ''))::VARCHAR, coalesce(text, '')) AS k
  FROM conversations WHERE (role IS NULL OR role <> 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT * FROM calls WHERE k = 1),
r AS (SELECT conv_id, turn - 1 AS call_id, min(text) AS content, bool_or(text IS NULL) AS empty FROM conversations
      WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
need AS (SELECT c.conv_id, c.call_id, c.call_id - least(c.call_id, 2) AS need, p.call_id IS NOT NULL AS there
         FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.call_id = c.call_id - least(c.call_id, 2) WHERE c.call_id <> 0),
lev(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, 0::BIGINT FROM c WHERE NOT EXISTS (
    SELECT 1 FROM need n WHERE n.conv_id = c.conv_id AND n.call_id = c.call_id AND n.there)
  UNION ALL
  SELECT n.conv_id, n.call_id, lev.level + 1 FROM lev JOIN need n ON n.conv_id = lev.conv_id AND n.need = lev.call_id AND n.there),
p AS (
  SELECT c.*, lev.level, CASE WHEN r.conv_id IS NULL THEN NULL WHEN r.empty THEN NULL ELSE r.content END AS content,
         r.conv_id IS NOT NULL AS answered,
         CASE WHEN name = 'ask' AND length(text) > 100000 THEN 'chars: above 100000; text: above 100000'
              WHEN name IN ('ask', 'system') AND length(text) = 0 THEN 'chars: below 1; text: below 1'
              WHEN name IN ('ask', 'system') THEN '' ELSE 'unknown tool' END AS problems,
         coalesce((SELECT count(*) FROM need n WHERE n.conv_id = c.conv_id AND n.call_id = c.call_id AND NOT n.there), 0) AS missing_needs
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  LEFT JOIN lev ON lev.conv_id = c.conv_id AND lev.call_id = c.call_id)
SELECT conv_id, call_id, seq, name, level,
       CASE WHEN level IS NULL THEN 'cycle' WHEN problems <> '' THEN 'invalid' WHEN NOT answered THEN 'no_result' ELSE 'ok' END AS status,
       problems, missing_needs,
       '{"arguments":{"chars":' || CASE WHEN name IN ('ask', 'system') THEN length(text)::VARCHAR ELSE '"' || length(text) || '"' END
       || CASE WHEN name = 'system' THEN '' ELSE ',"first":' || CASE WHEN name = 'ask' THEN '' ELSE '"' END
          || CASE WHEN call_id < 2 THEN 'true' ELSE 'false' END || CASE WHEN name = 'ask' THEN '' ELSE '"' END END
       || ',"text":' || to_json(text)::VARCHAR || '},"id":"' || call_id || '","name":' || coalesce(to_json(name)::VARCHAR, '""')
       || CASE WHEN content IS NULL THEN '}' ELSE ',"result":' || to_json(content)::VARCHAR || '}' END AS json
FROM p
UNION ALL
SELECT r.conv_id, r.call_id, r.call_id + 1, NULL, NULL, 'no_call', '', 0,
       CASE WHEN content IS NULL OR empty THEN '{"id":"' || r.call_id || '"}'
            ELSE '{"content":' || to_json(content)::VARCHAR || ',"id":"' || r.call_id || '"}' END
FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.call_id = r.call_id WHERE c.conv_id IS NULL
UNION ALL
SELECT conv_id, call_id, seq, name, NULL, 'repeated_call', '', 0, NULL FROM calls WHERE k > 1
UNION ALL
SELECT conv_id, turn - 1, turn, NULL, NULL, 'repeated_result', '', 0,
       CASE WHEN text IS NULL THEN '{"id":"' || (turn - 1) || '"}' ELSE '{"content":' || to_json(text)::VARCHAR || ',"id":"' || (turn - 1) || '"}' END
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS k FROM conversations
      WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL) WHERE k > 1
UNION ALL
SELECT conv_id, turn, turn, CASE role WHEN 'user' THEN 'ask' ELSE role END, NULL, 'no_id', '', 0, NULL
FROM conversations WHERE (role IS NULL OR role <> 'assistant') AND (conv_id IS NULL OR turn IS NULL)"""
