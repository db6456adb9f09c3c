"""Chat formatting: tool-call linking in DataFrame functions only.

Calls and results meet in a hash join by identifier; calls are ordered so that each comes after the calls whose
results it refers to; arguments are checked against schemas; and each call is written with its result as canonical JSON
(keys sorted, no blanks, numbers in one form).

Calls come from two places. In a message of role assistant, ``<tool_call>{"id", "name", "arguments", "refs"}</tool_call>``
is a call and, in any message, ``<tool_result>{"id", "content"}</tool_result>`` a result. And every user turn of a plain chat is itself a call
of the tool ``reply``, whose result is the assistant turn that follows it at once: its identifier is the user's turn, and it refers to the
exchange two turns before. Identifiers are told apart by conversation: both kinds stand as conversation:identifier.

Order: calls stand by (topo_level, pos, call_id). A call that refers to no known call has level 0, any other one more than
the highest level it refers to. Chains, in which each call refers to one other, are followed by pointer doubling, so that a conversation of n
turns takes log2(n) joins; calls that refer to several are placed in rounds, each a join over what isn't placed yet. Calls on a cycle, and those
that need them, get level null and status "cycle". A reference to an unknown call is an error (``ref:``) but doesn't hold the call up;
the exchange before the first one is no reference.

Cases: null conversation, turn or text is kept (a null text is a call without its required text, a null turn refers to nothing); a repeated
identifier is one call, the least by turn and arguments; of several results the first by turn counts, with their number; results without a call
have status "orphan"; arguments that aren't a JSON object are errors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import WORD, checkpoint, table

#: Tool: parameter: (JSON type, required).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"text": ("string", True), "words": ("integer", True)}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def quoted(x: Column) -> Column:
    """A JSON string, or null."""
    json = F.to_json(F.struct(x.alias("a")))
    return F.when(x.isNull(), "null").otherwise(F.substring(json, F.lit(6), F.length(json) - 6))


def _id(conv: Column, turn: Column) -> Column:
    return F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit("")), F.coalesce(turn.cast("string"), F.lit("")))


def chat_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, pos, name, arguments, refs, implied) of marked calls and of user turns; implied references may lead nowhere."""
    turn = (
        messages.where("role = 'user'")
        .withColumn("words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)))
        .select("conv_id", _id(F.col("conv_id"), F.col("turn")).alias("call_id"), F.col("turn").alias("pos"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "words")).alias("arguments"), F.when(F.col("turn").isNotNull(), F.array(_id(F.col("conv_id"), F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("refs"), F.lit(True).alias("implied"))
    )
    json = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))).alias("json")
    refs = F.transform(F.coalesce(F.from_json(F.get_json_object("json", "$.refs"), "array<string>"), F.array().cast("array<string>")), lambda x: _id(F.col("conv_id"), x))
    marked = (
        messages.where("role = 'assistant'").select("conv_id", "turn", json)
        .select("conv_id", _id(F.col("conv_id"), F.get_json_object("json", "$.id")).alias("call_id"), F.col("turn").alias("pos"), F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.arguments").alias("arguments"), refs.alias("refs"), F.lit(False).alias("implied"))
    )
    return turn.unionByName(marked)


def chat_results(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, pos, content) of marked results and of assistant turns, which answer the turn before."""
    turn = messages.where("role = 'assistant'").select("conv_id", _id(F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("pos"), quoted(F.col("text")).alias("content"))
    json = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_result>(.*?)</tool_result>"), F.lit(1))).alias("json")
    v = F.try_parse_json("json")
    marked = messages.select("conv_id", "turn", json).select("conv_id", _id(F.col("conv_id"), F.get_json_object("json", "$.id")).alias("call_id"), F.col("turn").alias("pos"), F.to_json(F.try_variant_get(v, "$.content", "variant")).alias("content"))
    return turn.unionByName(marked)


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """array<string>: what is wrong with a call's arguments; empty if nothing."""
    v = F.try_parse_json(arguments)
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    out = F.array(F.lit("unknown tool"))
    for tool, params in schemas.items():
        found: list[Column] = []
        for p, (kind, required) in params.items():
            path = f"$['{p}']" if '"' in p else f'$["{p}"]'
            got = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
            wrong = F.when(~got.rlike(f"^({_TYPES[kind]})$"), F.lit(f"type:{p}"))
            found.append(F.when(got == "VOID", F.lit(f"missing:{p}") if required else F.lit(None).cast("string")).otherwise(wrong))
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, params)).cast("array<string>"))), lambda k: F.concat(F.lit("unknown:"), k))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*found).cast("array<string>")), unknown)).otherwise(out)
    return F.when(F.coalesce(is_object, F.lit(False)), out).otherwise(F.array(F.lit("not an object")))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, topo_level) of calls; edges are their distinct references (call_id, ref) to known calls. Null on cycles and behind them."""
    degree = checkpoint(edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref")))
    # Chains: (call_id, to, steps) leads from each call with one reference to the first call that has none or several.
    chain = checkpoint(degree.where("n = 1").select("call_id", F.col("ref").alias("to"), F.lit(1).cast("long").alias("steps")))
    before = -1
    while True:
        on = chain.select(F.col("call_id").alias("_via"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        chain = checkpoint(
            chain.join(on.hint("shuffle_hash"), F.col("to") == F.col("_via"), "left")
            .select("call_id", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_via").isNotNull().alias("moved"))
        )
        moved = chain.where("moved").count()
        if moved in (0, before):  # where calls still lead on and none arrives, they go round in circles
            break
        before = moved
    ends = chain.where(~F.col("moved")).select("call_id", "to", "steps")
    done = checkpoint(calls.join(degree, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("topo_level")))
    left = checkpoint(degree.where("n > 1").select("call_id"))
    if not left.isEmpty():
        by_end = ends.select(F.col("call_id").alias("ref"), "to", "steps")
        several = edges.join(left, "call_id", "left_semi").join(by_end, "ref", "left")
        several = checkpoint(several.select("call_id", F.coalesce("to", "ref").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
        while True:
            at = several.join(left, "call_id", "left_semi").join(done.select(F.col("call_id").alias("to"), "topo_level"), "to", "left")
            free = at.groupBy("call_id").agg(F.max(F.col("topo_level") + F.col("steps")).alias("topo_level"), F.bool_and(F.col("topo_level").isNotNull()).alias("all"))
            free = checkpoint(free.where("all").select("call_id", "topo_level"))
            if free.isEmpty():
                break
            done = done.unionByName(free)
            left = checkpoint(left.join(free, "call_id", "left_anti"))
        done = checkpoint(done)
    along = ends.join(done.select(F.col("call_id").alias("to"), "topo_level"), "to").select("call_id", (F.col("topo_level") + F.col("steps")).alias("topo_level"))
    return done.unionByName(along)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row per call and per orphaned result: conv_id, call_id, pos, topo_level, status, n_results, errors, json."""
    c = calls.groupBy("call_id").agg(F.min(F.struct("pos", "arguments", "conv_id", "name", "refs", "implied")).alias("c")).select("call_id", "c.*")
    r = results.groupBy("call_id").agg(F.min(F.struct("pos", "content", "conv_id")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    slim = checkpoint(c.select("call_id", "refs", "implied"))
    known = slim.select(F.col("call_id").alias("_known"))
    edges = slim.select("call_id", "implied", F.explode("refs").alias("ref")).distinct()
    edges = checkpoint(edges.join(known.hint("shuffle_hash"), F.col("ref") == F.col("_known"), "left"))
    lost = edges.where("_known IS NULL AND NOT implied").groupBy(F.col("call_id").alias("_lost")).agg(F.array_sort(F.collect_list(F.concat(F.lit("ref:"), "ref"))).alias("lost"))
    placed = levels(slim, edges.where("_known IS NOT NULL").select("call_id", "ref")).withColumnRenamed("call_id", "_placed")
    c = c.withColumn("_is_call", F.lit(True))
    j = c.join(r.hint("shuffle_hash"), "call_id", "full").join(placed.hint("shuffle_hash"), F.col("call_id") == F.col("_placed"), "left").join(lost, F.col("call_id") == F.col("_lost"), "left")
    is_call = F.coalesce("_is_call", F.lit(False))
    cycle = is_call & F.col("topo_level").isNull()
    status = F.when(~is_call, "orphan").when(cycle, "cycle").when(F.col("r").isNull(), "no_result").otherwise("linked")
    none = F.array().cast("array<string>")
    wrong = F.when(is_call, F.concat(errors(F.col("name"), F.col("arguments"), schemas), F.coalesce("lost", none))).otherwise(none)
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), quoted(F.col("arguments")))
    json = F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), F.coalesce("r.content", F.lit("null")), F.lit("}"))
    return j.select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), "call_id", F.coalesce("pos", "r.pos").alias("pos"), "topo_level", status.alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.array_join(wrong, ",").alias("errors"), json.alias("json"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link(chat_calls(m), chat_results(m))


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS words,
    coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn AS VARCHAR), '') AS call_id
  FROM conversations WHERE role = 'user'),
r AS (
  SELECT conv_id, turn, text, coalesce(CAST(conv_id AS VARCHAR), '') || ':' || coalesce(CAST(turn - 1 AS VARCHAR), '') AS call_id
  FROM conversations WHERE role = 'assistant'),
l AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS topo_level FROM c a
  WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, l.topo_level + 1 FROM l JOIN c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.turn = l.turn + 2)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS pos,
  l.topo_level,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  CASE WHEN r.call_id IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_results,
  CASE WHEN c.call_id IS NULL OR c.text IS NOT NULL THEN '' ELSE 'missing:text' END AS errors,
  '{"arguments":' || CAST(CASE WHEN c.call_id IS NULL THEN to_json(NULL) WHEN c.text IS NULL THEN to_json({'words': c.words}) ELSE to_json({'text': c.text, 'words': c.words}) END AS VARCHAR)
    || ',"id":' || CAST(to_json(coalesce(c.call_id, r.call_id)) AS VARCHAR) || ',"name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
    || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
FROM c FULL JOIN r ON c.call_id = r.call_id LEFT JOIN l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.turn IS NOT DISTINCT FROM l.turn
"""
