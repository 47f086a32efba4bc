"""Tool-call linking: calls and results are joined by identifier, ordered topologically, validated and serialised.

* Calls and results meet in a hash join on (conversation, call id).
* A call may name the call whose result it uses (`after`, a string; an array of strings names several, see
  `graph_levels`). Its level, the number of calls before it in that
  chain, is found by pointer doubling: each round replaces a call's pointer by its target's pointer, so
  chains of n calls take log2(n) joins; what still points somewhere after that many rounds is on or
  behind a cycle. Calls are placed by (level, turn, call id) over the whole table by range partitions, so a
  conversation of any length is ordered without a window over it.
* Arguments are parsed as variants and held against field rules (type, required, range, allowed values).
* Canonical JSON has sorted keys and no blanks at every level. The record's own fields that are null (a call without
  result, arguments that are no JSON) are left out; nulls inside the arguments stay as they are.

DataFrame functions only. Defined cases: repeated calls of one id count in n_calls and the first by (turn,
name, arguments) stands for them; of several results the first by (turn, content) is used; results without
a call and calls without a result are rows of their own (`orphan_result`, `no_result`); a result that is not
after its call is `early_result`; an unknown `after` makes the call a root (`no_parent`); calls on or behind
a cycle have no level and come last; null or malformed arguments, also with one key twice in an
object, are the error `json`; unknown tools the error `tool`; a number without a fraction is an integer however it
is written (5, 5.0, 5e0) and however large; arguments of any length are parsed whole; other columns of the inputs, whatever
their names, are not read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import count_words, in_order, join_hot, stored

#: Field rules: tool, field, type, required, least, most, allowed values.
RULES = [
    ("calculate", "a", "integer", True, 0.0, 4000.0, None),
    ("calculate", "b", "integer", True, None, None, None),
    ("search", "limit", "integer", False, 1.0, 50.0, None),
    ("search", "query", "string", True, None, None, None),
    ("translate", "text", "string", True, None, None, None),
    ("translate", "to", "string", True, None, None, ["de", "en", "fr"]),
]
_RULE = "tool string, field string, type string, required boolean, least double, most double, allowed array<string>"
BROADCAST_ROWS = 100_000


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, _RULE)


def levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, after), one row per call -> conv_id, call_id, level, parent (root, parent, no_parent, cycle)."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("_known"))
    start = join_hot(calls, known, ["conv_id", "after"], "left")  # any number of calls may name one
    state = stored(
        start.select(
            "conv_id",
            "call_id",
            F.when(F.col("_known"), F.col("after")).alias("up"),
            F.when(F.col("_known"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("level"),
            F.when(F.col("_known"), "parent").when(F.col("after").isNotNull(), "no_parent").otherwise("root").alias("parent"),
        ),
        "calls-level",
    )
    most = state.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(most.bit_length()):
        if not state.where("up is not null").limit(1).count():
            break
        target = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_next"), F.col("level").alias("_more"))
        state = stored(
            join_hot(state, target, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("_next").alias("up"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level"), "parent"),
            "calls-level",
        )
    loop = F.col("up").isNotNull()
    return state.select("conv_id", "call_id", F.when(~loop, F.col("level")).alias("level"), F.when(loop, "cycle").otherwise(F.col("parent")).alias("parent"))


def graph_levels(calls: DataFrame) -> DataFrame:
    """As levels(), where `after` is an array of the calls that a call waits for: the level is the longest way from a root.

    Calls with one known parent are passed over by pointer doubling, as in levels(), up to the next call that has none or several; what is
    left is a graph of those alone, which is resolved in as many rounds as several-parent calls follow each other. Calls on or
    behind a cycle have no level. Unknown parents do not count, but for a call that has no other (`no_parent`); a call
    named twice counts once. conv_id and call_id must not be null."""
    key = ["conv_id", "call_id"]
    asked = calls.select(*key, F.explode(F.array_distinct("after")).alias("up"))
    known = calls.select("conv_id", F.col("call_id").alias("up"))
    edges = stored(join_hot(asked, known, ["conv_id", "up"]), "calls-edges")
    parents = edges.groupBy(*key).agg(F.count("*").alias("n_parents"), F.min("up").alias("up"))
    nodes = calls.select(*key, (F.size(F.coalesce("after", F.array().cast("array<string>"))) > 0).alias("_asks")).join(parents, key, "left")
    kind = F.when(F.col("n_parents") >= 1, "parent").when(F.col("_asks"), "no_parent").otherwise("root")
    one = F.coalesce(F.col("n_parents") == 1, F.lit(False))
    state = stored(nodes.select(*key, kind.alias("parent"), one.alias("one"), F.when(one, F.col("up")).alias("up"), F.when(one, 1).otherwise(0).cast("long").alias("far"), (~one).alias("done")), "calls-graph")
    most = state.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(most.bit_length()):  # `up` ends at the nearest call that has no parent or several, `far` calls away
        if not state.where("not done").limit(1).count():
            break
        to = state.select("conv_id", F.col("call_id").alias("up"), F.col("one").alias("_one"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        met = join_hot(state.where("not done"), to, ["conv_id", "up"], "left")
        here = met.select(*key, "parent", "one", F.when(F.col("_one"), F.col("_up")).otherwise(F.col("up")).alias("up"), (F.col("far") + F.when(F.col("_one"), F.col("_far")).otherwise(0)).alias("far"), F.when(F.col("_one"), F.col("_done")).otherwise(True).alias("done"))
        state = stored(state.where("done").unionByName(here), "calls-graph")
    anchors = state.where("not one")
    level = stored(anchors.where("parent <> 'parent'").select("conv_id", F.col("call_id").alias("up"), F.lit(0).cast("long").alias("level")), "calls-levels")
    end = state.where("done").select("conv_id", F.col("call_id").alias("up"), F.when(F.col("one"), F.col("up")).otherwise(F.col("call_id")).alias("at"), (F.col("far") + 1).alias("far"))
    several = anchors.where("parent = 'parent'").select(*key)
    ways = edges.join(several, key, "left_semi")
    ways = stored(join_hot(ways, end, ["conv_id", "up"], "left").select(*key, F.col("at").alias("up"), "far"), "calls-ways")
    while True:
        waiting = several.join(level.select("conv_id", F.col("up").alias("call_id")), key, "left_anti")
        reached = join_hot(ways.join(waiting, key, "left_semi"), level, ["conv_id", "up"], "left")
        now = reached.groupBy(*key).agg(F.bool_and(F.col("level").isNotNull()).alias("whole"), F.max(F.col("level") + F.col("far")).alias("level"))
        now = stored(now.where("whole").select("conv_id", F.col("call_id").alias("up"), "level"), "calls-levels")
        if not now.limit(1).count():
            break
        level = stored(level.unionByName(now), "calls-levels")
    own = state.withColumn("up", F.when(F.col("one"), F.col("up")).otherwise(F.col("call_id")))
    found = join_hot(own, level, ["conv_id", "up"], "left").withColumn("level", F.when(F.col("done"), F.col("level") + F.col("far")))
    return found.select(*key, "level", F.when(F.col("level").isNull(), "cycle").otherwise(F.col("parent")).alias("parent"))


def validated(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls with `args` (variant, null if malformed) and `errors` (sorted array<string>)."""
    r = F.struct("field", "type", "required", "least", "most", "allowed")
    per_tool = rules.groupBy(F.col("tool").alias("name")).agg(F.array_sort(F.collect_list(F.struct("field", r.alias("r")))).alias("_rules"))
    per_tool = per_tool.select("name", F.transform("_rules", lambda x: x["r"]).alias("_rules"))
    if rules.count() <= BROADCAST_ROWS:
        per_tool = F.broadcast(per_tool)
    out = calls.join(per_tool, "name", "left").withColumn("args", F.try_parse_json("arguments"))
    out = out.withColumn("_map", F.expr("try_variant_get(args, '$', 'map<string, variant>')"))
    rule_errors = F.expr("""
      transform(_rules, r -> named_struct('r', r, 'v', try_element_at(_map, r.field)))
    """)
    checks = F.expr("""
      transform(_pairs, p -> CASE
        WHEN p.v IS NULL OR is_variant_null(p.v) THEN CASE WHEN p.r.required THEN concat('missing:', p.r.field) END
        WHEN p.r.type = 'integer' AND NOT (schema_of_variant(p.v) = 'BIGINT'
          OR schema_of_variant(p.v) LIKE 'DECIMAL%' AND coalesce(try_variant_get(p.v, '$', 'decimal(38,9)') % 1 = 0, try_variant_get(p.v, '$', 'decimal(38,0)') IS NOT NULL)
          OR schema_of_variant(p.v) = 'DOUBLE' AND try_variant_get(p.v, '$', 'double') % 1 = 0) THEN concat('type:', p.r.field)
        WHEN p.r.type = 'number' AND NOT (schema_of_variant(p.v) IN ('BIGINT', 'DOUBLE') OR schema_of_variant(p.v) LIKE 'DECIMAL%') THEN concat('type:', p.r.field)
        WHEN p.r.type = 'string' AND schema_of_variant(p.v) <> 'STRING' THEN concat('type:', p.r.field)
        WHEN p.r.type = 'boolean' AND schema_of_variant(p.v) <> 'BOOLEAN' THEN concat('type:', p.r.field)
        WHEN p.r.type IN ('integer', 'number') AND (try_variant_get(p.v, '$', 'double') < p.r.least OR try_variant_get(p.v, '$', 'double') > p.r.most) THEN concat('range:', p.r.field)
        WHEN p.r.allowed IS NOT NULL AND NOT array_contains(p.r.allowed, try_variant_get(p.v, '$', 'string')) THEN concat('value:', p.r.field)
      END)
    """)
    extra = F.expr("transform(array_except(map_keys(_map), transform(_rules, r -> r.field)), f -> concat('unknown:', f))")
    errors = (
        F.when(F.col("_map").isNull() & F.col("_rules").isNull(), F.array(F.lit("json"), F.lit("tool")))
        .when(F.col("_map").isNull(), F.array(F.lit("json")))
        .when(F.col("_rules").isNull(), F.array(F.lit("tool")))
        .otherwise(F.array_sort(F.concat(F.array_compact("_checks"), "_extra")))
    )
    return out.withColumn("_pairs", rule_errors).withColumns({"_checks": checks, "_extra": extra}).withColumn("errors", errors).drop("_rules", "_map", "_pairs", "_checks", "_extra")


def link(calls: DataFrame, results: DataFrame, rules: DataFrame) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments, after), results (conv_id, call_id, turn, content), rules -> one row per call id.

    Columns: conv_id, call_id, turn, name, n_calls, n_results, status, level, parent, position (place in the
    conversation), errors, valid, canonical."""
    body = F.struct("turn", "name", "arguments", "after")
    once = stored(calls.groupBy("conv_id", "call_id").agg(F.min(body).alias("c"), F.count("*").alias("n_calls")).select("conv_id", "call_id", "c.*", "n_calls"), "calls")
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    first = first.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    several = dict(once.dtypes)["after"].startswith("array")
    level = (graph_levels if several else levels)(once).withColumnsRenamed({"conv_id": "_conv", "call_id": "_call"})
    checked = validated(once, rules).join(level, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("call_id").eqNullSafe(F.col("_call"))).drop("_conv", "_call")
    both = checked.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    status = F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("n_results").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("linked")
    canonical = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    rows = both.select(
        "conv_id",
        "call_id",
        F.coalesce("turn", "result_turn").alias("turn"),
        "name",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        status.alias("status"),
        "level",
        "parent",
        "errors",
        (F.coalesce(F.size("errors"), F.lit(-1)) == 0).alias("valid"),
        canonical.alias("canonical"),
        F.coalesce("level", F.lit((1 << 62))).alias("_level"),
    )
    placed = in_order(rows, ["conv_id", "_level", "turn", "call_id"], "calls-order")
    placed = placed.withColumn("_conv", F.to_json(F.struct("conv_id")))  # a key for null, too
    start = placed.groupBy("_conv").agg(F.min("position").alias("_first"))
    return join_hot(placed, start, "_conv").withColumn("position", F.col("position") - F.col("_first")).drop("_conv", "_first", "_level")


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations: the assistant's turns call a tool, the user's next turn answers.

    The tool, its arguments and what it depends on follow from the turn's text, with missing, mistyped and
    malformed arguments, unknown parents, forward references and cycles among them."""
    said = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumns({"n": count_words(F.col("text")), "size": F.length("text").cast("long")})
    quoted = lambda k: F.expr(f"to_json(to_variant_object(named_struct('x', array_join(slice(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), 1, {k}), ' '))))")
    value = lambda k: F.substring(quoted(k), F.lit(6), F.length(quoted(k)) - 6)
    n, size = F.col("n").cast("string"), F.col("size").cast("string")
    search = F.concat(F.lit('{ "query": '), value(3), F.lit(', "limit": '), (F.col("n") % 60).cast("string"), F.lit(" }"))
    second = F.when(F.col("n") % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n)
    calculate = F.concat(F.lit('{"b": '), second, F.lit(', "a": '), size, F.lit("}"))
    to = F.when(F.col("n") % 4 == 0, "").when(F.col("n") % 4 == 1, ', "to": "en"').when(F.col("n") % 4 == 2, ', "to": "xx"').otherwise(', "to": "fr"')
    translate = F.concat(F.lit('{"text": '), value(5), to, F.lit("}"))
    kind = F.col("size") % 3
    arguments = F.when(kind == 0, search).when(kind == 1, calculate).otherwise(translate)
    broken = F.when(F.col("size") % 17 == 0, F.substring(arguments, F.lit(1), F.length(arguments) - 1)).otherwise(arguments)
    name = F.when(kind == 0, "search").when(kind == 1, "calculate").otherwise("translate")
    call = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    after = F.when(F.col("n") % 2 == 1, call(F.col("turn") - 2)).when(F.col("n") % 10 == 0, call(F.col("turn") + 2))
    calls = said.where("role = 'assistant'").select("conv_id", call(F.col("turn")).alias("call_id"), "turn", name.alias("name"), broken.alias("arguments"), after.alias("after"))
    results = said.where("role = 'user'").select("conv_id", call(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_calls(spark, sf_dir):
    calls, results = calls_and_results(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = link(calls, results, rules_table(spark))
    return out.withColumn("errors", F.array_join("errors", ","))


ORACLE = r"""WITH RECURSIVE said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS size,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM conversations),
counted AS (SELECT *, len(ws)::BIGINT AS n FROM said),
calls0 AS (SELECT conv_id, 'call-' || turn AS call_id, turn, CASE size % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'calculate' ELSE 'translate' END AS name,
    size % 17 = 0 AS broken, size, n, to_json(coalesce(array_to_string(ws[1:3], ' '), ''))::VARCHAR AS q3, to_json(coalesce(array_to_string(ws[1:5], ' '), ''))::VARCHAR AS q5,
    CASE WHEN n % 2 = 1 THEN 'call-' || (turn - 2) WHEN n % 10 = 0 THEN 'call-' || (turn + 2) END AS after FROM counted WHERE role = 'assistant'),
calls AS (SELECT *, CASE name
      WHEN 'search' THEN '{"limit":' || (n % 60) || ',"query":' || q3 || '}'
      WHEN 'calculate' THEN '{"a":' || size || ',"b":' || CASE WHEN n % 5 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || '}'
      ELSE '{"text":' || q5 || CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN ',"to":"en"' WHEN 2 THEN ',"to":"xx"' ELSE ',"to":"fr"' END || '}' END AS args,
    CASE WHEN broken THEN 'json'
      WHEN name = 'search' THEN CASE WHEN n % 60 < 1 OR n % 60 > 50 THEN 'range:limit' ELSE '' END
      WHEN name = 'calculate' THEN concat_ws(',', CASE WHEN size > 4000 THEN 'range:a' END, CASE WHEN n % 5 = 0 THEN 'type:b' END)
      ELSE CASE n % 4 WHEN 0 THEN 'missing:to' WHEN 2 THEN 'value:to' ELSE '' END END AS errors FROM calls0),
known AS (SELECT c.*, p.call_id AS up FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.after),
lv AS (SELECT conv_id, call_id, 0::BIGINT AS level FROM known WHERE up IS NULL
       UNION ALL SELECT k.conv_id, k.call_id, lv.level + 1 FROM known k JOIN lv ON k.conv_id = lv.conv_id AND k.up = lv.call_id),
res AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM counted WHERE role = 'user'),
j AS (SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, coalesce(k.call_id, r.call_id) AS call_id, coalesce(k.turn, r.result_turn) AS turn, k.name,
    CASE WHEN k.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_calls, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results,
    CASE WHEN k.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' WHEN r.result_turn <= k.turn THEN 'early_result' ELSE 'linked' END AS status,
    lv.level, CASE WHEN k.call_id IS NULL THEN NULL WHEN lv.level IS NULL THEN 'cycle' WHEN k.up IS NOT NULL THEN 'parent' WHEN k.after IS NOT NULL THEN 'no_parent' ELSE 'root' END AS parent,
    k.errors, coalesce(k.errors = '', false) AS valid,
    '{' || CASE WHEN k.call_id IS NULL OR k.broken THEN '' ELSE '"arguments":' || k.args || ',' END || '"id":"' || coalesce(k.call_id, r.call_id) || '"'
      || CASE WHEN k.name IS NULL THEN '' ELSE ',"name":"' || k.name || '"' END || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || to_json(r.content)::VARCHAR END || '}' AS canonical
  FROM known k LEFT JOIN lv ON lv.conv_id = k.conv_id AND lv.call_id = k.call_id FULL JOIN res r ON r.conv_id = k.conv_id AND r.call_id = k.call_id)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) - 1 AS position FROM j"""
