"""Rows that registered queries derive from the given tables, with the queries over them in SQL.

:func:`with_repeats` makes the end of every tenth document or so periodic.

:func:`with_tools` makes conversations with tool calls.  The table ``conversations`` holds no calls, so the registered query makes them of its rows:
every assistant's turn becomes a call that carries the turn's whole text, and every later
user's turn the result of a call; all rows are used, none is added.

* Turn t of the assistant calls id "c<t>": an unknown tool where t % 5 = 4, else ``search``
  where conv_id + t is odd, else ``calculator``.  Arguments are an object, or its JSON text in
  conversations with an even id.  ``search`` has the text's length as ``limit``, as text (which
  breaks the schema) where that is a multiple of 7.
* Where conv_id % 3 = 0 the argument is a reference to call t + 2 instead of the text.
* Turn t of the user answers call t - 1; where conv_id % 4 = 1 call t + 1, which it then precedes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_tools(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with tool calls and results; other roles, and turn 0, stay as they are."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))

    def quoted(value: Column) -> Column:
        # a JSON string, by writing an object of one field
        one = F.to_json(F.struct(value.alias("a")))
        return F.substring(one, 6, F.length(one) - 6)

    def of(k: Column) -> Column:
        return F.concat(F.lit("c"), k.cast("string"))

    tool = F.when(turn % 5 == 4, "lookup").when((conv + turn) % 2 == 1, "search").otherwise("calculator")
    argument = F.when(conv % 3 == 0, F.concat(F.lit('{"$ref":"'), of(turn + 2), F.lit('"}'))).otherwise(quoted(text))
    length = F.length(text)
    limit = F.when(length % 7 == 0, F.concat(F.lit('"'), length.cast("string"), F.lit('"'))).otherwise(length.cast("string"))
    arguments = F.when(tool == "calculator", F.concat(F.lit('{"expression":'), argument, F.lit("}"))).otherwise(F.concat(F.lit('{"query":'), argument, F.lit(',"limit":'), limit, F.lit("}")))
    given = F.when(conv % 2 == 0, quoted(arguments)).otherwise(arguments)
    call = F.concat(F.lit('{"tool_calls":[{"name":"'), tool, F.lit('","id":"'), of(turn), F.lit('","arguments":'), given, F.lit('}],"content":'), quoted(text), F.lit("}"))
    answered = F.when(conv % 4 == 1, turn + 1).otherwise(turn - 1)
    result = F.concat(F.lit('{"tool_call_id":"'), of(answered), F.lit('","content":'), quoted(text), F.lit("}"))
    known = conv.isNotNull() & turn.isNotNull()
    is_result = known & (F.col("role") == "user") & (turn > 0)
    made = F.when(known & (F.col("role") == "assistant"), call).when(is_result, result).otherwise(F.col("text"))
    return df.select("conv_id", "turn", F.when(is_result, "tool").otherwise(F.col("role")).alias("role"), made.alias("text"))


#: What a word is, in Java's and DuckDB's expressions alike.
WORD = "[^\\x20\\x09-\\x0D]+"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def with_repeats(df: DataFrame) -> DataFrame:
    """(doc_id, text) where texts whose crc32(doc_id) is a multiple of 10 repeat some of their words to the end.

    With g = crc32 / 10 and n words, each word i >= a = g % n gives way to word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8).  Such a text's words stand one space apart; other texts, and
    those without words or id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        start = (g % n).cast("int")
        period = (F.floor((n - start) / (3 + g % 8)) + 1).cast("int")
        place = _let(F.struct(start.alias("a"), period.alias("p")), lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i)), " "))

    made = _let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), repeated)
    return df.select("doc_id", F.coalesce(F.when(h % 10 == 0, made), F.col("text")).alias("text"))


#: crc32 of ``doc_id`` as text, a bit after the other.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j::INT, 1))::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)::BIGINT"

#: Runs by comparing every two equal words of a document: neighbouring pairs of one distance are a run.
REPEATS_ORACLE = f"""
WITH h AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM h),
m AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w FROM a),
t AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM m),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND y.i - x.i <= x.n // 2),
b AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM b GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
left_ AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS left_ FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_, '')) AS collapsed_sha256
FROM m LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""

#: The query over tool calls in DuckDB's dialect, from the rules above alone; ids are unique in a conversation.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END AS role, coalesce(text, '') AS text, to_json(coalesce(text, ''))::VARCHAR AS quoted, length(coalesce(text, '')) AS n,
    CASE WHEN turn % 5 = 4 THEN 'lookup' WHEN (conv_id + turn) % 2 = 1 THEN 'search' ELSE 'calculator' END AS tool, CASE WHEN conv_id % 4 = 1 THEN turn + 1 ELSE turn - 1 END AS answered
  FROM conversations
),
m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN turn END AS call, CASE WHEN role = 'tool' THEN answered END AS answer,
    CASE WHEN conv_id % 3 = 0 THEN '{"$ref":"c' || (turn + 2) || '"}' ELSE quoted END AS argument, CASE WHEN n % 7 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END AS lim
  FROM t
),
j AS (
  SELECT *, CASE WHEN call IS NOT NULL THEN '{"content":' || quoted || ',"role":"assistant","tool_calls":[{"arguments":' || CASE WHEN tool = 'calculator' THEN '{"expression":' || argument || '}' ELSE '{"limit":' || lim || ',"query":' || argument || '}' END || ',"id":"c' || turn || '","name":"' || tool || '"}]}'
    WHEN answer IS NOT NULL THEN '{"content":' || quoted || ',"role":"tool","tool_call_id":"c' || answer || '"}' ELSE '{"content":' || quoted || ',"role":' || to_json(role)::VARCHAR || '}' END AS json,
    call IS NOT NULL AND (tool = 'lookup' OR conv_id % 3 = 0 OR (tool = 'search' AND n % 7 = 0)) AS invalid
  FROM m
),
links AS (SELECT c.conv_id, c.turn AS call, r.turn AS result FROM j c JOIN j r ON r.conv_id = c.conv_id AND r.answer = c.call),
edges AS (
  SELECT conv_id, call AS a, result AS b FROM links
  UNION SELECT j.conv_id, l.result, j.turn FROM j JOIN links l ON l.conv_id = j.conv_id AND l.call = j.call + 2 WHERE j.conv_id % 3 = 0
),
paths AS (
  SELECT conv_id, a, b, 1 AS steps FROM edges
  UNION SELECT p.conv_id, p.a, e.b, p.steps + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.a = p.b
),
highest AS (SELECT conv_id, b AS turn, max(a) AS high FROM paths GROUP BY ALL),
place AS (SELECT h.conv_id, h.turn, h.high AS at_turn, max(p.steps) AS depth FROM highest h JOIN paths p ON p.conv_id = h.conv_id AND p.b = h.turn AND p.a = h.high WHERE h.high > h.turn GROUP BY ALL)
SELECT j.conv_id, j.turn, role, coalesce(at_turn, j.turn) AS at_turn, coalesce(depth, 0)::INT AS depth, (call IS NOT NULL)::INT AS n_calls, (call IS NOT NULL AND EXISTS (SELECT 1 FROM links l WHERE l.conv_id = j.conv_id AND l.call = j.call))::INT AS n_linked,
  invalid::INT AS n_invalid, 'c' || answer AS result_of, CASE WHEN answer IS NOT NULL THEN EXISTS (SELECT 1 FROM links l WHERE l.conv_id = j.conv_id AND l.result = j.turn) END AS linked, json
FROM j LEFT JOIN place USING (conv_id, turn)
"""
