"""Queries of the evaluation operators on the driver's tables, with SQL oracles.

The tables stand in for prompts, responses and logs: benchmark texts are
references, conversations and events are attempts and tool calls, labels are
answers.  Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textgauge.functions import answers, text
from textgauge.functions.alignment import edit_counts_udf, token_distance
from textgauge.operators import attempts, candidates, diagnostics, matching, partitioning, prompts, rollups, scoring, tools, validation, worker, workflow
from textgauge.plans import reports
from textgauge.sources.layout import spread_rows
from textgauge.sources.sinks import checkpointed


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ validation and matching

_CASE_ID = "concat(CASE doc_id % 6 WHEN 0 THEN 'AD' WHEN 1 THEN 'SCI' WHEN 2 THEN 'UI' WHEN 3 THEN 'CULT' WHEN 4 THEN 'LIFE' ELSE 'ART' END, '-', CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END)"


@query(f"SELECT doc_id, id, regexp_full_match(id, '(AD|SCI|UI|CULT|LIFE)-[0-9]{{4}}') AS ok FROM (SELECT doc_id, {_CASE_ID} AS id FROM documents)")
def id_validation(spark, sf_dir):
    ids = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_CASE_ID.replace("VARCHAR", "STRING")).alias("id"))
    return ids.withColumn("ok", validation.case_id_ok(F.col("id")))


@query("SELECT doc_id, 'left' AS side FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def prompt_checklist_set_equality(spark, sf_dir):
    return matching.one_sided(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@query("""
    WITH v AS (SELECT DISTINCT doc_id AS case_id FROM labels), c AS (SELECT doc_id AS case_id FROM documents)
    SELECT c.case_id, CASE WHEN v.case_id IS NULL THEN 'missing' ELSE 'selected' END AS state FROM c LEFT JOIN v USING (case_id)""")
def selected_and_missing_videos(spark, sf_dir):
    cases = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"))
    videos = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id")).distinct()
    chosen, missing = matching.select_videos(videos, cases, cases, allow_missing=True)
    return chosen.withColumn("state", F.lit("selected")).unionByName(missing.withColumn("state", F.lit("missing")))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'pass' WHEN l.toxic = 1 THEN 'invalid' WHEN l.doc_id IS NOT NULL THEN 'retrying' END, 'pending') AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def jobs_with_status(spark, sf_dir):
    jobs = _t(spark, sf_dir, "documents").select(F.lit("p").alias("profile"), F.col("doc_id").alias("case_id"))
    return matching.with_status(jobs, _status(spark, sf_dir)).select(F.col("case_id").alias("doc_id"), "status")


def _status(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "labels").select(F.lit("p").alias("profile"), F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "invalid").otherwise("retrying").alias("status"))


@query("SELECT coalesce(CASE WHEN l.quality = 1 THEN 'pass' WHEN l.toxic = 1 THEN 'invalid' WHEN l.doc_id IS NOT NULL THEN 'retrying' END, 'pending') AS status, count(*) AS jobs, count(*) FILTER (l.quality = 1) AS scored FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def status_counts_pending(spark, sf_dir):
    jobs = _t(spark, sf_dir, "documents").select(F.lit("p").alias("profile"), F.col("doc_id").alias("case_id"))
    return scoring.status_report(matching.with_status(jobs, _status(spark, sf_dir)), ("pass",))[0]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)")
def resume_unfinished(spark, sf_dir):
    jobs = _t(spark, sf_dir, "documents").select(F.lit("p").alias("profile"), F.col("doc_id").alias("case_id"))
    return matching.unfinished(jobs, _status(spark, sf_dir)).select(F.col("case_id").alias("doc_id"))


_SEVERITY = "CASE event_type WHEN 'view' THEN 'Info' WHEN 'click' THEN ' minor' WHEN 'signup' THEN 'MEDIUM' WHEN 'purchase' THEN CAST(event_id % 6 AS VARCHAR) ELSE 'unknown' END"


@query(f"SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN CASE WHEN event_id % 6 <= 3 THEN CAST(event_id % 6 AS INT) END END AS severity FROM (SELECT *, {_SEVERITY} AS label FROM events)")
def severity_coercion(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("label", F.expr(_SEVERITY.replace("VARCHAR", "STRING")))
    return e.select("event_id", validation.severity(F.col("label")).alias("severity"))


@query("SELECT p_partkey, (p_size % 3 = 0) AND abs(CASE WHEN p_size % 2 = 0 THEN 24.0 ELSE 24000.0 / 1001 END - 24) <= 0.01 AND abs(10 + (p_size % 5) * 0.03 - 10) <= 0.05 AS ok FROM part")
def media_contract(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    frames = F.when(F.col("p_size") % 3 == 0, 240).otherwise(239)
    rate = validation.frame_rate(F.when(F.col("p_size") % 2 == 0, "24/1").otherwise("24000/1001"))
    return p.select("p_partkey", validation.media_ok(frames, rate, F.lit(10.0) + (F.col("p_size") % 5) * 0.03).alias("ok"))


# ------------------------------------------------------------------ prompts


def _cases(spark, sf_dir) -> DataFrame:
    """Benchmark texts as prompts with two targets: the first sentence and the fourth word from the end."""
    b = _t(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    w = F.split("text", " ")
    return b.select(
        F.col("item_id").cast("string").alias("id"),
        F.col("text").alias("prompt_en"),
        F.array(
            *[
                F.struct(F.lit(f"T0{k}").alias("id"), F.lit("sign").alias("carrier"), F.lit("any").alias("language"), v.alias("verbatim"))
                for k, v in ((1, F.split_part("text", F.lit("."), F.lit(1))), (2, F.get(w, F.size(w) - 4)))
            ]
        ).alias("required_text"),
    )


_CASES_SQL = "c AS (SELECT item_id, text, split_part(text, '.', 1) AS v1, w[len(w) - 3] AS v2 FROM (SELECT *, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL))"


@query(f"WITH {_CASES_SQL} SELECT CAST(item_id AS VARCHAR) AS case_id, 0 AS pos, 'T01' AS text_id, v1 AS verbatim FROM c UNION ALL SELECT CAST(item_id AS VARCHAR), 1, 'T02', v2 FROM c")
def explode_targets(spark, sf_dir):
    return prompts.explode_targets(_cases(spark, sf_dir)).select("case_id", "pos", "text_id", "verbatim")


@query(f"""
    WITH {_CASES_SQL}, m AS (SELECT *, replace(text, v1, '[TARGET T01]') AS t1 FROM c),
         k AS (SELECT *, replace(t1, v2, '[TARGET T02]') AS t2, (length(text) - length(replace(text, v1, ''))) // length(v1) AS n1,
                      (length(text) - length(replace(text, v2, ''))) // length(v2) AS n2, (length(t1) - length(replace(t1, v2, ''))) // length(v2) AS n3 FROM m)
    SELECT CAST(item_id AS VARCHAR) AS id, t2 AS masked_prompt,
           array_to_string(list_filter([CASE WHEN n1 <> 1 THEN 'T01:occurrences' END, CASE WHEN n2 <> 1 OR n3 <> 1 THEN 'T02:occurrences' END,
                       CASE WHEN contains(t2, v1) THEN 'T01:remains' END, CASE WHEN contains(t2, v2) THEN 'T02:remains' END], lambda x: x IS NOT NULL), ',') AS mask_errors FROM k""")
def mask_prompt(spark, sf_dir):
    m = prompts.mask(_cases(spark, sf_dir))
    return m.select("id", "masked_prompt", F.array_join("mask_errors", ",").alias("mask_errors"))


@query(f"WITH {_CASES_SQL}, n AS (SELECT d.doc_id, (SELECT count(*) FROM c WHERE contains(d.text, c.v1) OR contains(d.text, c.v2)) AS n_items FROM documents d) SELECT doc_id, n_items, n_items > 0 AS leaks FROM n")
def leak_check(spark, sf_dir):
    """Every document against the private targets of every case."""
    found = prompts.leaked_cases(_t(spark, sf_dir, "documents"), prompts.mask(_cases(spark, sf_dir)).select("id", "private_targets"))
    return found.select("doc_id", F.col("n_cases").alias("n_items"), (F.col("n_cases") > 0).alias("leaks"))


@query("""SELECT p_partkey, '<answer>[' || array_to_string(list_transform(range(1, CAST(p_size % 20 AS BIGINT) + 2), lambda k: '{"id":"C' || lpad(CAST(k AS VARCHAR), 2, '0') || '","answer":"' || CASE WHEN k % 2 = 1 THEN 'yes' ELSE 'no' END || '"}'), ',') || ']</answer>' AS example FROM part""")
def request_examples(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.example_answers(F.col("p_size") % 20 + 1).alias("example"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'of ' || o_orderpriority WHEN 1 THEN o_orderpriority || ' then' WHEN 2 THEN '- pan left' WHEN 3 THEN 'pan' WHEN 5 THEN 'now status' WHEN 7 THEN 'status' END AS refined,
           CASE o_orderkey % 8 WHEN 4 THEN 'adds_nothing' WHEN 6 THEN CASE WHEN o_orderkey % 16 = 6 THEN 'blank_refinement' ELSE 'blank_prompt' END END AS fault FROM orders""")
def deduplicated_refinement(spark, sf_dir):
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey") % 8
    prompt = F.concat(F.lit("status "), "o_orderstatus")
    told = (
        F.when(k == 0, F.concat(F.lit(" "), prompt, F.lit(": - of "), "o_orderpriority"))
        .when(k == 1, F.concat(F.col("o_orderpriority"), F.lit(" then ")))
        .when(k == 2, F.lit("\t- pan left\u3000"))
        .when(k == 3, F.concat(prompt, F.lit("\r\n--:pan\x1c")))
        .when(k == 4, F.concat(prompt, F.lit(" :-\n")))
        .when(k == 5, F.lit("\u00a0now status"))
        .when(k == 6, F.when(F.col("o_orderkey") % 16 == 6, F.lit(" \x1f")).otherwise(F.lit("pan")))
        .otherwise(F.lit("status"))
    )
    original = F.when(F.col("o_orderkey") % 16 == 14, F.lit(" \t")).otherwise(F.concat(F.lit("\t"), prompt, F.lit("\u2003")))
    return o.select("o_orderkey", text.refinement(original, told).alias("r")).select("o_orderkey", F.col("r.text").alias("refined"), "r.fault")


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'at ' || user_id WHEN 'signup' THEN user_id || '|1.5|true' WHEN 'purchase' THEN 'x' ELSE '' END AS evidence FROM events""")
def evidence_coercion(spark, sf_dir):
    told = """CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN concat('"at ', user_id, '"') WHEN 'signup' THEN concat('["', user_id, '", 1.5, "true"]') WHEN 'purchase' THEN '{"x": 1}' ELSE ' null' END"""
    e = _t(spark, sf_dir, "events").select("event_id", validation.evidence(F.expr(told)).alias("e"))
    return e.select("event_id", F.array_join("e", "|").alias("evidence"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'prompt_tokens=' || user_id || ',total_tokens=' || (user_id + 5) WHEN 1 THEN '' ELSE 'completion_tokens=' || user_id END AS usage FROM events")
def token_usage(spark, sf_dir):
    told = """CASE event_id % 3 WHEN 0 THEN concat('{"usage":{"prompt_tokens":', user_id, ',"total_tokens":', user_id + 5, ',"other":1}}') WHEN 1 THEN '{"id":"a"}' ELSE concat('{"usage":{"completion_tokens":', user_id, ',"prompt_tokens":null}}') END"""
    e = _t(spark, sf_dir, "events").select("event_id", F.map_entries(validation.token_usage(F.expr(told))).alias("u"))
    return e.select("event_id", F.array_join(F.transform("u", lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("usage"))


# ------------------------------------------------------------------ responses

_RAW = "CASE turn % 4 WHEN 0 THEN concat('note <ANSWER> ', said, ' \u3000</answer> tail') WHEN 1 THEN concat('<answer>\u00a0', said, '\u001c</Answer><answer>x</answer>') WHEN 2 THEN concat('<answer>', said) ELSE concat(' <an\u017fwer> ', said, chr(10), '</answer> ') END"
_TRIM = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"


@query(f"""
    SELECT conv_id, turn, role, n AS block_count, content, n > 1 AS more, before <> '' AS text_before FROM (
      SELECT conv_id, turn, role, CASE WHEN turn % 4 = 1 THEN 2 WHEN turn % 4 = 2 THEN 0 ELSE 1 END AS n,
             CASE WHEN turn % 4 <> 2 THEN regexp_replace(regexp_replace(coalesce(text, ''), '^{_TRIM}', ''), '{_TRIM}$', '') END AS content,
             CASE turn % 4 WHEN 0 THEN 'note' WHEN 2 THEN 'x' ELSE '' END AS before
      FROM conversations)""")
def answer_block_parse(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("said", F.coalesce("text", F.lit(""))).withColumn("b", text.answer_block(F.expr(_RAW)))
    return c.select("conv_id", "turn", "role", "b.block_count", "b.content", (F.col("b.additional_blocks") > 0).alias("more"), "b.text_before")


_ITEMS = """concat('[', array_join(transform(sequence(1, 20), k -> concat('{"id":"C', lpad(cast(k as string), 2, '0'), '","answer":"', if((doc_id + k) % 3 = 0, ' No ', 'YES'), '"}')), ','), ']')"""


def _checklist_raw() -> str:
    return f"""CASE doc_id % 8
        WHEN 0 THEN concat('<answer>', {_ITEMS}, '</answer>')
        WHEN 1 THEN concat('<answer>', rtrim(']', {_ITEMS}), '</answer>')
        WHEN 2 THEN concat('<answer>', replace({_ITEMS}, '"C10"', '"C010"'), '</answer>')
        WHEN 3 THEN concat('<answer>', replace({_ITEMS}, '"C05"', '"C55"'), '</answer>')
        WHEN 4 THEN concat('<answer>', replace({_ITEMS}, 'YES', 'maybe'), '</answer>')
        WHEN 5 THEN concat('<answer>', {_ITEMS})
        WHEN 6 THEN concat('<answer>', replace({_ITEMS}, '"id"', 'id'), '</answer>')
        ELSE '<answer>{{"id":"C01"}}</answer>' END"""


@query("""
    SELECT doc_id, CASE doc_id % 8 WHEN 3 THEN 'other' WHEN 4 THEN 'invalid_answer_label' WHEN 5 THEN 'incomplete_answer_block' WHEN 6 THEN 'invalid_json' WHEN 7 THEN 'other' END AS reason,
           doc_id % 8 = 1 AS repaired, CASE WHEN doc_id % 8 IN (0, 1, 2) THEN list_sum(list_transform(range(1, 21), lambda k: CASE WHEN (doc_id + k) % 3 = 0 THEN 0 ELSE 1 END))::BIGINT END AS yes_count,
           CASE doc_id % 8 WHEN 3 THEN 1 WHEN 4 THEN list_sum(list_transform(range(1, 21), lambda k: CASE WHEN (doc_id + k) % 3 = 0 THEN 0 ELSE 1 END))::BIGINT WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS errors
    FROM labels""")
def checklist_validate(spark, sf_dir):
    r = _t(spark, sf_dir, "labels").withColumn("r", answers.checklist(F.expr(_checklist_raw())))
    yes = F.when(F.col("r.reason").isNull(), F.size(F.filter("r.decisions", lambda d: d["answer"] == "yes"))).cast("bigint")
    return r.select("doc_id", "r.reason", "r.repaired", yes.alias("yes_count"), F.size("r.errors").cast("bigint").alias("errors"))


_ONE = """concat('{"T01":{"status":"', %s, '","text":"', %s, '","readability_note":"', %s, '"}}')"""


def _transcription_raw() -> str:
    ok = _ONE % ("'transcribed'", "'shop'", "''")
    return f"""CASE doc_id % 10
        WHEN 0 THEN concat('<answer>', {ok}, '</answer>')
        WHEN 1 THEN concat('<answer>', {_ONE % ("'transcribed'", "repeat('a', 641)", "''")}, '</answer>')
        WHEN 2 THEN concat('<answer>', {_ONE % ("'seen'", "'shop'", "''")}, '</answer>')
        WHEN 3 THEN concat('<answer>', {_ONE % ("'text_unreadable'", "''", "''")}, '</answer>')
        WHEN 4 THEN concat('<answer>', replace({ok}, 'T01', 'T02'), '</answer>')
        WHEN 5 THEN concat('<answer>', {ok})
        WHEN 6 THEN '<answer>[1]</answer>'
        WHEN 7 THEN concat('<answer>', {_ONE % ("'text_unreadable'", "'x'", "'dim'")}, '</answer>')
        WHEN 8 THEN '<answer>{{"T01":{{"status":"carrier_not_found","text":null,"readability_note":""}}}}</answer>'
        ELSE 'nothing' END"""


@query("""
    SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'transcription_too_long' WHEN 5 THEN CASE WHEN quality = 1 THEN 'unclosed_answer_repetition' ELSE 'other' END WHEN 6 THEN 'other' WHEN 9 THEN 'other' ELSE 'field_conflict' END AS reason,
           CASE WHEN doc_id % 10 IN (5, 6, 9) THEN NULL WHEN doc_id % 10 IN (3, 4) THEN 'text_unreadable' WHEN doc_id % 10 = 8 THEN 'carrier_not_found' ELSE 'transcribed' END AS status,
           CASE WHEN doc_id % 10 IN (5, 6, 9) THEN NULL WHEN doc_id % 10 IN (0, 2) THEN 'shop' WHEN doc_id % 10 = 1 THEN repeat('a', 641) WHEN doc_id % 10 = 7 THEN 'x' ELSE '' END AS text
    FROM labels""")
def transcription_validate_and_accept(spark, sf_dir):
    r = _t(spark, sf_dir, "labels").withColumn("r", answers.transcription(F.expr(_transcription_raw()), F.array(F.lit("T01")), F.when(F.col("quality") == 1, "length").otherwise("stop")))
    return r.select("doc_id", "r.reason", F.get("r.answer", 0)["status"].alias("status"), F.get("r.answer", 0)["text"].alias("text"))


_SPACES = "list_contains([" + ", ".join(f"chr({i})" for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)) + "], c[i])"


@query(f"""
    WITH t AS (SELECT doc_id, text, string_split(text, '') AS c FROM documents),
         u AS (SELECT doc_id, bool_or(far >= u * (greatest(16, -((-128) // u)) - 1)) AS hit FROM (
               SELECT doc_id, u, list_max(list_transform(range(1, len(g)), lambda k: g[k + 1] - g[k] - 1)) AS far FROM (
               SELECT doc_id, u, list_concat([0], list_filter(range(1, len(c) + 1), lambda i: c[i] IS DISTINCT FROM c[i + u]), [len(c) + 1]) AS g FROM t, range(2, 17) r(u)))
               GROUP BY doc_id),
         o AS (SELECT doc_id, list_max(list_transform(range(1, len(g)), lambda k: g[k + 1] - g[k] - 1)) >= 63 AS one, list_max(list_transform(range(1, len(w)), lambda k: w[k + 1] - w[k] - 1)) >= 64 AS white FROM (
               SELECT doc_id, list_concat([0], list_filter(range(1, len(c) + 1), lambda i: c[i] IS DISTINCT FROM c[i + 1]), [len(c) + 1]) AS g,
                      list_concat([0], list_filter(range(1, len(c) + 1), lambda i: NOT {_SPACES}), [len(c) + 1]) AS w FROM t))
    SELECT t.doc_id, CASE WHEN text IS NOT NULL THEN one END AS same_character, CASE WHEN text IS NOT NULL THEN hit END AS repeated_unit, CASE WHEN text IS NOT NULL THEN white END AS white_space
    FROM t LEFT JOIN u USING (doc_id) LEFT JOIN o USING (doc_id)""")
def repetition_flags(spark, sf_dir):
    d = spread_rows(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", text.same_character_run(F.col("text")).alias("same_character"), text.repeated_unit_run(F.col("text")).alias("repeated_unit"), text.white_space_run(F.col("text")).alias("white_space"))


_LEADS = ", ".join(f"lead(c, {u}) OVER w" for u in range(1, 17))


@query(f"""
    WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
         l AS (SELECT doc_id, i, c, [{_LEADS}] AS n FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
         same AS (SELECT doc_id, i, u FROM (SELECT doc_id, i, c, unnest(n) AS x, generate_subscripts(n, 1) AS u FROM l) WHERE c = x),
         run AS (SELECT doc_id, u, min(i) AS a, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, u ORDER BY i) AS island FROM same) GROUP BY doc_id, u, island),
         one AS (SELECT doc_id, a, n + 1 AS n FROM run WHERE u = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a) = 1),
         unit AS (SELECT doc_id, a, u, n // u + 1 AS k FROM run WHERE u > 1 AND n // u + 1 >= 16 AND (n // u + 1) * u >= 128 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (n // u + 1) * u DESC, u, a) = 1)
    SELECT doc_id, CAST(length(text) AS INT) AS length, CASE WHEN text <> '' THEN substr(text, coalesce(one.a, 1), 1) END AS char_unit, CAST(CASE WHEN text <> '' THEN coalesce(one.n, 1) END AS INT) AS char_count, CAST(CASE WHEN text <> '' THEN coalesce(one.a, 1) - 1 END AS INT) AS char_start,
           substr(text, unit.a, u) AS unit, CAST(u AS INT) AS unit_length, CAST(k AS INT) AS repeat_count, CAST(k * u AS INT) AS covered_length, CAST(unit.a - 1 AS INT) AS unit_start, CAST(unit.a - 1 + k * u AS INT) AS unit_end
    FROM documents LEFT JOIN one USING (doc_id) LEFT JOIN unit USING (doc_id)""")
def repetition_details(spark, sf_dir):
    """Where the longest runs of every document are."""
    d = spread_rows(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.repetition_details("text").alias("d"))
    one, unit = F.col("d.longest_character_run"), F.col("d.longest_repeated_substring_run")
    return d.select(
        "doc_id", "d.length", *[one[a].alias(b) for a, b in (("unit", "char_unit"), ("repeat_count", "char_count"), ("start", "char_start"))],
        *[unit[a].alias(b) for a, b in (("unit", "unit"), ("unit_length", "unit_length"), ("repeat_count", "repeat_count"), ("covered_length", "covered_length"), ("start", "unit_start"), ("end", "unit_end"))],
    )


# ------------------------------------------------------------------ attempts

_ATTEMPTS = "SELECT conv_id, turn AS attempt, length(text) % 5 = 0 AS passed, length(text) % 2 = 0 AS parsed, CASE WHEN length(text) % 5 = 0 THEN NULL WHEN length(text) % 3 = 0 THEN 'invalid_json' WHEN length(text) % 3 = 1 THEN 'incomplete_answer_block' ELSE 'other' END AS reason FROM conversations"


def _attempts(spark, sf_dir) -> DataFrame:
    n = F.length("text")
    reason = F.when(n % 5 == 0, None).when(n % 3 == 0, "invalid_json").when(n % 3 == 1, "incomplete_answer_block").otherwise("other")
    return _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("attempt"), (n % 5 == 0).alias("passed"), (n % 2 == 0).alias("parsed"), reason.alias("reason"))


@query(f"""
    SELECT conv_id, CASE WHEN f IS NOT NULL THEN 'pass' WHEN last < 3 THEN 'retrying' WHEN p THEN 'pass_after_max_attempts' ELSE 'invalid' END AS status,
           CASE WHEN f IS NOT NULL THEN f WHEN last >= 3 AND p THEN last END AS selected_attempt, n AS attempt_count
    FROM (SELECT conv_id, min(attempt) FILTER (passed) AS f, max(attempt) AS last, arg_max(parsed, attempt) AS p, count(*) AS n FROM ({_ATTEMPTS}) GROUP BY conv_id)""")
def first_passing_attempt(spark, sf_dir):
    return attempts.selected_attempts(_attempts(spark, sf_dir), ["conv_id"])


_FEEDBACK = "CASE lag(reason) OVER (PARTITION BY conv_id ORDER BY attempt) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in answers.CHECKLIST_FEEDBACK.items()) + " END"


@query(f"SELECT conv_id, attempt, {_FEEDBACK} AS previous_feedback FROM ({_ATTEMPTS})")
def feedback_lag(spark, sf_dir):
    return attempts.with_feedback(_attempts(spark, sf_dir), "checklist", ["conv_id"]).select("conv_id", "attempt", "previous_feedback")


@query(f"SELECT reason, count(*) AS attempts FROM ({_ATTEMPTS}) WHERE reason IS NOT NULL GROUP BY 1")
def retry_reason_histogram(spark, sf_dir):
    return scoring.reason_histogram(_attempts(spark, sf_dir))


@query("""
    WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND event_id > coalesce(o, -1)) AS streak
               FROM (SELECT *, max(event_id) FILTER (event_type IS DISTINCT FROM 'error') OVER (PARTITION BY user_id) AS o FROM events) GROUP BY user_id)
    SELECT user_id, streak, CAST(least(4096, 1024 * pow(2, least(streak, 20))) AS BIGINT) AS max_tokens FROM s""")
def truncation_streak_and_tokens(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("finish_reason", F.when(F.col("event_type") == "error", "length").otherwise("stop"))
    s = attempts.truncation_streaks(e, ["user_id"], "event_id")
    return _long(s.withColumn("max_tokens", attempts.token_budget(1024, F.col("streak"))), "streak", "max_tokens")


@query(f"""
    SELECT count(*) AS attempted_case_count, count(*) FILTER (s = 'pass') AS strict_pass_count, count(*) FILTER (s = 'pass_after_max_attempts') AS accepted_after_max_count,
           count(*) FILTER (s IN ('pass', 'pass_after_max_attempts')) AS scored_case_count, count(*) FILTER (s = 'invalid') AS invalid_case_count, 5000 AS expected_case_count,
           5000 - count(*) FILTER (s IN ('pass', 'pass_after_max_attempts')) AS unscored_case_count, CASE WHEN count(*) = 5000 THEN 'complete' ELSE 'partial' END AS execution_status
    FROM (SELECT CASE WHEN f IS NOT NULL THEN 'pass' WHEN last < 3 THEN 'retrying' WHEN p THEN 'pass_after_max_attempts' ELSE 'invalid' END AS s
          FROM (SELECT conv_id, min(attempt) FILTER (passed) AS f, max(attempt) AS last, arg_max(parsed, attempt) AS p FROM ({_ATTEMPTS}) GROUP BY conv_id))""")
def run_progress(spark, sf_dir):
    return scoring.run_progress(attempts.selected_attempts(_attempts(spark, sf_dir), ["conv_id"]), 5000)


# ------------------------------------------------------------------ alignment and scores


def _pairs(spark, sf_dir) -> DataFrame:
    """Each benchmark text against the next one's words, as token arrays."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("t"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("hypothesis"))
    return b.join(other, "item_id").select("item_id", F.col("t").alias("reference"), "hypothesis")


def _align_sql(extra: str) -> str:
    """Recursive alignment in SQL: a row of cells for each reference token."""
    cell = "{'d': %s, 'g': %s, 's': %s, 'x': %s, 'n': %s}"
    zero = "CAST(0 AS BIGINT)"
    start = cell % ("j", "j", zero, zero, "j")
    diag, up = "v[j]", "v[j + 1]"
    same = cell % (f"{diag}.d", "CAST(-1 AS BIGINT)", f"{diag}.s", f"{diag}.x", f"{diag}.n")
    sub = cell % (f"{diag}.d + 1", f"{diag}.g", f"{diag}.s + 1", f"{diag}.x", f"{diag}.n")
    dele = cell % (f"{up}.d + 1", f"{up}.g + 1", f"{up}.s", f"{up}.x + 1", f"{up}.n")
    ins = cell % ("a[-1].d + 1", "a[-1].g + 1", "a[-1].s", "a[-1].x", "a[-1].n + 1")
    fixed = cell % ("b[1].d", "b[1].x + b[1].n", "b[1].s", "b[1].x", "b[1].n")
    first = cell % ("i + 1", "i + 1", zero, "i + 1", zero)
    return rf"""
        b AS (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS t FROM benchmark),
        p AS (SELECT x.item_id, x.t AS r, y.t AS full_h, y.t[: {extra}] AS h FROM b x JOIN b y ON y.item_id = x.item_id + 1),
        dp AS (SELECT item_id, r, h, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(h) + 1), lambda j: {start}) AS v FROM p
               UNION ALL
               SELECT item_id, r, h, i + 1, list_reduce(list_transform(range(1, len(h) + 1), lambda j: [CASE WHEN r[i + 1] = h[j] THEN {same} ELSE list_min([{sub}, {dele}]) END]),
                      lambda a, b: list_append(a, CASE WHEN b[1].g = -1 THEN {fixed} ELSE list_min([b[1], {ins}]) END), [{first}])
               FROM dp WHERE i < len(r)),
        e AS (SELECT item_id, v[-1] AS c, len(r) AS n, len(h) AS m FROM dp WHERE i = len(r))"""


@query(f"WITH RECURSIVE {_align_sql('len(y.t)')} SELECT item_id, c.d AS distance, c.s AS substitutions, c.x AS deletions, c.n AS insertions FROM e")
def edit_counts_words(spark, sf_dir):
    e = _pairs(spark, sf_dir).select("item_id", edit_counts_udf("reference", "hypothesis").alias("e")).select("item_id", "e.*")
    return _long(e, "distance", "substitutions", "deletions", "insertions")


@query(f"WITH RECURSIVE {_align_sql('len(y.t)')} SELECT item_id, c.d AS distance FROM e")
def edit_distance_coded(spark, sf_dir):
    return token_distance(_pairs(spark, sf_dir), "reference", "hypothesis").select("item_id", F.col("distance").cast("bigint").alias("distance"))


def _score(spark, sf_dir, n: int) -> DataFrame:
    s = scoring.score_pairs(_pairs(spark, sf_dir), n, tokenized=True)
    return s.withColumns({"profile": F.concat(F.lit("p"), F.col("item_id") % 3), "case_id": F.concat(F.element_at(F.array(*map(F.lit, validation.SCENES)), (F.col("item_id") % 5 + 1).cast("int")), F.lit("-"), F.lpad((F.floor(F.col("item_id") / 4)).cast("string"), 4, "0"))})


_CASE_SQL = "cases AS (SELECT 'p' || (item_id % 3) AS profile, (['AD', 'SCI', 'UI', 'CULT', 'LIFE'])[item_id % 5 + 1] AS scene, (['AD', 'SCI', 'UI', 'CULT', 'LIFE'])[item_id % 5 + 1] || '-' || lpad(CAST(item_id // 4 AS VARCHAR), 4, '0') AS case_id, CAST(sum(c.d) AS BIGINT) AS distance, CAST(sum(n) AS BIGINT) AS reference_token_count FROM e GROUP BY 1, 2, 3)"
_R5 = "len(x.t) + 5"


@query(f"WITH RECURSIVE {_align_sql(_R5)} SELECT item_id, c.d AS distance, round(CAST(c.d AS DOUBLE) / n, 9) AS raw_wer, round(least(1.0, CAST(c.d AS DOUBLE) / n), 9) AS wer, greatest(0, len(full_h) - m) AS truncated_token_count FROM e JOIN p USING (item_id)")
def rplusn_pair_wer(spark, sf_dir):
    s = _score(spark, sf_dir, 5)
    return _long(s.select("item_id", "distance", F.round("raw_wer", 9).alias("raw_wer"), F.round("wer", 9).alias("wer"), "truncated_token_count"), "distance", "truncated_token_count")


@query(f"WITH RECURSIVE {_align_sql(_R5)}, {_CASE_SQL} SELECT profile, case_id, distance, reference_token_count, round(least(1.0, CAST(distance AS DOUBLE) / reference_token_count), 9) AS wer FROM cases")
def rplusn_case_wer(spark, sf_dir):
    c = scoring.score_cases(_score(spark, sf_dir, 5))
    return _long(c.select("profile", "case_id", "distance", "reference_token_count", F.round("wer", 9).alias("wer")), "distance", "reference_token_count")


_LEVEL = "CASE WHEN grouping(profile) = 0 THEN 'by_profile' WHEN grouping(scene) = 0 THEN 'by_scene' ELSE 'overall' END AS level"


@query(f"WITH RECURSIVE {_align_sql(_R5)}, {_CASE_SQL} SELECT profile, scene, {_LEVEL}, count(*) AS scored_videos, round(avg(least(1.0, CAST(distance AS DOUBLE) / reference_token_count)), 9) AS case_balanced_wer FROM cases GROUP BY GROUPING SETS ((), (profile), (scene))")
def case_balanced_wer(spark, sf_dir):
    c = scoring.score_cases(_score(spark, sf_dir, 5)).withColumn("scene", scoring.scene(F.col("case_id")))
    return scoring.balanced_wer(c).withColumn("case_balanced_wer", F.round("case_balanced_wer", 9))


@query(f"WITH RECURSIVE {_align_sql(_R5)}, {_CASE_SQL} SELECT profile, scene, {_LEVEL}, CAST(sum(distance) AS BIGINT) AS distance, CAST(sum(reference_token_count) AS BIGINT) AS reference_token_count, round(sum(distance)::DOUBLE / sum(reference_token_count), 9) AS corpus_wer FROM cases GROUP BY GROUPING SETS ((), (profile), (scene))")
def corpus_wer(spark, sf_dir):
    c = scoring.score_cases(_score(spark, sf_dir, 5)).withColumn("scene", scoring.scene(F.col("case_id")))
    return scoring.corpus_wer(c).withColumn("corpus_wer", F.round("corpus_wer", 9))


_ITEM_SQL = "items AS (SELECT source AS profile, doc_id AS case_id, lang AS scene, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer, (['Entity Presence', 'Spatial Relationship', 'Temporal Consistency', 'Motion Adherence'])[doc_id % 4 + 1] AS dimension FROM documents JOIN labels USING (doc_id))"


def _items(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    dims = F.array(*map(F.lit, validation.DIMENSIONS[:4]))
    return d.select(F.col("source").alias("profile"), F.col("doc_id").alias("case_id"), F.col("lang").alias("scene"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"), F.element_at(dims, (F.col("doc_id") % 4 + 1).cast("int")).alias("dimension"))


@query(f"WITH {_ITEM_SQL} SELECT profile, scene, {_LEVEL}, count(*) FILTER (answer = 'yes') AS yes_count, count(*) AS item_count, round(count(*) FILTER (answer = 'yes')::DOUBLE / count(*), 9) AS yes_rate FROM items GROUP BY GROUPING SETS ((), (profile), (scene))")
def video_score(spark, sf_dir):
    return scoring.video_score(_items(spark, sf_dir)).withColumn("yes_rate", F.round("yes_rate", 9))


@query(f"""
    WITH {_ITEM_SQL}, dims AS (SELECT unnest(['Entity Presence', 'Spatial Relationship', 'Temporal Consistency', 'Motion Adherence', 'Scene Attributes']) AS dimension)
    SELECT p.profile, dims.dimension, count(*) FILTER (answer = 'yes') AS yes_count, count(answer) AS item_count, count(DISTINCT case_id) AS applicable_videos,
           round(CASE WHEN count(answer) > 0 THEN count(*) FILTER (answer = 'yes')::DOUBLE / count(answer) END, 9) AS yes_rate
    FROM (SELECT DISTINCT profile FROM items) p CROSS JOIN dims LEFT JOIN items ON items.profile = p.profile AND items.dimension = dims.dimension GROUP BY 1, 2""")
def video_score_dimensions(spark, sf_dir):
    return scoring.dimension_scores(_items(spark, sf_dir), ["profile"]).withColumn("yes_rate", F.round("yes_rate", 9))


@query(f"WITH {_ITEM_SQL} SELECT profile, count(*) AS checklist_count, count(*) FILTER (answer = 'yes') AS yes_count, count(*) FILTER (answer = 'no') AS no_count, round(count(*) FILTER (answer = 'yes')::DOUBLE / count(*), 9) AS yes_rate FROM items GROUP BY 1")
def checklist_case_scores(spark, sf_dir):
    return scoring.checklist_cases(_items(spark, sf_dir), ["profile"]).withColumn("yes_rate", F.round("yes_rate", 9))


# ------------------------------------------------------------------ finished jobs and workers

_JOBS_SQL = """j AS (SELECT doc_id, source AS profile, lang AS family, CASE WHEN text IS NULL OR length(text) < 200 THEN 'invalid' WHEN doc_id % 5 = 0 THEN 'pass_after_max_attempts' ELSE 'pass' END AS status, CAST(doc_id % 3 + 1 AS INT) AS attempt,
           lower(substr(text, 1, 20)) AS head FROM documents),
         a AS (SELECT *, CASE WHEN status <> 'invalid' THEN attempt END AS selected_attempt, CASE WHEN status <> 'invalid' THEN length(head) END AS n, length(regexp_replace(head, '[^aeiou]', '', 'g')) AS y,
                      CASE WHEN status <> 'invalid' AND ends_with(head, ' ') THEN 1 ELSE 0 END AS repaired FROM j),
         r AS (SELECT unnest(CASE attempt WHEN 1 THEN [] WHEN 2 THEN ['json_error'] ELSE ['json_error', 'max_tokens'] END) AS reason FROM a)"""


def _finished_jobs(spark, sf_dir) -> DataFrame:
    """A job for every document: its first characters are answers, a vowel says yes."""
    status = F.when(F.col("text").isNull() | (F.length("text") < 200), "invalid").when(F.col("doc_id") % 5 == 0, "pass_after_max_attempts").otherwise("pass")
    attempt = (F.col("doc_id") % 3 + 1).cast("int")
    head = F.lower(F.substring("text", 1, 20))
    answers = F.transform(F.split(head, ""), lambda c: F.when(c.isin(*"aeiou"), "yes").otherwise("no"))
    logged = F.when(attempt == 1, F.array().cast("array<string>")).when(attempt == 2, F.array(F.lit("json_error"))).otherwise(F.array(F.lit("json_error"), F.lit("max_tokens")))
    good = status != "invalid"
    return _t(spark, sf_dir, "documents").select(
        F.col("source").alias("profile"), F.col("doc_id").alias("case_id"), F.col("lang").alias("family"), status.alias("status"), F.when(good, attempt).alias("selected_attempt"),
        logged.alias("reasons"), F.when(good, answers).alias("items"), F.coalesce(F.endswith(head, F.lit(" ")), F.lit(False)).alias("repaired"),
    )


@query(f"""
    WITH {_JOBS_SQL},
         items AS (SELECT unnest([{{'d': 'total', 'k': 'all'}}, {{'d': 'profile', 'k': profile}}, {{'d': 'family', 'k': family}}]) AS g, n, y FROM a WHERE n IS NOT NULL),
         sums AS (SELECT g.d AS dimension, g.k AS name, count(*) AS case_count, CAST(sum(n) AS BIGINT) AS checklist_count, CAST(sum(y) AS BIGINT) AS yes_count, CAST(sum(n - y) AS BIGINT) AS no_count FROM items GROUP BY 1, 2),
         long AS (SELECT dimension, name, unnest(['case_count', 'checklist_count', 'yes_count', 'no_count']) AS measure, unnest([case_count, checklist_count, yes_count, no_count]) AS value FROM sums)
    FROM long
    UNION ALL SELECT 'total', 'all', unnest(['attempted', 'valid', 'repaired']), unnest([count(*), count(n), CAST(sum(repaired) AS BIGINT)]) FROM a
    UNION ALL SELECT 'status', status, 'jobs', count(*) FROM a GROUP BY status
    UNION ALL SELECT 'selected_attempt', CAST(selected_attempt AS VARCHAR), 'jobs', count(*) FROM a WHERE selected_attempt IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'reason', reason, 'attempts', count(*) FROM r GROUP BY 2""")
def progress_rollup(spark, sf_dir):
    """Counters of finished jobs, merged from four batches of them."""
    jobs = _finished_jobs(spark, sf_dir)
    return rollups.merged(*[rollups.partials(jobs.where(F.col("case_id") % 4 == k)) for k in range(4)])


_ATTEMPTS_SQL = """t AS (SELECT user_id AS case_id, event_id % 5 AS attempt, CAST(floor(value) AS INT) AS exit_code, event_type IN ('purchase', 'signup') AS delivered, CASE WHEN value > 3 THEN event_type END AS fault, ts FROM events),
         o AS (SELECT *, CASE WHEN delivered THEN 'invalid deliverable after attempt ' || attempt || ': ' || coalesce(fault, '') ELSE 'attempt ' || attempt || ' exited ' || exit_code END AS told FROM t WHERE attempt BETWEEN 1 AND 4),
         l AS (SELECT case_id, min(attempt) FILTER (delivered AND fault IS NULL) AS done, max(attempt) AS last FROM o GROUP BY 1),
         e AS (SELECT case_id, told, ts FROM o JOIN l USING (case_id) WHERE attempt = last QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, told DESC) = 1),
         s AS (SELECT c_custkey AS case_id, c_nationkey AS worker, CASE WHEN s_suppkey IS NOT NULL THEN 'skipped' WHEN done IS NOT NULL THEN 'complete' WHEN last >= 4 THEN 'failed' WHEN last > 0 THEN 'waiting' ELSE 'pending' END AS state,
                      CAST(CASE WHEN s_suppkey IS NOT NULL THEN 0 ELSE coalesce(done, last, 0) END AS INT) AS attempts, told, ts
               FROM customer LEFT JOIN l ON l.case_id = c_custkey LEFT JOIN e ON e.case_id = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey)"""


def _worker_states(spark, sf_dir) -> DataFrame:
    """Customers are jobs, events their attempts; suppliers' numbers are done before."""
    jobs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("worker"))
    delivered = F.col("event_type").isin("purchase", "signup")
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 5).alias("attempt"), F.floor("value").cast("int").alias("exit_code"), delivered.alias("delivered"), F.when(F.col("value") > 3, F.col("event_type")).alias("fault"), F.col("ts").alias("finished_at"))
    return worker.job_states(jobs, log, _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id")), most=4)


@query(f"WITH {_ATTEMPTS_SQL} SELECT case_id, worker, state, attempts, CASE WHEN state IN ('failed', 'waiting') THEN told END AS failure, strftime(CASE WHEN state = 'waiting' THEN ts + to_seconds(least(60, 10 * attempts)) END, '%Y-%m-%d %H:%M:%S.%f') AS due_at FROM s")
def worker_job_states(spark, sf_dir):
    return _worker_states(spark, sf_dir).select("case_id", "worker", "state", "attempts", "failure", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("due_at"))


@query(f"""
    WITH {_ATTEMPTS_SQL}, w AS (SELECT worker, count(*) AS assigned_count, min(case_id) AS first_id, max(case_id) AS last_id, count(*) FILTER (state IN ('skipped', 'complete')) AS completed_count, count(*) FILTER (state = 'failed') AS failed_count, count(*) FILTER (state IN ('waiting', 'pending')) AS open_count FROM s GROUP BY 1)
    SELECT *, CASE WHEN open_count = 0 THEN 'complete' ELSE 'running' END || CASE WHEN failed_count = 0 THEN '' ELSE '_with_failures' END AS state FROM w""")
def worker_reports(spark, sf_dir):
    return worker.worker_report(_worker_states(spark, sf_dir), order="case_id")


# ------------------------------------------------------------------ workflow replay

_TOOL = "CASE event_type WHEN 'view' THEN 'central_turn' WHEN 'click' THEN 'inspect_video' WHEN 'purchase' THEN 'generate_video' WHEN 'signup' THEN 'extract_frames' ELSE 'compare_candidates' END"


@query(f"""
    WITH k AS (SELECT user_id AS case_id, event_id AS seq, {_TOOL} AS tool_name FROM events),
         c AS (SELECT *, CASE WHEN tool_name = 'central_turn' THEN 0 ELSE 1 END AS a, CASE WHEN tool_name = 'extract_frames' THEN 0 ELSE 1 END AS p, CASE WHEN tool_name = 'generate_video' THEN 1 ELSE 0 END AS v FROM k),
         u AS (SELECT *, sum(a) OVER w AS ua, sum(p) OVER w AS up, sum(v) OVER w AS uv FROM c WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
         x AS (SELECT *, CASE WHEN ua > 20 AND a > 0 THEN 'actions' WHEN up > 30 AND p > 0 THEN 'api_calls' WHEN uv > 3 AND v > 0 THEN 'videos' END AS exceeds FROM u)
    SELECT case_id, min(seq) AS seq, arg_min(tool_name, seq) AS tool_name, arg_min(exceeds, seq) AS exceeds FROM x WHERE exceeds IS NOT NULL GROUP BY 1""")
def budget_first_violation(spark, sf_dir):
    calls = _t(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.expr(_TOOL).alias("tool_name"))
    return workflow.first_violation(calls)


_EVENT = "CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'observe' WHEN 'purchase' THEN 'finalize' WHEN 'signup' THEN 'reject' ELSE 'rollback' END"
_CANDIDATE = "concat(CASE WHEN event_id % 2 = 0 THEN 'img' ELSE 'vid' END, '-', lpad(CAST(event_id % 7 + 1 AS VARCHAR), 4, '0'))"


def _candidate_events(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"),
        F.col("event_id").alias("seq"),
        F.expr(_CANDIDATE.replace("VARCHAR", "STRING")).alias("candidate_id"),
        F.when(F.col("event_id") % 2 == 0, "image").otherwise("video").alias("kind"),
        F.expr(_EVENT).alias("event"),
        (F.floor("value").cast("bigint") % 4).cast("int").alias("severity"),
    )


_CANDIDATE_SQL = f"ce AS (SELECT user_id AS case_id, event_id AS seq, {_CANDIDATE} AS candidate_id, CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'video' END AS kind, {_EVENT} AS event, CAST(floor(value) AS BIGINT) % 4 AS severity FROM events)"


def _fold_sql(events: str, select: str) -> str:
    """A recursive fold: a run's events are taken in one by one, and what is known of its
    candidates (kind and status by id) is carried along.  ``events`` makes the table ce."""
    return f"""
    WITH RECURSIVE {events},
         e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq, place) AS k FROM ce),
         fold AS (
            SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS candidate_id, CAST(NULL AS VARCHAR) AS fault, CAST(NULL AS VARCHAR) AS selected,
                   CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(kind VARCHAR, status VARCHAR, parent_id VARCHAR, seen BIGINT))) AS held FROM e
            UNION ALL
            SELECT case_id, k, seq, place, candidate_id, fault, CASE WHEN fault IS NULL AND event = 'finalize' THEN candidate_id ELSE selected END AS selected,
                   CASE WHEN fault IS NOT NULL THEN held
                        WHEN event = 'add' THEN map_concat(held, MAP {{candidate_id: {{'kind': kind, 'status': 'active', 'parent_id': parent_id, 'seen': CAST(0 AS BIGINT)}}}})
                        WHEN event = 'observe' THEN map_concat(held, MAP {{candidate_id: {{'kind': own.kind, 'status': own.status, 'parent_id': own.parent_id, 'seen': own.seen + 1}}}})
                        WHEN event = 'reject' THEN map_concat(held, MAP {{candidate_id: {{'kind': own.kind, 'status': 'rejected', 'parent_id': own.parent_id, 'seen': own.seen}}}})
                        WHEN event = 'rollback' THEN map_concat(held, MAP {{candidate_id: {{'kind': own.kind, 'status': 'rolled_back', 'parent_id': own.parent_id, 'seen': own.seen}}}})
                        WHEN event = 'finalize' THEN map_concat(
                            CASE WHEN held[selected].status = 'finalized' THEN map_concat(held, MAP {{selected: {{'kind': held[selected].kind, 'status': 'active', 'parent_id': held[selected].parent_id, 'seen': held[selected].seen}}}}) ELSE held END,
                            MAP {{candidate_id: {{'kind': own.kind, 'status': 'finalized', 'parent_id': own.parent_id, 'seen': own.seen}}}})
                        ELSE held END AS held
            FROM (SELECT *, CASE WHEN event = 'add' AND own IS NOT NULL THEN 'exists'
                                 WHEN event = 'add' AND parent_id IS NOT NULL AND held[parent_id] IS NULL THEN 'unknown_parent'
                                 WHEN event IN ('observe', 'reject', 'rollback', 'finalize') AND own IS NULL THEN 'unknown'
                                 WHEN event = 'finalize' AND own.kind <> 'video' THEN 'not_a_video'
                                 WHEN event = 'finalize' AND own.status IN ('rejected', 'rolled_back') THEN 'gone' END AS fault
                  FROM (SELECT e.*, f.selected, f.held, f.held[e.candidate_id] AS own FROM fold f JOIN e ON e.case_id = f.case_id AND e.k = f.k + 1))),
         ends AS (SELECT case_id, arg_max(held, k) AS held, arg_max(selected, k) FILTER (selected IS NOT NULL) AS selected, count(fault) AS refused FROM fold GROUP BY case_id),
         states AS (SELECT case_id, refused, selected, i.key AS candidate_id, i.value.status AS state, i.value.kind AS kind, i.value.parent_id AS parent_id, i.value.seen AS observations
                    FROM (SELECT *, unnest(map_entries(held)) AS i FROM ends))
    {select}"""


_PLAIN_EVENTS = f"{_CANDIDATE_SQL.replace('ce AS (SELECT', 'ce AS (SELECT 0 AS place, CAST(NULL AS VARCHAR) AS parent_id,')}"
#: The same events, of which some additions name a parent: a key frame that may not be there.
_PARENT = "CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN concat('img-', lpad(CAST(event_id % 5 + 1 AS VARCHAR), 4, '0')) END"
_LINEAGE_EVENTS = _PLAIN_EVENTS.replace("CAST(NULL AS VARCHAR) AS parent_id", f"{_PARENT} AS parent_id")


def _lineage_events(spark, sf_dir) -> DataFrame:
    parents = _t(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.expr(_PARENT.replace("VARCHAR", "STRING")).alias("parent_id"))
    return _candidate_events(spark, sf_dir).join(parents, ["case_id", "seq"])


@query(_fold_sql(_PLAIN_EVENTS, "SELECT case_id, candidate_id, state FROM states"))
def candidate_status_fold(spark, sf_dir):
    return candidates.candidate_states(_candidate_events(spark, sf_dir)).select("case_id", "candidate_id", "state")


@query(_fold_sql(_LINEAGE_EVENTS, "SELECT case_id, candidate_id, state, kind, parent_id, observations FROM states"))
def candidate_lineage(spark, sf_dir):
    return candidates.candidate_states(_lineage_events(spark, sf_dir))


@query(_fold_sql(_LINEAGE_EVENTS, "SELECT case_id, selected AS final_candidate_id, selected IS NOT NULL AS completed, refused FROM ends"))
def run_selections(spark, sf_dir):
    return candidates.selections(_lineage_events(spark, sf_dir))


@query(f"WITH {_CANDIDATE_SQL} SELECT case_id, printf('img-%04d', coalesce(max(CAST(substr(candidate_id, 5) AS INT)) FILTER (kind = 'image'), 0) + 1) AS next_image, printf('vid-%04d', coalesce(max(CAST(substr(candidate_id, 5) AS INT)) FILTER (kind = 'video'), 0) + 1) AS next_video FROM ce GROUP BY 1")
def next_candidate_id(spark, sf_dir):
    return workflow.next_ids(_candidate_events(spark, sf_dir))


@query(f"""
    WITH {_CANDIDATE_SQL}, c AS (SELECT DISTINCT case_id, candidate_id FROM ce),
         o AS (SELECT case_id, candidate_id, avg(severity) AS m, max(severity) AS w, count(*) AS n FROM ce WHERE event = 'observe' GROUP BY 1, 2),
         s AS (SELECT case_id, candidate_id, coalesce(m, 10.0) AS m, coalesce(w, 3) AS w, coalesce(n, 0) AS n FROM c LEFT JOIN o USING (case_id, candidate_id))
    SELECT case_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m, w, n DESC, candidate_id) AS k FROM s) WHERE k = 1""")
def severity_rank(spark, sf_dir):
    e = _candidate_events(spark, sf_dir)
    return workflow.least_severe(workflow.severity_scores(e.select("case_id", "candidate_id").distinct(), e.where("event = 'observe'").select("case_id", "candidate_id", "severity")))


def _comparisons(e: DataFrame) -> DataFrame:
    """Logged comparisons: a preferred id that may not be eligible, and a ranking."""
    name = lambda k: F.concat(F.lit("vid-"), F.lpad(((F.col("seq") + k) % 7 + 1).cast("string"), 4, "0"))
    return e.where("event = 'rollback'").select("case_id", "seq", F.lit("complete").alias("status"), name(0).alias("preferred_candidate_id"), F.array(name(2), name(5)).alias("ranking"))


_RESCUE_SQL = f"""
    WITH {_CANDIDATE_SQL},
         c AS (SELECT DISTINCT case_id, candidate_id FROM ce WHERE kind = 'video' AND event IN ('add', 'finalize')),
         o AS (SELECT case_id, candidate_id, avg(severity) AS m, max(severity) AS w, count(*) AS n FROM ce WHERE event = 'observe' GROUP BY 1, 2),
         s AS (SELECT case_id, candidate_id, coalesce(m, 10.0) AS m, coalesce(w, 3) AS w, coalesce(n, 0) AS n FROM c LEFT JOIN o USING (case_id, candidate_id)),
         mild AS (SELECT case_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m, w, n DESC, candidate_id) AS k FROM s) WHERE k = 1),
         l AS (SELECT case_id, seq, pos, printf('vid-%04d', (seq + (CASE pos WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END)) % 7 + 1) AS candidate_id FROM (SELECT case_id, seq, unnest([0, 1, 2]) AS pos FROM ce WHERE event = 'rollback')),
         liked AS (SELECT case_id, candidate_id FROM (SELECT l.*, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC, pos) AS k FROM l JOIN c USING (case_id, candidate_id)) WHERE k = 1)
    SELECT mild.case_id, coalesce(liked.candidate_id, mild.candidate_id) AS candidate_id, CASE WHEN liked.case_id IS NOT NULL THEN 'preference' ELSE 'severity' END AS chosen_by FROM mild LEFT JOIN liked USING (case_id)"""


@query(_RESCUE_SQL)
def rescue_selection(spark, sf_dir):
    e = _candidate_events(spark, sf_dir)
    candidates = e.where("kind = 'video' AND event IN ('add', 'finalize')").select("case_id", "candidate_id", "kind", F.lit("active").alias("status")).distinct()
    return workflow.rescue(candidates, e.where("event = 'observe'").select("case_id", "candidate_id", "severity"), _comparisons(e))


@query(_fold_sql(_LINEAGE_EVENTS, "SELECT case_id, seq, fault FROM fold WHERE k > 0"))
def candidate_event_faults(spark, sf_dir):
    return candidates.event_faults(_lineage_events(spark, sf_dir)).select("case_id", "seq", "fault")


_RUN_TOOL = "CASE event_type WHEN 'view' THEN 'central_turn' WHEN 'click' THEN 'inspect_video' WHEN 'purchase' THEN 'generate_video' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'extract_frames' ELSE 'finalize_candidate' END ELSE 'compare_candidates' END"


@query(f"""
    WITH k AS (SELECT user_id * 4 + event_id % 4 AS case_id, event_id AS seq, {_RUN_TOOL} AS tool_name, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'failed' END AS status FROM events),
         c AS (SELECT *, CASE WHEN tool_name = 'central_turn' THEN 0 ELSE 1 END AS a, CASE WHEN tool_name IN ('extract_frames', 'finalize_candidate') THEN 0 ELSE 1 END AS p, CASE WHEN tool_name = 'generate_video' THEN 1 ELSE 0 END AS v FROM k),
         u AS (SELECT *, sum(a) OVER w AS ua, sum(p) OVER w AS up, sum(v) OVER w AS uv FROM c WINDOW w AS (PARTITION BY case_id ORDER BY seq)),
         x AS (SELECT *, CASE WHEN ua > 20 AND a > 0 THEN 'action budget exhausted' WHEN up > 30 AND p > 0 THEN 'API-call budget exhausted' WHEN uv > 3 AND v > 0 THEN 'video-generation budget exhausted' END AS refusal, tool_name = 'finalize_candidate' AND status = 'complete' AS done FROM u),
         e AS (SELECT case_id, min(seq) FILTER (refusal IS NOT NULL OR done) AS stop FROM x GROUP BY 1),
         r AS (SELECT x.* FROM x JOIN e ON x.case_id = e.case_id AND (e.stop IS NULL OR x.seq <= e.stop)),
         t AS (SELECT case_id, count(*) FILTER (refusal IS NULL AND tool_name <> 'central_turn') AS calls, CAST(coalesce(sum(a) FILTER (refusal IS NULL), 0) AS BIGINT) AS used_actions, CAST(coalesce(sum(p) FILTER (refusal IS NULL), 0) AS BIGINT) AS used_api_calls,
                      CAST(coalesce(sum(v) FILTER (refusal IS NULL), 0) AS BIGINT) AS used_videos, bool_or(done AND refusal IS NULL) AS completed, max(refusal) AS refusal, arg_max(tool_name, seq) AS final FROM r GROUP BY 1)
    SELECT case_id, calls, used_actions, used_api_calls, used_videos, completed, greatest(0, 20 - used_actions) AS remaining_actions, greatest(0, 30 - used_api_calls) AS remaining_api_calls, greatest(0, 3 - used_videos) AS remaining_videos,
           coalesce(refusal, CASE WHEN NOT completed AND final = 'central_turn' THEN 'Central agent returned no tool call' END) AS rescue_reason FROM t""")
def run_replay(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    calls = e.select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("case_id"), F.col("event_id").alias("seq"), F.expr(_RUN_TOOL).alias("tool_name"), F.when(F.col("event_id") % 3 == 0, "complete").otherwise("failed").alias("status"))
    out = workflow.replayed(calls)
    return _long(out, "calls", *[f"{k}_{n}" for k in ("used", "remaining") for n in workflow.LIMITS])


@query(f"""
    WITH {_CANDIDATE_SQL},
         c AS (SELECT DISTINCT case_id, candidate_id, CASE WHEN case_id % 5 = 0 THEN 'image' ELSE 'video' END AS kind, CASE WHEN seen % 3 = 0 THEN 'rejected' ELSE 'active' END AS status FROM (SELECT case_id, candidate_id, min(seq) AS seen FROM ce GROUP BY 1, 2)),
         f AS (SELECT case_id, kind, min(candidate_id) AS chosen FROM c WHERE status = 'active' GROUP BY 1, 2)
    SELECT c.case_id, c.candidate_id, CASE WHEN c.kind = 'video' AND c.status = 'active' THEN CASE WHEN c.candidate_id = f.chosen THEN 'finalized' ELSE 'rolled_back' END ELSE c.status END AS status
    FROM c LEFT JOIN f ON f.case_id = c.case_id AND f.kind = 'video'""")
def rescue_roll_back(spark, sf_dir):
    """Runs without observations or comparisons: the first id is the mildest."""
    e = _candidate_events(spark, sf_dir).groupBy("case_id", "candidate_id").agg(F.min("seq").alias("seen"))
    kind, status = F.when(F.col("case_id") % 5 == 0, "image").otherwise("video"), F.when(F.col("seen") % 3 == 0, "rejected").otherwise("active")
    c = e.select("case_id", "candidate_id", kind.alias("kind"), status.alias("status"))
    seen = c.select("case_id", "candidate_id", F.lit(0).alias("severity")).limit(0)
    calls = c.select("case_id", F.lit(0).alias("seq"), "status", F.col("candidate_id").alias("preferred_candidate_id"), F.array("candidate_id").alias("ranking")).limit(0)
    return workflow.rescued(c, workflow.rescue_plans(c, seen, calls)).select("case_id", "candidate_id", "status")


_RESCUE_CHAIN_SQL = _fold_sql(_LINEAGE_EVENTS, """, seen AS (SELECT f.case_id, f.candidate_id, avg(severity) AS m, max(severity) AS w, count(*) AS n FROM fold f JOIN ce USING (case_id, seq) WHERE f.fault IS NULL AND ce.event = 'observe' GROUP BY ALL),
         fit AS (SELECT s.case_id, s.candidate_id, s.kind, coalesce(m, 10.0) AS m, coalesce(w, 3) AS w, coalesce(n, 0) AS n FROM states s LEFT JOIN seen USING (case_id, candidate_id) WHERE state = 'active'),
         listed AS (SELECT case_id, seq, pos, printf('vid-%04d', (seq + (CASE pos WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END)) % 7 + 1) AS candidate_id FROM (SELECT case_id, seq, unnest([0, 1, 2]) AS pos FROM ce WHERE event = 'rollback')),
         best AS (SELECT case_id, kind, candidate_id FROM (SELECT f.*, row_number() OVER (PARTITION BY f.case_id, f.kind ORDER BY l.seq DESC NULLS LAST, l.pos, m, w, n DESC, f.candidate_id) AS k FROM fit f LEFT JOIN listed l USING (case_id, candidate_id)) WHERE k = 1)
    SELECT c_custkey AS case_id, CASE WHEN v.case_id IS NOT NULL THEN 'video' WHEN i.case_id IS NOT NULL THEN 'image' ELSE 'prompt' END AS start, coalesce(v.candidate_id, i.candidate_id) AS candidate_id,
           coalesce((SELECT string_agg(f.candidate_id, ',' ORDER BY f.candidate_id) FROM fit f WHERE f.case_id = c_custkey AND f.kind = 'video' AND f.candidate_id IS DISTINCT FROM v.candidate_id), '') AS rolled_back
    FROM customer LEFT JOIN (FROM best WHERE kind = 'video') v ON v.case_id = c_custkey LEFT JOIN (FROM best WHERE kind = 'image') i ON i.case_id = c_custkey""")


@query(_RESCUE_CHAIN_SQL)
def rescue_chain(spark, sf_dir):
    """Rescue of a run for every customer, most of which have no candidate at all."""
    e = _lineage_events(spark, sf_dir)
    held = checkpointed(candidates.candidate_states(e).select("case_id", "candidate_id", "kind", F.col("state").alias("status")))
    looked = candidates.event_faults(e).where("fault IS NULL AND event = 'observe'").select("case_id", "seq", "candidate_id")
    seen = looked.join(e.select("case_id", "seq", "severity"), ["case_id", "seq"])
    runs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    plans = workflow.rescue_plans(held, seen, _comparisons(e), runs=runs)
    return plans.select("case_id", "start", "candidate_id", F.array_join("rolled_back", ",").alias("rolled_back"))


#: Logged calls whose ids are few, so that they meet: what they make, look at and roll back.
_RUN_CALL = "CASE event_type WHEN 'view' THEN 'generate_keyframes' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'edit_keyframe' ELSE 'inspect_video' END WHEN 'purchase' THEN 'generate_video' WHEN 'signup' THEN 'finalize_candidate' ELSE 'compare_candidates' END"


def _numbered(prefix: str, shift: int, of: int) -> str:
    return f"concat('{prefix}-', CAST((event_id + {shift}) % {of} + 1 AS VARCHAR))"


_RUN_CALL_ARGUMENTS = f"""CASE tool_name
    WHEN 'generate_keyframes' THEN concat('{{"parent_id":"', CASE WHEN event_id % 5 = 0 THEN {_numbered('img', 1, 4)} ELSE '' END, '","rollback_candidate_ids":[', CASE WHEN event_id % 11 = 0 THEN concat('"', {_numbered('img', 0, 3)}, '"') ELSE '' END, ']}}')
    WHEN 'edit_keyframe' THEN concat('{{"candidate_id":"', {_numbered('img', 0, 4)}, '"}}')
    WHEN 'inspect_video' THEN concat('{{"candidate_id":"', {_numbered('vid', 0, 5)}, '"}}')
    WHEN 'generate_video' THEN concat('{{"keyframe_id":"', {_numbered('img', 0, 4)}, '","parent_video_id":"', CASE WHEN event_id % 3 = 0 THEN {_numbered('vid', 3, 5)} ELSE '' END, '","rollback_candidate_ids":[', CASE WHEN event_id % 4 = 0 THEN concat('"', {_numbered('vid', 2, 5)}, '"') ELSE '' END, ']}}')
    WHEN 'finalize_candidate' THEN concat('{{"candidate_id":"', {_numbered('vid', 0, 5)}, '","rollback_candidate_ids":[', CASE WHEN event_id % 3 = 0 THEN concat('"', {_numbered('vid', 1, 5)}, '"') ELSE '' END, ']}}')
    ELSE '{{}}' END"""
_RUN_CALL_RESULT = f"""CASE tool_name WHEN 'generate_keyframes' THEN concat('{{"candidate_ids":["', {_numbered('img', 0, 4)}, '"]}}') WHEN 'edit_keyframe' THEN concat('{{"candidate_ids":["', {_numbered('img', 0, 6)}, '"]}}')
    WHEN 'generate_video' THEN concat('{{"candidate_ids":["', {_numbered('vid', 0, 5)}, '"]}}') ELSE '{{}}' END"""


def _run_call_events() -> str:
    """The same calls' effects, written out event by event."""
    one = lambda place, event, name, kind="NULL", parent="NULL", when="TRUE": f"SELECT user_id AS case_id, event_id AS seq, {place} AS place, '{event}' AS event, {name} AS candidate_id, CAST({kind} AS VARCHAR) AS kind, CAST({parent} AS VARCHAR) AS parent_id FROM t WHERE {when}"
    tool = lambda name, more="TRUE": f"tool = '{name}' AND {more}"
    rows = [
        one(0, "add", _numbered("img", 0, 4), "'image'", f"CASE WHEN event_id % 5 = 0 THEN {_numbered('img', 1, 4)} END", tool("generate_keyframes")),
        one(1, "rollback", _numbered("img", 0, 3), when=tool("generate_keyframes", "event_id % 11 = 0")),
        one(0, "add", _numbered("img", 0, 6), "'image'", _numbered("img", 0, 4), tool("edit_keyframe")),
        one(0, "observe", _numbered("vid", 0, 5), "'video'", when=tool("inspect_video")),
        one(0, "add", _numbered("vid", 0, 5), "'video'", f"CASE WHEN event_id % 3 = 0 THEN {_numbered('vid', 3, 5)} ELSE {_numbered('img', 0, 4)} END", tool("generate_video")),
        one(1, "rollback", _numbered("vid", 2, 5), when=tool("generate_video", "event_id % 4 = 0")),
        one(0, "finalize", _numbered("vid", 0, 5), "'video'", when=tool("finalize_candidate")),
        one(1, "rollback", _numbered("vid", 1, 5), when=tool("finalize_candidate", "event_id % 3 = 0")),
    ]
    return f"t AS (SELECT *, {_RUN_CALL} AS tool FROM events WHERE event_id % 7 <> 0), ce AS ({' UNION ALL '.join(rows)})"


@query(_fold_sql(_run_call_events(), "SELECT case_id, candidate_id, state, kind, parent_id, observations FROM states"))
def call_effect_states(spark, sf_dir):
    """Logged calls, their effects as events, and these folded."""
    e = _t(spark, sf_dir, "events").withColumn("tool_name", F.expr(_RUN_CALL))
    told = {n: F.expr(x.replace("VARCHAR", "STRING")) for n, x in (("arguments", _RUN_CALL_ARGUMENTS), ("result", _RUN_CALL_RESULT))}
    calls = e.withColumns(told).select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), "tool_name", *told, F.when(F.col("event_id") % 7 == 0, "failed").otherwise("complete").alias("status"))
    return candidates.candidate_states(tools.call_effects(calls))


# ------------------------------------------------------------------ shards, identities, frames


@query("""
    WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, pos, (SELECT max(i) FROM range(0, 7) t(i) WHERE (n * i) // 7 <= pos) AS shard FROM p""")
def contiguous_shard(spark, sf_dir):
    return _long(partitioning.contiguous_shards(_t(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey"), "shard")


@query("SELECT count(*) AS files, sha256(string_agg(n_name || chr(9) || n_nationkey || chr(9) || sha256(n_name), chr(10) ORDER BY n_name || chr(9) || n_nationkey || chr(9) || sha256(n_name))) AS fingerprint FROM nation")
def run_fingerprint(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return partitioning.run_identity(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("size"), F.sha2("n_name", 256).alias("hash")))


@query("SELECT p_partkey, CAST(p_size + ((5 - p_size) % 17 + 17) % 17 AS BIGINT) AS frames FROM part")
def frame_alignment(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.aligned_frames(F.col("p_size")).cast("bigint").alias("frames"))


# ------------------------------------------------------------------ tokenizers and the whole report


@query()
def tokenize_text(spark, sf_dir):
    d = spread_rows(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.tokens("text").alias("t"))
    kinds = F.transform(F.array_distinct(F.transform("t", lambda x: x["kind"])), lambda k: F.concat(k, F.lit("="), F.size(F.filter("t", lambda x: x["kind"] == k)).cast("string")))
    return d.select("doc_id", F.size("t").alias("tokens"), F.array_join(F.sort_array(kinds), ",").alias("kinds"))


@query()
def legacy_tokenize_text(spark, sf_dir):
    return spread_rows(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(text.legacy_values("text")).alias("tokens"))


def evaluation_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Benchmark texts as targets of cases, and document texts as what a model read.

    Each document is a job of its own with one attempt, a null text a job without
    any; the items are dealt to the documents in turn, by their places in the order
    of item_id, so all items are used once there are as many documents."""
    b = _t(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.col("text").alias("verbatim"))
    items = partitioning.positions(b, "item_id", "verbatim")
    turn = F.pmod(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.lit(max(1, b.count())).cast("bigint"))
    # padded to four digits at least; lpad alone would cut longer numbers to four
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    case_id = F.concat(F.element_at(F.array(*map(F.lit, validation.SCENES)), (F.col("pos") % 5 + 1).cast("int")), F.lit("-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    d = _t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("unknown")).alias("profile"), "doc_id", turn.alias("pos"), "text").withColumn("case_id", case_id)
    targets = d.select("case_id", "pos").distinct().join(items.select("pos", "verbatim"), "pos").select("case_id", F.lit(0).alias("pos"), F.lit("T01").alias("text_id"), "verbatim")
    said = F.to_json(F.struct(F.struct(F.lit("transcribed").alias("status"), F.col("text"), F.lit("").alias("readability_note")).alias("T01")))
    responses = d.where("text IS NOT NULL").select("profile", "case_id", F.lit(1).alias("attempt"), F.concat(F.lit("<answer>"), said, F.lit("</answer>")).alias("raw"), F.lit("stop").alias("finish_reason"), F.lit(1).alias("output_token_count"))
    return d.select("profile", "case_id").distinct(), responses, targets


@query()
def wer_report(spark, sf_dir):
    """The flagship: responses to case-balanced rates for R+1, R+5 and R+10."""
    return reports.wer_report(*evaluation_inputs(spark, sf_dir), most=1)["summary"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wer_report(spark, sf_dir)


# ------------------------------------------------------------------ tool calls and diagnostics

_CALL = """CASE event_type
    WHEN 'view' THEN concat('{"diagnosis":"d","candidate_id":"v","sample_fps":', CAST(event_id % 4 AS VARCHAR), '}')
    WHEN 'click' THEN concat('{"diagnosis":"d","candidate_ids":["a"', CASE WHEN event_id % 2 = 0 THEN ',"b"' ELSE '' END, ']}')
    WHEN 'purchase' THEN concat('{"diagnosis":"', CASE WHEN event_id % 2 = 0 THEN '' ELSE 'd' END, '","keyframe_id":"k","motion_refinement":"', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'pan' END, '"}')
    WHEN 'signup' THEN concat('{"diagnosis":"d","candidate_id":"v","rationale":"r","rollback_candidate_ids":["', CASE WHEN event_id % 3 = 0 THEN 'v' ELSE 'w' END, '","x"]}')
    ELSE '{"diagnosis":"d","generation_prompt":"g","count":5,"more":1}' END"""
_CALL_TOOL = "CASE event_type WHEN 'view' THEN 'inspect_video' WHEN 'click' THEN 'compare_candidates' WHEN 'purchase' THEN 'generate_video' WHEN 'signup' THEN 'finalize_candidate' ELSE 'generate_keyframes' END"


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 4 IN (0, 3) THEN 'sample_fps' ELSE '' END
           WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE 'candidate_ids' END
           WHEN 'purchase' THEN concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'diagnosis' END, CASE WHEN event_id % 3 = 0 THEN 'motion_refinement' END)
           WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'rollback_of_final' ELSE '' END
           ELSE 'unknown_field,count' END AS errors FROM events""")
def tool_argument_faults(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.expr(_CALL_TOOL).alias("tool_name"), F.expr(_CALL.replace("VARCHAR", "STRING")).alias("arguments"))
    return tools.argument_faults(e).select("event_id", F.array_join("errors", ",").alias("errors"))


_EFFECT_TOOL = "CASE event_type WHEN 'view' THEN 'generate_keyframes' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'edit_keyframe' ELSE 'inspect_keyframes' END WHEN 'purchase' THEN 'generate_video' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'compare_candidates' ELSE 'finalize_candidate' END ELSE CASE WHEN event_id % 2 = 0 THEN 'extract_frames' ELSE 'inspect_video' END END"


@query(f"""
    WITH k AS (SELECT user_id AS case_id, event_id AS seq, {_EFFECT_TOOL} AS tool, CAST(event_id AS VARCHAR) AS e FROM events WHERE event_id % 7 <> 0),
         x AS (SELECT case_id, seq, unnest(CASE tool
            WHEN 'generate_keyframes' THEN [{{'place': 0, 'event': 'add', 'candidate_id': 'img-' || e, 'kind': 'image', 'parent_id': NULL}}, {{'place': 1, 'event': 'add', 'candidate_id': 'img-x' || e, 'kind': 'image', 'parent_id': NULL}}, {{'place': 2, 'event': 'rollback', 'candidate_id': 'old', 'kind': NULL, 'parent_id': NULL}}]
            WHEN 'edit_keyframe' THEN [{{'place': 0, 'event': 'add', 'candidate_id': 'img-' || e, 'kind': 'image', 'parent_id': 'img-1'}}]
            WHEN 'inspect_keyframes' THEN [{{'place': 0, 'event': 'observe', 'candidate_id': 'a', 'kind': 'image', 'parent_id': NULL}}, {{'place': 1, 'event': 'observe', 'candidate_id': e, 'kind': 'image', 'parent_id': NULL}}]
            WHEN 'generate_video' THEN [{{'place': 0, 'event': 'add', 'candidate_id': 'vid-' || e, 'kind': 'video', 'parent_id': CASE WHEN seq % 2 = 0 THEN 'vid-1' ELSE 'k' END}}]
            WHEN 'inspect_video' THEN [{{'place': 0, 'event': 'observe', 'candidate_id': 'vid-' || e, 'kind': 'video', 'parent_id': NULL}}]
            WHEN 'compare_candidates' THEN CASE WHEN seq % 3 = 0 THEN [] ELSE [{{'place': 0, 'event': 'prefer', 'candidate_id': e, 'kind': NULL, 'parent_id': NULL}}] END
            WHEN 'finalize_candidate' THEN [{{'place': 0, 'event': 'finalize', 'candidate_id': 'vid-' || e, 'kind': 'video', 'parent_id': NULL}}, {{'place': 1, 'event': 'rollback', 'candidate_id': 'vid-o', 'kind': NULL, 'parent_id': NULL}}]
            ELSE [] END) AS r FROM k)
    SELECT case_id, seq, r.place AS place, r.event AS event, r.candidate_id AS candidate_id, r.kind AS kind, r.parent_id AS parent_id FROM x""")
def tool_effects(spark, sf_dir):
    arguments = """CASE tool_name
        WHEN 'generate_keyframes' THEN '{"parent_id":"","rollback_candidate_ids":["old"]}'
        WHEN 'edit_keyframe' THEN '{"candidate_id":"img-1"}'
        WHEN 'inspect_keyframes' THEN concat('{"candidate_ids":["a","', event_id, '"]}')
        WHEN 'generate_video' THEN CASE WHEN event_id % 2 = 0 THEN '{"keyframe_id":"k","parent_video_id":"vid-1"}' ELSE '{"keyframe_id":"k","rollback_candidate_ids":[]}' END
        WHEN 'finalize_candidate' THEN concat('{"candidate_id":"vid-', event_id, '","rollback_candidate_ids":["vid-o"]}')
        ELSE concat('{"candidate_id":"vid-', event_id, '"}') END"""
    result = """CASE tool_name
        WHEN 'generate_keyframes' THEN concat('{"candidate_ids":["img-', event_id, '","img-x', event_id, '"]}')
        WHEN 'edit_keyframe' THEN concat('{"candidate_ids":["img-', event_id, '"]}')
        WHEN 'generate_video' THEN concat('{"candidate_ids":["vid-', event_id, '"]}')
        WHEN 'compare_candidates' THEN CASE WHEN event_id % 3 = 0 THEN '{"payload":{"preferred_candidate_id":null}}' ELSE concat('{"payload":{"preferred_candidate_id":"', event_id, '"}}') END END"""
    e = _t(spark, sf_dir, "events").withColumn("tool_name", F.expr(_EFFECT_TOOL))
    calls = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), "tool_name", F.expr(arguments).alias("arguments"), F.expr(result).alias("result"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("complete").alias("status"))
    return tools.call_effects(calls)


@query("SELECT doc_id, starts_with(p, '/data/runs/') AND NOT regexp_matches(p, '(^|/)\\.\\.(/|$)') AND lower(p) LIKE '%.mp4' AS ok FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/data/runs/a/' || doc_id || '.mp4' WHEN 1 THEN '/data/runsx/' || doc_id || '.mp4' WHEN 2 THEN '/data/runs/../' || doc_id || '.mp4' WHEN 3 THEN '/data/runs/' || doc_id || '.MP4' ELSE '/data/runs/' || doc_id || '.mov' END AS p FROM documents)")
def output_path_containment(spark, sf_dir):
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    p = F.when(k == 0, F.concat(F.lit("/data/runs/a/"), i, F.lit(".mp4"))).when(k == 1, F.concat(F.lit("/data/runsx/"), i, F.lit(".mp4"))).when(k == 2, F.concat(F.lit("/data/runs/../"), i, F.lit(".mp4"))).when(k == 3, F.concat(F.lit("/data/runs/"), i, F.lit(".MP4"))).otherwise(F.concat(F.lit("/data/runs/"), i, F.lit(".mov")))
    return _t(spark, sf_dir, "documents").select("doc_id", tools.output_ok(p, "/data/runs/").alias("ok"))


@query("""
    SELECT conv_id, turn, role, turn % 4 <> 2 AND turn % 4 <> 3 AS raw_json_parseable, turn % 2 = 0 AND length(text) >= 100 AS max_tokens_exhausted, CAST(0 AS INT) AS parsed_field_warning_count,
           CASE turn % 4 WHEN 3 THEN 'same_character_run_ge_64' WHEN 2 THEN '' END AS unparsed FROM conversations WHERE text IS NOT NULL""")
def response_diagnostics(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("text IS NOT NULL")
    k = F.col("turn") % 4
    raw = F.when(k == 2, "no block").when(k == 3, F.lit("<answer>" + "z" * 80)).otherwise('<answer>{"T01":{"status":"transcribed","text":"shop","readability_note":""}}</answer>')
    r = c.withColumns({"raw": raw, "finish_reason": F.when(F.col("turn") % 2 == 0, "length").otherwise("stop"), "output_token_count": F.length("text")})
    r = r.withColumn("r", answers.transcription("raw", F.array(F.lit("T01")), "finish_reason")).select("conv_id", "turn", "role", "raw", "finish_reason", "output_token_count", "r.*").withColumn("attempt", F.struct("conv_id", "turn", "role"))
    d = diagnostics.response_diagnostics(r, most=100)
    return d.select("attempt.*", "raw_json_parseable", "max_tokens_exhausted", "parsed_field_warning_count", F.array_join("unparsed_warnings", ",").alias("unparsed"))


@query()
def legacy_case_score(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis")), "item_id").withColumnRenamed("text", "reference")
    return diagnostics.legacy_scores(pairs, ("item_id",)).withColumn("wer", F.round("wer", 9))
