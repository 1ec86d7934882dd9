"""Span dump lines projected from the ``conversations`` table, as JSON text.

One trace per conversation: a root, one event span per turn, and under every assistant
turn a model span with a tool span below it. The first turn is ``session_start``, user
turns ``invoke_agent``, assistant turns ``call_llm``, other turns ``call_tool``. Model
spans speak one of two vendor vocabularies by conversation. Conversations divisible by
seven disagree about the model name, those divisible by eleven lack the provider.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENVELOPE = (
    '"dropped":{"attributes":0,"events":0,"links":0},"events":[],"links":[],"kind":"INTERNAL",'
    '"resource":{"attributes":{},"schema_url":""},"schema_version":1,'
    '"scope":{"name":"conversations","schema_url":"","version":""},'
    '"status":{"code":"UNSET","description":""},"trace_flags":1,"trace_state":""'
)


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, line_no, line): the spans as they would stand in a dump."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    rows = turns.join(firsts, "conv_id").selectExpr(
        "conv_id AS c",
        "turn - first_turn + 1 AS n",
        "text",
        "CASE WHEN turn = first_turn THEN 'session_start' WHEN role = 'user' THEN 'invoke_agent' "
        "WHEN role = 'assistant' THEN 'call_llm' ELSE 'call_tool' END AS event_type",
        "lpad(hex(conv_id), 32, '0') AS trace",
        "lpad(hex(conv_id), 8, '0') AS hc",
    )
    quoted = "to_json(array(text))"
    scope = (
        '\'"at.contract":"at-span/1","at.scenario.name":"conversations","at.scenario.version":"1",'
        '"at.run.id":"run","at.run.seed":1,"at.session.id":"SES-\', c, \'","at.session.workflow":"chat",'
        '"at.application.id":"APP-\', c, \'","at.applicant.id":"APN-\', c, \'","session.id":"SES-\', c, \'",\''
    )

    def span(attributes: str, name: str, span_id: str, parent: str, index: str) -> str:
        return (
            f"concat('{{\"attributes\":{{', {attributes}, '}},\"name\":\"{name}\",\"trace_id\":\"', trace, "
            f"'\",\"span_id\":\"', {span_id}, '\",\"parent_span_id\":', {parent}, "
            f"',\"creation_index\":', {index}, ',\"start_time_unix_nano\":', {index}, '000,"
            f"\"end_time_unix_nano\":', {index}, '999,{_ENVELOPE}}}')"
        )

    within = '"at.obj.0.type":"Session","at.obj.0.id":"SES-\', c, \'","at.obj.0.qualifier":"within"'
    concerns = '"at.obj.1.type":"Application","at.obj.1.id":"APP-\', c, \'","at.obj.1.qualifier":"concerns"'
    agent = '"at.obj.2.type":"Agent","at.obj.2.id":"AGT-CHAT","at.obj.2.qualifier":"performed_by"'
    actor = '"at.event.actor.id":"AGT-CHAT","at.event.actor.type":"Agent",'
    event_bodies = f"""
      CASE event_type
      WHEN 'session_start' THEN concat('{within},"at.obj.0.declares":true,"at.obj.0.attr.session_id":"SES-', c,
        '","at.obj.0.attr.workflow_name":"chat",{concerns},"at.obj.1.declares":true,"at.obj.1.attr.amount":', length(text),
        ',"at.obj.2.type":"Agent","at.obj.2.id":"AGT-CHAT","at.obj.2.declares":true,"at.obj.2.attr.role":"intake","at.obj.2.attr.version":"1"',
        ',"at.obj.3.type":"Applicant","at.obj.3.id":"APN-', c, '","at.obj.3.qualifier":"concerns","at.obj.3.declares":true,"at.obj.3.attr.applicant_id":"APN-', c,
        '","at.obj.count":4,"at.o2o.count":1,"at.o2o.0.source":"APP-', c, '","at.o2o.0.target":"APN-', c, '","at.o2o.0.qualifier":"submitted_by"',
        ',"at.event.attr.contract":"at-span/1","at.event.attr.run_id":"run","at.event.attr.scenario_name":"conversations","at.event.attr.scenario_version":"1","at.event.attr.seed":', c)
      WHEN 'invoke_agent' THEN concat('{within},{concerns},{agent},{actor}"at.obj.count":3,"at.o2o.count":0,"at.event.attr.agent_role":"intake","at.event.attr.step_index":', n)
      WHEN 'call_llm' THEN concat('{within},{concerns},{agent},{actor}"at.obj.3.type":"Model","at.obj.3.id":"MDL-', c % 3,
        '","at.obj.3.qualifier":"uses","at.obj.3.declares":true,"at.obj.3.attr.model_id":"MDL-', c % 3,
        '","at.obj.count":4,"at.o2o.count":0,"at.event.attr.max_tokens":256,"at.event.attr.model_seed":', c,
        ',"at.event.attr.purpose":', substring({quoted}, 2, length({quoted}) - 2), ',"at.event.attr.temperature":0.5')
      ELSE concat('{within},{concerns},{agent},{actor}"at.obj.count":3,"at.o2o.count":0,"at.event.attr.status":"ok","at.event.attr.tool_call_id":"T', n, '"')
      END"""
    event_time = "date_format(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(c AS INT), CAST(n AS INT)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    event_attrs = (
        f"{scope}, '\"at.span.role\":\"event\",\"at.event.type\":\"', event_type, "
        f"'\",\"at.event.id\":\"EV-', c, '-', n, '\",\"at.event.seq\":', n, "
        f"',\"at.event.time\":\"', {event_time}, '\",', {event_bodies}"
    )
    model_attrs = """CASE WHEN c % 2 = 0 THEN concat('"openinference.span.kind":"LLM","session.id":"SES-', c,
        '","llm.model_name":"m', c % 3, '","llm.token_count.prompt":', length(text), ',"llm.token_count.completion":', n,
        ',"llm.invocation_parameters":"{\\\\"temperature\\\\":0.5,\\\\"max_tokens\\\\":256}","input.value":"x","vendor.extra":true',
        IF(c % 11 = 0, '', ',"llm.provider":"p"'), IF(c % 7 = 0, ',"gen_ai.request.model":"other"', ''))
      ELSE concat('"gen_ai.operation.name":"chat","gen_ai.conversation.id":"SES-', c,
        '","gen_ai.request.model":"m', c % 3, '","gen_ai.usage.input_tokens":', length(text), ',"gen_ai.usage.output_tokens":', n,
        ',"gen_ai.request.temperature":0.5,"gen_ai.request.max_tokens":256,"gen_ai.response.id":"r"',
        IF(c % 11 = 0, '', ',"gen_ai.provider.name":"p"'), IF(c % 7 = 0, ',"llm.model_name":"other"', '')) END"""
    tool_attrs = """'"gen_ai.operation.name":"execute_tool","tool.name":"lookup","session.id":"SES-', c, '"'"""
    id_of = lambda kind: f"concat('{kind}', hc, lpad(hex(n), 7, '0'))"
    ref = lambda inner: f"concat('\"', {inner}, '\"')"
    root_attrs = f"{scope}, '\"at.span.role\":\"session_root\"'"
    lines = rows.selectExpr(
        "c",
        "n",
        f"""inline(filter(array(
          named_struct('p', 0, 'line', IF(n = 1, {span(root_attrs, 'root', "concat('a', hc, '0000000')", "'null'", "'1'")}, NULL)),
          named_struct('p', 1, 'line', {span(event_attrs, 'event', id_of('e'), ref("concat('a', hc, '0000000')"), '(3 * n - 1)')}),
          named_struct('p', 2, 'line', IF(event_type = 'call_llm', {span(model_attrs, 'model', id_of('b'), ref(id_of('e')), '(3 * n)')}, NULL)),
          named_struct('p', 3, 'line', IF(event_type = 'call_llm', {span(tool_attrs, 'tool', id_of('d'), ref(id_of('b')), '(3 * n + 1)')}, NULL))
        ), s -> s.line IS NOT NULL))""",
    )
    return lines.selectExpr(
        "concat('SES-', c, '.jsonl') AS source_file", "3 * n + p AS line_no", "line"
    )
