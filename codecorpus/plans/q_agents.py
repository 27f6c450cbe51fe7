"""Agent plan / routing / report queries (S12, S13, J-6, J-7, J-8, W5, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codecorpus import dims
from codecorpus.operators import agents
from codecorpus.plans.registry import query

_ROUTABLE = "(" + ", ".join(f"'{a}'" for a in agents.ROUTABLE) + ")"

# DuckDB: strict JSON between the first '[' and the last ']'
_STEPS_SQL = """(SELECT run_id, task, CASE WHEN a > 0 AND b > a AND json_valid(substring(plan_output, a, b - a + 1))
    AND json_type(substring(plan_output, a, b - a + 1)) = 'ARRAY'
    THEN CAST(json(substring(plan_output, a, b - a + 1)) AS JSON[]) ELSE [] END AS steps
  FROM (SELECT run_id, task, plan_output, instr(plan_output, '[') AS a,
          length(plan_output) - instr(reverse(plan_output), ']') + 1 AS b FROM v_plans) p)"""

_EXPLODED_SQL = f"""(SELECT run_id, CAST(i AS INTEGER) AS step,
   CASE WHEN fb THEN 'coder' WHEN json_exists(el, '$.agent') THEN json_extract_string(el, '$.agent') ELSE 'coder' END AS agent,
   CASE WHEN fb THEN task WHEN json_exists(el, '$.task') THEN json_extract_string(el, '$.task') ELSE task END AS task
 FROM (SELECT run_id, task, len(steps) = 0 AS fb,
         unnest(CASE WHEN len(steps) = 0 THEN [NULL::JSON] ELSE steps END) AS el,
         unnest(generate_series(1, greatest(len(steps), 1))) AS i FROM {_STEPS_SQL} s) x
 WHERE i <= {dims.MAX_AGENT_STEPS})"""


@query("plan_steps", ["v_plans"], sql=f"SELECT run_id, step, agent, task FROM {_EXPLODED_SQL} e")
def q_plan_steps(spark):
    """S12 + S13: parsed plan steps per run (fallback coder step, 5-step cap)."""
    return agents.plan_steps(spark.table("v_plans"))


@query("route_steps", ["v_plans"], sql=f"""
SELECT run_id, step, agent, CASE WHEN agent IN {_ROUTABLE} THEN agent ELSE 'coder' END AS routed_agent
FROM {_EXPLODED_SQL} e""")
def q_route_steps(spark):
    """J-7: each step routed to its agent; unknown names run as the coder."""
    return agents.route_steps(agents.plan_steps(spark.table("v_plans"))).select(
        "run_id", "step", "agent", "routed_agent")


@query("route_single", ["v_plans"], sql=f"""
SELECT run_id, step, agent, coalesce(agent IN {_ROUTABLE}, false) AS accepted FROM {_EXPLODED_SQL} e""")
def q_route_single(spark):
    """J-8: direct runs of each planned agent name; unknown names are rejected."""
    return agents.route_single(agents.plan_steps(spark.table("v_plans"))).select(
        "run_id", "step", "agent", "accepted")


@query("route_messages", ["v_agent_results"], sql=f"""
SELECT run_id, step, agent_name AS sender, 'all' AS recipient, 'result' AS message_type, unnest([{', '.join(repr(a) for a in agents.ROUTABLE)}]) AS delivered_to
FROM v_agent_results""")
def q_route_messages(spark):
    """J-6: result broadcasts delivered to every routable agent (planner excluded)."""
    m = agents.result_messages(spark.table("v_agent_results"))
    return agents.route_messages(m).select("run_id", "step", "sender", "recipient", "message_type", "delivered_to")


_RECIPIENT = """CASE (run_id + step) % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'tester' WHEN 2 THEN 'planner'
  WHEN 3 THEN 'nobody' ELSE agent_name END"""


@query("route_addressed_messages", ["v_agent_results"], sql=f"""
SELECT m.run_id, m.step, m.sender, m.recipient, a.agent AS delivered_to
FROM (SELECT run_id, step, agent_name AS sender, {_RECIPIENT} AS recipient FROM v_agent_results) m
JOIN (SELECT unnest([{', '.join(repr(a) for a in agents.ROUTABLE)}]) AS agent) a
  ON m.recipient = a.agent OR m.recipient = 'all'""")
def q_route_addressed(spark):
    """J-6: messages to all, to one agent, to the planner (which has no inbox) and to a name that nobody has."""
    m = agents.result_messages(spark.table("v_agent_results"), F.expr(_RECIPIENT))
    return agents.route_messages(m).select("run_id", "step", "sender", "recipient", "delivered_to")


@query("previous_results", ["v_agent_results"], sql="""
SELECT run_id, step, agent_name, CAST(count(*) OVER w AS INTEGER) AS n_previous,
  md5(coalesce(string_agg(CAST(step AS VARCHAR) || ':' || agent_name || ':' || output, chr(10)) OVER w, '')) AS previous_md5
FROM v_agent_results WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_previous_results(spark):
    """What each step sees of the earlier steps of its run."""
    p = agents.previous_results(spark.table("v_agent_results"))
    return p.select("run_id", "step", "agent_name", F.size("previous").alias("n_previous"),
                    F.md5(F.array_join(F.transform("previous", lambda x: F.concat_ws(
                        ":", x["step"].cast("string"), x["agent_name"], x["output"])), "\n")).alias("previous_md5"))


@query("run_report", ["v_agent_results", "v_plans"], sql=f"""
SELECT r.run_id, count(*) AS n_results,
  '# Multi-Agent Report' || chr(10) || chr(10) || '**Task:** ' || p.task || chr(10) || chr(10) || '**Agents involved:** '
  || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) || '---' || chr(10)
  || string_agg(chr(10) || '## ' || CASE WHEN success THEN '✅' ELSE '❌' END || ' ' || upper(agent_name) || ' Agent'
       || chr(10) || chr(10) || CASE WHEN success THEN output ELSE '*Error: ' || error || '*' END, chr(10) ORDER BY step)
  || chr(10) || '{agents.REPORT_FOOTER.replace(chr(10), "' || chr(10) || '")}' AS report
FROM v_agent_results r JOIN v_plans p ON p.run_id = r.run_id GROUP BY r.run_id, p.task""")
def q_run_report(spark):
    """The Markdown report of every run."""
    return agents.run_report(spark.table("v_agent_results"), spark.table("v_plans"))
