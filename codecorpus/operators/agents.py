"""Multi-agent plan / result / message tables (S12, S13, J-6..J-8, W5, A7).

Runs are independent, so everything is per ``run_id``: plans are parsed
row-wise, steps exploded, routing is a lookup against the constant agents
dimension (an array literal / ``isin`` -- no join at all), and the report is
a string aggregation over at most ``max_agents`` steps per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus import dims

ROUTABLE = [a for a, _ in dims.AGENTS if a != dims.PLANNER]
REPORT_FOOTER = "\n---\n*Generated by the codecorpus multi-agent report*"


def parse_plan(plan_output: Column) -> Column:
    """Text from the first '[' to the last ']' parsed as strict JSON;
    anything else -> empty list. Element keys may be missing (NULL + flag)."""
    from codecorpus.functions.udfs import json_steps
    first, last = F.instr(plan_output, "["), F.length(plan_output) - F.instr(F.reverse(plan_output), "]") + 1
    found = (first > 0) & plan_output.contains("]") & (last >= first)
    return json_steps(F.when(found, F.substring(plan_output, first, last - first + 1)))


def plan_steps(plans: DataFrame, max_agents: int = dims.MAX_AGENT_STEPS) -> DataFrame:
    """Ordered steps; defaults only for *missing* keys (agent -> coder,
    task -> the run's task); an empty plan becomes one coder step with the
    whole task; at most ``max_agents`` steps."""
    p = plans.withColumn("_steps", parse_plan(F.col("plan_output")))
    fallback = F.array(F.struct(F.lit(dims.DEFAULT_AGENT).alias("agent"), F.lit(True).alias("has_agent"),
                                F.col("task").alias("task"), F.lit(True).alias("has_task")))
    p = p.withColumn("_steps", F.when(F.size("_steps") > 0, F.col("_steps")).otherwise(fallback))
    s = p.select("run_id", "task", F.posexplode("_steps").alias("_i", "_s")).filter(F.col("_i") < max_agents)
    return s.select("run_id", (F.col("_i") + 1).cast("int").alias("step"),
                    F.when(F.col("_s.has_agent"), F.col("_s.agent")).otherwise(F.lit(dims.DEFAULT_AGENT)).alias("agent"),
                    F.when(F.col("_s.has_task"), F.col("_s.task")).otherwise(F.col("task")).alias("task"))


def route_steps(steps: DataFrame) -> DataFrame:
    """J-7: an unknown (or NULL) agent name runs as the coder."""
    known = F.col("agent").isin(ROUTABLE)
    return steps.withColumn("routed_agent", F.when(known, F.col("agent")).otherwise(F.lit(dims.DEFAULT_AGENT)))


def route_single(requests: DataFrame) -> DataFrame:
    """J-8: a direct request to an unknown agent (or the planner) is rejected."""
    return requests.withColumn("accepted", F.coalesce(F.col("agent").isin(ROUTABLE), F.lit(False)))


def route_messages(messages: DataFrame) -> DataFrame:
    """J-6: deliver each message to every routable agent when the recipient
    is 'all' (sender included, planner never), else to the named agent."""
    everyone = F.array(*[F.lit(a) for a in ROUTABLE])
    targets = (F.when(F.col("recipient") == "all", everyone)
               .when(F.col("recipient").isin(ROUTABLE), F.array(F.col("recipient")))
               .otherwise(F.array().cast("array<string>")))
    return messages.withColumn("delivered_to", F.explode(targets))


def result_messages(results: DataFrame, recipient: Column | None = None) -> DataFrame:
    """Each step's result as a 'result' message from its agent, to all unless a recipient is given."""
    return results.select("run_id", "step", F.col("agent_name").alias("sender"),
                          (F.lit("all") if recipient is None else recipient).alias("recipient"), F.col("output").alias("content"),
                          F.lit("result").alias("message_type"))


def previous_results(results: DataFrame) -> DataFrame:
    """Every step sees the results of all earlier steps of its run, in order."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.collect_list(F.struct("step", "agent_name", "output")).over(w)
    return results.select("run_id", "step", "agent_name", prev.alias("previous"))


def run_report(results: DataFrame, plans: DataFrame) -> DataFrame:
    """Markdown report per run, sections in step order (ok -> output, else error)."""
    section = F.concat(F.lit("\n## "), F.when(F.col("success"), F.lit("✅")).otherwise(F.lit("❌")),
                       F.lit(" "), F.upper("agent_name"), F.lit(" Agent\n\n"),
                       F.when(F.col("success"), F.col("output"))
                        .otherwise(F.concat(F.lit("*Error: "), F.col("error"), F.lit("*"))))
    agg = (results.groupBy("run_id")
           .agg(F.count(F.lit(1)).alias("n_results"),
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", section.alias("s")))),
                                         lambda x: x["s"]), "\n").alias("_body")))
    head = F.concat(F.lit("# Multi-Agent Report\n\n**Task:** "), F.col("task"),
                    F.lit("\n\n**Agents involved:** "), F.col("n_results").cast("string"), F.lit("\n\n---\n"))
    return (agg.join(plans.select("run_id", "task"), "run_id")
            .select("run_id", "n_results", F.concat(head, F.col("_body"), F.lit("\n" + REPORT_FOOTER)).alias("report")))
