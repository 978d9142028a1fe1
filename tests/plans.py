"""Reading physical plans in tests."""

import re


def plan_nodes(df):
    """Names of the physical plan's operators, top first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?m)^[\s:+\-]*(?:\*\(\d+\) )?([A-Z][A-Za-z]+)", plan)
