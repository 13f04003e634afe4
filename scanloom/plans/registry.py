"""All relational queries and their SQL."""

from __future__ import annotations

from scanloom.plans import skill_queries  # noqa: F401  registers its queries
from scanloom.plans.queries import QUERIES, SQL
from scanloom.plans.rule_findings import finding_queries
from scanloom.plans.rule_queries import rule_queries

for _queries, _sql in (rule_queries(), finding_queries()):
    QUERIES.update(_queries)
    SQL.update(_sql)
