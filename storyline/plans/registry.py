"""Registered queries over the driver's tables, and the same results in SQL where that can express them."""

from . import articles_plan, audits_plan, events_plan, picks_plan, reports_plan, sources_plan

QUERIES = articles_plan.QUERIES | events_plan.QUERIES | reports_plan.QUERIES | sources_plan.QUERIES | audits_plan.QUERIES | picks_plan.QUERIES
ORACLE_SQL = articles_plan.ORACLE_SQL | events_plan.ORACLE_SQL | reports_plan.ORACLE_SQL | sources_plan.ORACLE_SQL | audits_plan.ORACLE_SQL | picks_plan.ORACLE_SQL
