"""Queries of the corpus operators and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from linelens.llm import alignment, licenses, merkle, mix, near_copies, neighbours, packing, periods, records, repeats, simhash, token_counts, toxicity

MODULES = [neighbours, licenses, repeats, mix, toxicity, records, token_counts, near_copies, merkle, packing, periods, alignment, simhash]


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
