"""All registered queries."""

from linelens.plans.catalog import base, causes, flows, inspection, models, process


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLES)
