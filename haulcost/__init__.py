"""Freight charge analytics as Spark DataFrame jobs.

Every job is a plain function ``job(ledger, **parameters) -> DataFrame`` over a
ledger with one row per (shipment, charge line); see ``sources.ledger`` for its
columns.
"""
