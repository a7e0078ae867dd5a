"""Ledger reconciliation and analytics as Spark DataFrame operators."""
