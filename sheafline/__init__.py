"""Sheafline: bundle reconciliation and corpus preparation as Spark DataFrame operators."""
