"""Scans and sinks: parquet / CSV tables, the experiment table, run log, artefacts, report."""
