"""Registered queries (Spark side) and the DuckDB SQL that states the same results."""
