"""Tessera: a bitemporal fact store with ranked retrieval, written as Spark DataFrame jobs."""
