"""Tidemark: bulk replication and incremental synchronisation of tables, as Spark plans."""
