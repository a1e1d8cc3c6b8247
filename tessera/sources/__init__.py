"""Readers and writers: JSON lines, tables, packed tokens, shards, manifests."""
