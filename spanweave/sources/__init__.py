"""Readers and writers of corpora, catalogs, query sets and indexes."""
