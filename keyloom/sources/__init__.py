"""Readers and writers of formats that Spark lacks."""
