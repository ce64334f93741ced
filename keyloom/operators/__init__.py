"""Operators over key-value relations."""
