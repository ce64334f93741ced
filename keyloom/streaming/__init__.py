"""Logs: recovery, following, checkpoints, group commit."""
