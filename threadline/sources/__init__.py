"""Readers of snapshots and writers of exports."""
