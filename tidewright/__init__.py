"""Tidewright: keyed snapshots, ordered change logs and their resumable application, on Spark."""

__version__ = "0.1.0"
