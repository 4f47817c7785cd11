"""Readers and writers: logs, archives, tickets, traces, source maps, records."""
