"""Readers and writers of calls, audit rows and scenarios."""
