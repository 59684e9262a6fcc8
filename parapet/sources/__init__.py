"""Readers and writers: chat bodies, completions, requests, payloads, audit tables."""
