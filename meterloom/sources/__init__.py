"""Readers and writers: session files, upload batches, telemetry payloads, fact tables."""
