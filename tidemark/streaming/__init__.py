"""Ingest: admission, buffering and publishing of batches, by call or as a stream."""
