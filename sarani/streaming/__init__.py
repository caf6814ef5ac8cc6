"""The incremental conversion job."""
