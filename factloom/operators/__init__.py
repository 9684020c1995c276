"""Operators over facts, chunks, transcripts, blocks, vectors, verdicts and rankings."""
