"""Structured Streaming entry points."""

from flowsift.streaming.records import ingest_stream
from flowsift.streaming.scoring import predict_stream

__all__ = ["ingest_stream", "predict_stream"]
