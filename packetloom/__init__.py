"""Packet-stream analytics and corpus preparation as declarative Spark plans."""
