"""Packet captures and Zeek logs as DataFrames, and the event table."""
