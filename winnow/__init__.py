"""Structured, untrusted filter requests over Spark DataFrames: validated on the driver, compiled to Catalyst expressions."""
