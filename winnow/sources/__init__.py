"""Where requests come from: JSON, query strings, and a builder."""
