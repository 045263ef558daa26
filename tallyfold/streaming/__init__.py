"""Results that are kept up as fills arrive, by Structured Streaming."""
