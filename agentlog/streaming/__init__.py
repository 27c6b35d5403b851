"""The session and scoring operators on Structured Streaming."""
