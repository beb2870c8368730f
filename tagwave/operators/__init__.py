"""Operators: edits, trending, timeline, leaderboard."""
