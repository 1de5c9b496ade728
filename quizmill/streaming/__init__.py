"""The answer and word logs as streams (an addition of this library)."""
