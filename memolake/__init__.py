"""Spark jobs over large collections of notes and the logs of their use."""
