"""The stages of a run and the statistics over its results."""
