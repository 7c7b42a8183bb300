"""Harmonize inconsistently labelled studies into one traceable cohort, and analyse it, on Spark."""
