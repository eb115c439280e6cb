"""Whole workflows: fit, detect, cross-validate, tune, build evaluation sets."""
