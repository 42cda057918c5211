"""Proofs that two plans or two results are equal."""
