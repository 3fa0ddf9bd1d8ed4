"""Structured learning as DataFrame work: encode, score, decode, aggregate, train, evaluate."""
