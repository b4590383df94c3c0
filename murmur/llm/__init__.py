"""Training-data operators (encoding, fingerprints, scoring, mixing, search).

Nothing outside this package imports it; ``registry`` lists its queries."""
