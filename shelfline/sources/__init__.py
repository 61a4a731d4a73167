"""Tables, the nested catalog, event envelopes and the mapping of the test tables."""
