"""Stream ingest and windowed figures."""
