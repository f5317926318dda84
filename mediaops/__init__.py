"""DataFrame operators for provenance and quality work on media and document corpora."""
