"""Index, match, rank, search, catalogue, collections and ingest over DataFrames."""
