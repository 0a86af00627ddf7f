"""tarnfold: document search, catalogue analytics and incremental ingest as DataFrame plans."""
