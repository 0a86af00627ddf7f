"""Readers and writers: pages, blobs, state, feeds, and the rules of fetching."""
