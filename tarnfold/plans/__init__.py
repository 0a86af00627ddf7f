"""The search-box language and how it becomes a plan."""
