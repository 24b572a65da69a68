"""The registered queries: operators applied to the adapters' relations, and their SQL."""
