"""Query catalogue: named plans and their SQL oracles."""
