"""Registered queries (one per operator of the inventory) and their SQL oracles."""
