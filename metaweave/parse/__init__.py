"""Parsers: a member's source becomes node, edge and snippet facts."""
