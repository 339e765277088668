"""Relational operators over files, lines, symbols, edges and ledgers."""
