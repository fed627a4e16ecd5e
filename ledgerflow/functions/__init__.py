"""Part of ledgerflow; see README.md."""
