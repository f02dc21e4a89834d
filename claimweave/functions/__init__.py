"""Part of claimweave."""
