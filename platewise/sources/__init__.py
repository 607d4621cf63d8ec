"""Sources: documents in text columns to rows. Nothing here uses the network; fetched text is a column."""
