"""Training-data operators: decontamination, near-duplicates, toxicity, line dedup, LM scores,
WARC revisits, sharding, packing, secret scans and the Jaccard join. Nothing else imports this."""
