"""The data work: analytics, listings, audits, ingest and bulk changes."""
