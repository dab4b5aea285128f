"""Pictures, hashes and benchmark rows in and out."""
