"""Scalar rules of the hashes as native columns."""
