"""Operators for preparing training corpora: filtering, de-duplication, counting, mixing and packing."""
