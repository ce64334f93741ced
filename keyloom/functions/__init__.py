"""Column functions over bytes, keys and checksums."""
