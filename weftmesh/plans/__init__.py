"""Shared plan pieces: storage, components, joins by size."""
