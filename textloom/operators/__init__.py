"""Operators over DataFrames: links, frontier, trees, images, chunks, manifests, conversion."""
