"""Nearfield: similarity search, clustering and vector codecs as DataFrame operators."""
