"""Tessera: semi-supervised analytics over DataFrames."""
