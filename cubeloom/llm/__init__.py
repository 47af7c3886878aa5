"""Training-data operators: packing, nearest neighbours, quality, similarity joins, token files, mixing and more."""
