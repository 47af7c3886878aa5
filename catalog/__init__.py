"""Queries over the driver's tables with their SQL twins, one entry per operator."""
