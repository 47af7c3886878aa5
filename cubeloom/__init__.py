"""Hyperspectral scene analytics on Spark DataFrames.

``functions``  column expressions on one row (bands, geometry, colours, text)
``sources``    readers, writers and the scene header
``operators``  DataFrame -> DataFrame operators (statistics, joins, sampling, spatial, learning)
``plans``      chains of operators
``streaming``  the row-local operators on a stream of pixel files
"""
