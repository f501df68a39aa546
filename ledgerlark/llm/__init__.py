"""Training-data operators: mixing, decontamination, joins, classifiers, search, sharding, formatting.

Nothing outside this folder imports it.
"""
