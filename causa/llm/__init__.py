"""Operators for preparing large training corpora.

Every operator is `DataFrame -> DataFrame`, takes the names of the columns it
works on, carries no other column of its input along (so extra columns can't
clash), and cuts lineage only with files in the cluster's shared folder.
"""
