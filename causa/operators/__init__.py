"""DataFrame -> DataFrame operators; catalogs are arguments."""
