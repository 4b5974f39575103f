"""Reading and writing of bundles, annotations, gene lists and metric tables."""
