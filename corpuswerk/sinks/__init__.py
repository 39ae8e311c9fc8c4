"""Writers of graph tables, graph files and annotated files."""
