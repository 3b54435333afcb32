"""Table-valued operators: index, retrieval, ranking, graphs, semantics, learning, evaluation, crawl planning."""
