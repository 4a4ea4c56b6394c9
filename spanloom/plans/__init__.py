"""Plans: whole pipelines made of operators, and the queries of this repository."""
